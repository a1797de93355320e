from pastward.llm import line_dedup

BASE = "the quick brown fox jumps over it"


def lines(df):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.without_repeated_lines(df).collect()}


def test_equal_and_near_lines_keep_the_earliest(docs):
    got = lines(docs(
        (1, BASE), (2, f"first line of its own here\n{BASE}"), (3, BASE.replace("quick", "quack")), (4, BASE.replace("brown", "browns")),
        (5, BASE.replace("fox", "fx")), (6, BASE.replace("quick", "slack")), (7, BASE + "!"), (8, "!" + BASE)))
    assert got[1] == (BASE, 1, 0)
    assert got[2] == ("first line of its own here", 2, 1)
    for doc in (3, 4, 5, 7, 8):
        assert got[doc] == ("", 1, 1)
    assert got[6][2] == 0  # three edits


def test_judged_on_the_input_not_on_what_is_left(docs):
    one, two, three = "a" * 30, "a" * 29 + "b", "a" * 28 + "bb"
    got = lines(docs((1, one), (2, two), (3, three)))
    assert [got[k][2] for k in (1, 2, 3)] == [0, 1, 1]  # 3 is near 2, though 2 goes


def test_short_blank_null_and_repeated(docs):
    got = line_dedup.without_repeated_lines(docs((1, "short\n\n" + " " * 40), (2, "short\n\n" + " " * 40), (3, None), (4, ""), (5, BASE), (5, BASE), (None, BASE))).collect()
    assert sum(r["n_removed"] for r in got) == 3  # a null id comes first, both rows of 5 go
    assert {(r["doc_id"], r["text"]) for r in got} >= {(1, "short\n\n" + " " * 40), (2, "\n" + " " * 40), (3, None), (4, ""), (None, BASE)}
    assert len(got) == 7


def test_long_lines_and_hot_variants(docs):
    long = "".join(chr(97 + k * k % 26) for k in range(3000))
    rows = [(k, f"this is page number {k} of the book") for k in range(100, 160)]
    got = lines(docs((1, long), (2, long[:1700] + "#" + long[1701:]), (3, long[:900] + long[901:]), (4, "#?" + long), *rows))
    assert [got[k][2] for k in (1, 2, 3, 4)] == [0, 1, 1, 0]
    for k, text in rows:
        near = any(sum(x != y for x, y in zip(text, other)) == 1 for j, other in rows if j < k)
        assert got[k][2] == near


def test_empty_table_and_clashing_columns(docs, clashing):
    assert line_dedup.without_repeated_lines(docs()).collect() == []
    df = clashing(docs((1, BASE), (2, BASE)))
    out = line_dedup.without_repeated_lines(df)
    assert set(df.columns) <= set(out.columns) and sorted(r["n_removed"] for r in out.collect()) == [0, 1]


def test_lines_of_few_characters(docs):
    rows = [(1, "a"), (2, "b"), (3, "ab"), (4, "xyz"), (5, "xyz"), (6, "xy"), (7, "x"), (8, "q r"), (9, "\u00a0")]

    def distance(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            row, last = [i], row
            for j, d in enumerate(t, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return row[-1]

    got = lines(docs(*rows))
    for k, text in rows:
        assert got[k][2] == any(distance(text, other) <= 1 for j, other in rows if j < k), (k, text)
    few = line_dedup.without_repeated_lines(docs(*rows), min_chars=20)
    assert {r["doc_id"] for r in few.collect() if r["n_removed"]} == {5}  # equal ones only
