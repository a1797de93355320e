from pastward.llm import quality_rules as Q

GOOD = " ".join(f"word{k}" for k in range(40))


def judged(df):
    return {r["doc_id"]: r for r in Q.judged(df).collect()}


def test_measures(docs):
    text = "a b c d e f g h i\na b c d e f g h i\nx # $y"
    row = judged(docs((1, text)))[1]
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (21, 22, 2, 1, 18)
    assert row["base_failed"]


def test_overlapping_windows(docs):
    row = judged(docs((1, "z " * 30)))[1]
    assert row["n_repeat_words"] == 30
    row = judged(docs((1, GOOD + " " + " ".join(f"word{k}" for k in range(12)))))[1]
    assert row["n_repeat_words"] == 24


def test_rules_reject_junk_only(docs):
    got = judged(docs((1, GOOD), (2, GOOD.replace(" ", "%%% ")), (3, GOOD.upper()), (4, "few words"), (5, None), (6, ""), (7, GOOD + "\nAll The Same Line\n" * 3)))
    assert [got[k]["kept"] for k in range(1, 8)] == [True, False, False, False, False, False, False]


def test_cascade_order_and_same_verdict(docs):
    df = docs(*[(k, GOOD if k % 3 else "few") for k in range(200)])
    order = Q.plan_cascade(df, Q.RULES, sample=100)
    assert {r.name for r, _, _ in order} == {r.name for r in Q.RULES}
    assert order[0][1] > 0
    kept = {r["doc_id"] for r in Q.kept_documents(df).collect()}
    assert kept == {k for k in range(200) if k % 3}


def test_the_sample_stays_small_when_one_row_repeats(docs):
    df = docs(*[(None, "few words")] * 3000, *[(k, GOOD) for k in range(50)])
    order = Q.plan_cascade(df, Q.RULES, sample=10)
    assert {r.name for r, _, _ in order} == {r.name for r in Q.RULES}
    kept = Q.judged(df).filter("kept").count()
    assert kept == 50


def test_empty_repeated_and_clashing(docs, clashing):
    assert Q.judged(docs()).collect() == []
    rows = Q.judged(clashing(docs((1, GOOD), (1, GOOD), (None, GOOD)))).collect()
    assert [r["kept"] for r in rows] == [True] * 3 and [r["n_words"] for r in rows] == [40] * 3
    assert Q.kept_documents(clashing(docs((1, GOOD)))).count() == 1
