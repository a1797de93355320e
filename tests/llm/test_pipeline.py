"""The stages on a small corpus with planted cases, and the queries of the subpackage against their SQL."""

import random

import check
import pytest

from pastward.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, con, name):
    result = check.compare(queries.QUERIES[name](spark, FOLDER), con, queries.SQL[name])
    assert result.startswith("ok"), result


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def words(draw, count):
    return " ".join("".join(draw.choice("aeioutnrsl") for _ in range(draw.randrange(3, 9))) for _ in range(count))


def test_stages_catch_planted_cases(spark, tmp_path):
    import corpus_pipeline

    draw = random.Random(3)
    rows, labels = [], []
    for k in range(240):
        bad = k % 6 == 0
        text = words(draw, 60) + (" zorgle krumpf bliktar " if bad else " ") + words(draw, 60)
        rows.append([k, text, "en", f"src{k % 5 if k % 3 else 0}", len(text)])
        labels.append((k, 1, int(bad)))
    line = words(draw, 12)
    for k in (1, 2, 3):
        rows[k][1] += "\n" + line
    near = rows[7][1].split(" ")
    near[60] = "changed"
    rows[8][1] = " ".join(near)
    rows[10][1] = rows[11][1] = words(draw, 50)
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: {r[0] for r in d.select("doc_id").collect()} for n, d in kept.items()}
    bad = {k for k, _, t in labels if t}
    assert len(bad - ids["toxicity"]) >= 0.9 * len(bad) and ids["toxicity"] >= set(range(240)) - bad - {8, 10, 11}
    assert ids["line_dedup"] == ids["toxicity"] - {11}
    texts = {r["doc_id"]: r for r in kept["line_dedup"].collect()}
    assert [line in texts[k]["text"] for k in (1, 2, 3)] == [True, False, False] and texts[2]["n_chars"] == len(texts[2]["text"])
    assert ids["near_dedup"] == ids["line_dedup"] - {8} and ids["mixing"] == ids["near_dedup"] == ids["packing"]
    assert kept["packing"].count() == corpus_pipeline.run(spark, str(tmp_path)).count()


SPECIAL = [
    (None, None), (None, ""), (1, None), (2, ""), (2, ""), (3, " \n\t"), (4, "one"), (5, "word " * 40_000), (6, "a b c d e f g h i j k l"), (7, "a b c d e f g h i j k l"),
    (7, "quite another text that shares its id with a copy of the text before"), (8, "line of its own\na b c d e f g h i j k l"),
]


def stage_rows(spark, docs, tmp_path, rows):
    df = docs(*rows).withColumns({c: queries.F.lit("own") for c in ("n_lines", "n_removed", "_toxicity", "text_hash", "kept", "block", "place", "score")})
    spark.createDataFrame([(k, 1, 0) for k in range(9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return df


def test_stages_on_special_rows(spark, docs, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns: columns come back as they were, and no row is lost but copies."""
    import corpus_pipeline as P

    df = stage_rows(spark, docs, tmp_path, SPECIAL)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, df, str(tmp_path))
        assert out.columns == df.columns
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        assert {r["n_lines"] for r in out.collect()} == {"own"} == {r["kept"] for r in out.collect()}
        if name == "near_dedup":
            assert sorted(map(repr, got)) == sorted(map(repr, [r for r in SPECIAL if r != SPECIAL[9]]))
        elif name == "line_dedup":
            gone = {9}  # its only line
            assert sorted(map(repr, got)) == sorted(map(repr, [(8, "line of its own") if k == 11 else r for k, r in enumerate(SPECIAL) if k not in gone]))
        else:
            assert set(got) == set(SPECIAL)
    pieces = P.STAGES[-1][1](spark, df, str(tmp_path))
    assert pieces.count() >= len(SPECIAL)


def test_stages_on_an_empty_table(spark, docs, tmp_path):
    import corpus_pipeline as P

    df = stage_rows(spark, docs, tmp_path, [])
    for _, stage in P.STAGES:
        assert stage(spark, df, str(tmp_path)).collect() == []
