"""Writers, table changes and the stream ingest."""

import json
import random

import pytest
from result_rows import collected
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pastward.operators import upsert
from pastward.sources import sinks, tables, versions
from pastward.streaming import ingest


def test_replace_slice_also_by_nothing(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    df = rows("season int, v int", (1, 10), (2, 20), (2, 21))
    sinks.overwrite(df, path, ["season"])
    sinks.replace_slice(df.filter("season = 2 AND v = 99"), path, {"season": 2})
    assert collected(spark.read.parquet(path), "season", "v") == [(1, 10)]
    sinks.replace_slice(rows("season int, v int", (2, 5)), path, {"season": 2})
    assert collected(spark.read.parquet(path), "season", "v") == [(1, 10), (2, 5)]
    with pytest.raises(Exception, match="outside the slice"):
        sinks.replace_slice(df, path, {"season": 2})


def test_replace_slices_leaves_others(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    sinks.overwrite(rows("season int, v int", (1, 10), (2, 20)), path, ["season"])
    sinks.replace_slices(rows("season int, v int", (2, 22)), path, ["season"])
    assert collected(spark.read.parquet(path), "season", "v") == [(1, 10), (2, 22)]


def test_a_repeated_run_takes_the_place_of_its_first_try(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    for run, value in ((1, 10), (2, 15), (2, 20)):
        sinks.append_run(rows("v int", (value,)), path, run)
    assert collected(spark.read.parquet(path), "run_id", "v") == [(1, 10), (2, 20)]


def test_slices_with_odd_values(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    names = ["a/b", "c=d", "e:f", None, "%"]
    sinks.overwrite(rows("name string, v int", *[(n, 1) for n in names]), path, ["name"])
    for name in names:
        sinks.replace_slice(rows("name string, v int", (name, 2)), path, {"name": name})
    assert {(r["name"], r["v"]) for r in spark.read.parquet(path).collect()} == {(n, 2) for n in names}
    for name in names[:4]:
        sinks.replace_slice(rows("name string, v int"), path, {"name": name})
    assert collected(spark.read.parquet(path), "name", "v") == [("%", 2)]


def test_store_clusters(rows, tmp_path):
    df = rows("id int, c int", (1, 0), (2, 1))
    sinks.store_clusters(df, str(tmp_path / "c"), "c", 2)
    with pytest.raises(ValueError, match="expected 3 clusters"):
        sinks.store_clusters(df, str(tmp_path / "c"), "c", 3)


def test_materialize_keeps_rows_and_types(rows):
    df = rows("a int, b string", (1, "x"), (2, None))
    copy = tables.materialize(df)
    assert copy.schema == df.schema and collected(copy) == collected(df)


def test_upsert_lets_source_null_win(rows):
    old = rows("k int, a string, kept string", (1, "x", "p"), (2, "y", "q"))
    new = rows("k int, a string, kept string, n int", (1, None, "new", 1), (3, "z", "r", 1), (3, "w", "s", 2))
    got = collected(upsert.upsert(old, new, ["k"], ["a"], ["n"]), "k", "a", "kept")
    assert got == [(1, None, "p"), (2, "y", "q"), (3, "w", "s")]


def test_insert_new_takes_first_of_a_repeated_key(rows):
    old = rows("k int, v int", (1, 1))
    new = rows("k int, v int", (1, 9), (2, 5), (2, 4))
    assert collected(upsert.insert_if_absent(old, new, ["k"], ["v"])) == [(1, 1), (2, 4)]


def test_scored_rows_stay_untouched(rows):
    pred = rows("id int, label string, at int", (1, None, None), (2, "H", 5), (3, None, None))
    scored = rows("id int, label string, at int", (1, "A", 9), (2, "D", 9))
    assert collected(upsert.apply_scores(pred, scored, "id", ["label", "at"], "at")) == sorted([(1, "A", 9), (2, "H", 5), (3, None, None)], key=repr)


def test_existing_keys_are_refused(rows):
    df = rows("k int", (1,), (2,))
    with pytest.raises(ValueError, match="exist already"):
        upsert.assert_no_existing(df, df.filter("k = 2"), ["k"])
    upsert.assert_no_existing(df, df.filter("k = 9"), ["k"])


SCHEMA = StructType([StructField("k", IntegerType()), StructField("t", IntegerType()), StructField("v", StringType())])


@pytest.mark.parametrize("mode, expected", [("upsert", [(1, "c"), (2, "b"), (3, "d")]), ("insert", [(1, "a"), (2, "b"), (3, "d")])])
def test_arrivals_fold_into_state(spark, tmp_path, mode, expected):
    arrivals, state, checkpoint = (str(tmp_path / d) for d in ("in", "state", "cp"))
    (tmp_path / "in").mkdir()

    def arrive(name, *records):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip("ktv", r))) for r in records))
        ingest.ingest_arrivals(spark, arrivals, SCHEMA, state, checkpoint, ["k"], ["t"], mode)

    arrive("1.json", (1, 1, "a"), (2, 1, "b"))
    arrive("2.json", (1, 2, "c"), (3, 2, "d"))
    assert collected(ingest.current_state(spark, state, SCHEMA, ["k"], mode), "k", "v") == expected


def _batches(seed=5):
    draw = random.Random(seed)
    return [[(draw.choice([None, *range(12)]), t, f"{n}-{t}") for t in draw.sample(range(50), 15)] for n in range(7)]


@pytest.mark.parametrize("mode", ["upsert", "insert"])
def test_state_of_base_and_deltas(spark, rows, tmp_path, mode):
    """Every state equals a loop over the batches, with compactions and the removal of what they stand for in between."""
    state, held = str(tmp_path / "state"), {}
    for number, batch in enumerate(_batches()):
        assert ingest.write_batch(rows("k int, t int, v string", *batch), number, state, ["k"], ["t"], mode)
        assert ingest.compact(spark, state, SCHEMA, ["k"], mode, after=3) == (number in (2, 5))
        for k, t, v in sorted(batch, key=lambda r: r[1]):
            if mode == "upsert" or k not in held:
                held[k] = (k, t, v)
        if number == 3:
            ingest.clean(spark, state)
        assert collected(ingest.current_state(spark, state, SCHEMA, ["k"], mode)) == sorted(held.values(), key=repr)
    assert versions.committed(spark, state, "base") == [2, 5] and versions.committed(spark, state, "delta") == [3, 4, 5, 6]
    parts = [collected(ingest.current_state(spark, state, SCHEMA, ["k"], mode, buckets=[b])) for b in range(ingest.BUCKETS)]
    assert sorted((r for p in parts for r in p), key=repr) == sorted(held.values(), key=repr)
    assert "PartitionFilters: [isnotnull" in ingest.current_state(spark, state, SCHEMA, ["k"], mode, buckets=[1])._jdf.queryExecution().toString()


def test_batch_that_dies_before_its_marker(spark, rows, tmp_path, monkeypatch):
    state = str(tmp_path / "state")
    ingest.write_batch(rows("k int, t int, v string", (1, 1, "a")), 0, state, ["k"], ["t"])
    lost = rows("k int, t int, v string", (1, 2, "b"), (2, 2, "c"))
    with monkeypatch.context() as patched:
        patched.setattr(versions, "mark", lambda *args: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            ingest.write_batch(lost, 1, state, ["k"], ["t"])
    assert (tmp_path / "state" / "delta=1").is_dir()
    assert collected(ingest.current_state(spark, state, SCHEMA, ["k"]), "k", "v") == [(1, "a")]
    assert ingest.write_batch(lost, 1, state, ["k"], ["t"])
    assert not ingest.write_batch(rows("k int, t int, v string", (9, 9, "z")), 1, state, ["k"], ["t"])
    assert collected(ingest.current_state(spark, state, SCHEMA, ["k"]), "k", "v") == [(1, "b"), (2, "c")]
    assert collected(ingest.current_state(spark, state, SCHEMA, ["k"], before=1), "k", "v") == [(1, "a")]
    assert ingest.current_state(spark, str(tmp_path / "none"), SCHEMA, ["k"]).count() == 0
