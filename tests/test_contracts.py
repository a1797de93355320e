"""Feature contracts, stored models and boosted classifiers."""

import math
import random

import pytest
from result_rows import collected

from pastward.operators import contracts, models
from pastward.operators.decisions import PROBS
from pastward.sources import versions

FEATURES = ["a", "b"]
SCHEMA = "id int, a double, b double, result string"


def drawn(count=240, seed=4):
    """b decides between H and A, a missing a means D."""
    draw, out = random.Random(seed), []
    for k in range(count):
        a, b = draw.choice([None, draw.uniform(-1, 1), draw.uniform(-1, 1)]), draw.uniform(-1, 1)
        out.append((k, a, b, "D" if a is None else "H" if b > 0 else "A"))
    return out


def test_contract_of_training_rows(rows):
    nan, inf = float("nan"), float("inf")
    df = rows(SCHEMA, (1, 1.0, None, "H"), (2, nan, -3.0, "D"), (3, 2.5, inf, "A"), (4, None, 7.0, "A"))
    got = collected(contracts.feature_contract(df, FEATURES))
    assert got == [(1, "a", "double", 4, 1, 1.0, 2.5), (2, "b", "double", 4, 1, -3.0, 7.0)]
    with pytest.raises(ValueError, match="result"):
        contracts.feature_contract(df, ["a", "result"])
    with pytest.raises(ValueError, match="needs features"):
        contracts.feature_contract(df, [])
    assert collected(contracts.feature_contract(rows(SCHEMA), ["a"])) == [(1, "a", "double", 0, 0, None, None)]


def test_findings_on_schema_and_values(rows):
    train = rows("a double, b double, c double, d int", *[(float(k), float(k), 1.0, k) for k in range(10)])
    contract = contracts.feature_contract(train, ["a", "b", "c", "d", "a"])
    new = rows("a double, d string, c double, extra int", (11.0, "x", None, 1), (-0.5, "y", float("inf"), 1), (5.0, "z", 1.0, 1))
    assert collected(contracts.contract_findings(new, contract, forbidden=("c",), tokens=("d",)), "position", "finding", "rows") == sorted([
        (1, "repeated", 3), (5, "repeated", 3), (1, "outside_training_range", 2), (5, "outside_training_range", 2), (2, "missing", 3),
        (3, "forbidden", 3), (3, "not_finite", 1), (3, "more_nulls", 1), (4, "forbidden", 3), (4, "type", 3),
    ], key=repr)
    # a schema that does not fit is a finding of an empty table, too
    assert collected(contracts.contract_findings(new.limit(0), contracts.feature_contract(train, ["b"])), "feature", "finding", "rows") == [("b", "missing", 0)]
    assert contracts.contract_findings(train, contracts.feature_contract(train, ["a", "d"])).count() == 0


def test_saved_model_predicts_as_before(spark, rows, tmp_path, monkeypatch):
    train, path = rows(SCHEMA, *drawn()), str(tmp_path / "model")
    model = models.fit_logistic(train, FEATURES, "result")
    saved = contracts.SavedModel("logistic", model, contracts.feature_contract(train, FEATURES), 0.3, 2)
    with pytest.raises(FileNotFoundError):
        contracts.load_model(spark, path)
    assert contracts.save_model(saved, path) == 0
    loaded = contracts.load_model(spark, path)
    assert (loaded.name, loaded.draw_threshold, loaded.features) == ("logistic", 0.3, FEATURES)
    before = collected(models.predict_classes(model, train), "id", *PROBS)
    assert collected(contracts.predict(loaded, train), "id", *PROBS) == before
    for wrong in (train.drop("b"), train.withColumn("b", train["b"].cast("string"))):
        with pytest.raises(ValueError, match="b is (missing|string), not double"):
            contracts.predict(loaded, wrong)
    with monkeypatch.context() as patched:
        patched.setattr(versions, "mark", lambda *args: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            contracts.save_model(contracts.SavedModel("half", model, saved.contract, 0.4, 2), path)
    assert contracts.load_model(spark, path).name == "logistic"
    assert contracts.save_model(contracts.SavedModel("next", model, saved.contract, 0.4, 2), path) == 1
    assert contracts.load_model(spark, path).name == "next" and contracts.load_model(spark, path, 0).name == "logistic"
    for bad in (
        contracts.SavedModel("x", model, saved.contract, 1.5, 2), contracts.SavedModel("x", model, saved.contract, 0.3, 3),
        contracts.SavedModel("x", model, contracts.feature_contract(train, ["b", "a"]), 0.3, 2),
    ):
        with pytest.raises(ValueError):
            contracts.save_model(bad, path)


def test_boosted_classes_and_missing_values(rows, tmp_path):
    train, valid = rows(SCHEMA, *drawn()), rows(SCHEMA, *drawn(120, seed=9))
    right = {}
    for missing in ("median", "direction"):
        model = models.fit_boosted_classifier(train, FEATURES, "result", missing, rounds=4, depth=3)
        out = models.predict_boosted(model, valid).collect()
        assert all(sum(r[p] for p in PROBS) == pytest.approx(1) for r in out)
        right[missing] = sum(r["result"] == "HDA"[max(range(3), key=lambda k: r[PROBS[k]])] for r in out) / len(out)
    assert right["direction"] > 0.95
    margins = model.transform(valid).collect()
    for r, row in zip(sorted(margins, key=lambda r: r["id"]), sorted(out, key=lambda r: r["id"])):
        own = [1 / (1 + math.exp(-2 * r[f"_margin_{k}"][1])) for k in range(3)]
        assert [row[p] for p in PROBS] == pytest.approx([p / sum(own) for p in own])
    model.write().save(str(tmp_path / "m"))
    again = models.predict_boosted(models.PipelineModel.load(str(tmp_path / "m")), valid)
    assert collected(again, "id", *PROBS) == sorted(((r["id"], *[r[p] for p in PROBS]) for r in out), key=repr)
