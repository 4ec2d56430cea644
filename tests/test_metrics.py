"""Metrics against a plain Python version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from starlens.operators import errors, metrics as M
from starlens.plans.evaluate import evaluate


def plain(pairs):
    y = [t for t, _ in pairs]
    p = [max(1, min(5, round(e))) for _, e in pairs]
    n = len(pairs)
    f1, support = {}, {}
    for s in range(1, 6):
        hit = sum(a == b == s for a, b in zip(y, p))
        whole = y.count(s) + p.count(s)
        support[s] = y.count(s)
        f1[s] = 2 * hit / whole if whole else 0.0
    present = [s for s in range(1, 6) if s in y or s in p]
    flag = [abs(t - e) >= 2 for t, e in pairs]
    severe = [abs(a - b) >= 2 for a, b in zip(y, p)]
    both = sum(a and b for a, b in zip(flag, severe))
    return {
        "mae": sum(abs(t - e) for t, e in pairs) / n,
        "rmse": math.sqrt(sum((t - e) ** 2 for t, e in pairs) / n),
        "accuracy": sum(a == b for a, b in zip(y, p)) / n,
        "f1_macro": sum(f1[s] for s in present) / len(present),
        "f1_weighted": sum(f1[s] * support[s] for s in f1) / n,
        "off_by_one_accuracy": sum(abs(a - b) <= 1 for a, b in zip(y, p)) / n,
        "anomaly_rate": sum(flag) / n,
        "severe_error_rate": sum(severe) / n,
        "anomaly_precision": both / sum(flag) if any(flag) else 0.0,
        "anomaly_recall": both / sum(severe) if any(severe) else 0.0,
    }


def frame(spark, pairs, model="m"):
    return spark.createDataFrame([(model, t, float(e)) for t, e in pairs], "model string, user_rating int, ai_expected_rating double")


@pytest.mark.parametrize(
    "pairs",
    [
        list(zip([1, 2, 3, 4, 5], [1, 2, 3, 4, 5])),
        list(zip([3, 3, 3], [4, 2, 3])),
        list(zip([1, 5], [5, 1])),
        list(zip([4, 4, 5], [4, 5, 5])),
        [(random.Random(i).randint(1, 5), random.Random(i + 999).uniform(1, 5)) for i in range(200)],
    ],
)
def test_bundle(spark, pairs):
    got = M.bundle(frame(spark, pairs)).first()
    for name, value in plain(pairs).items():
        assert got[name] == pytest.approx(value), name


def test_two_macro_averages(spark):
    df = frame(spark, [(4, 4), (4, 5), (5, 5)])
    report = {r["label"]: r for r in M.class_report(df).collect()}
    assert report["macro avg"]["f1"] < M.bundle(df).first()["f1_macro"]
    assert report["1"]["precision"] == 0.0 and report["4"]["support"] == 2


def test_confusion_pairs(spark):
    got = errors.confusion_pairs(frame(spark, [(1, 5.0), (5, 1.0), (3, 3.2)])).collect()
    assert [(r["pair"], r["reviews"], r["severe_count"]) for r in got] == [("1->5", 1, 2), ("5->1", 1, 2)]


def test_winners_and_champion(spark):
    rows = [("a", 0, 0.5, 0.6), ("b", 1, 0.5, 0.7), ("c", 2, None, 0.7)]
    base = spark.createDataFrame(rows, "model string, model_order int, mae double, accuracy double")
    wide = base.withColumns({m: F.lit(None).cast("double") for m, _ in M.SUMMARY_METRICS if m not in ("mae", "accuracy")})
    got = {r["metric"]: r["winner"] for r in M.winners(wide).collect()}
    assert got["mae"] == "tie" and got["accuracy"] == "b" and got["rmse"] == "tie"
    ranked = base.filter("mae is not null")
    assert M.champion(ranked, "mae").first()["best_model"] == "a"
    assert M.champion(ranked, "accuracy").first()["best_model"] == "b"
    with pytest.raises(ValueError):
        M.champion(ranked, "speed")
    stored = spark.createDataFrame([("b",)], "best_model string")
    assert M.resolve_champion(stored, ranked, ["a", "b"]).first()[0] == "b"
    assert M.resolve_champion(stored, ranked, ["a"]).first()[0] == "a"
    assert M.resolve_champion(stored, None, ["a"]).first()[0] == "baseline"


def test_evaluate_report(spark):
    pairs = [(random.Random(i).randint(1, 5), random.Random(i + 5).uniform(1, 5)) for i in range(60)]
    both = frame(spark, pairs, "x").withColumn("model_order", F.lit(0)).unionByName(
        frame(spark, [(t, t) for t, _ in pairs], "y").withColumn("model_order", F.lit(1))
    )
    found = evaluate(both)
    document = found.report.first()
    assert document["best_model"] == "y"
    assert set(document["models"]) == {"x", "y", "majority"}
    assert sum(sum(row) for row in document["models"]["x"]["confusion_matrix"]) == 60


def test_one_pass_over_all_models(spark):
    plan = M.bundle(frame(spark, [(1, 2.0)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
