"""Readers, writers and result files."""

import json

import pytest
from pyspark.sql import functions as F

from starlens.operators import experiments, standard
from starlens.plans.evaluate import evaluate
from starlens.sources import results, sinks, tables


def test_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('Review,Rating\n"two\nlines, ""quoted""",5\nplain,bad\nother text,2.5\n', encoding="utf-8")
    out = standard.standardise(tables.add_review_id(tables.read_csv(spark, str(path)))).orderBy("user_rating").collect()
    assert [(r["text"], r["user_rating"]) for r in out] == [("other text", 2), ('two lines, "quoted"', 5)]


def test_utf16_tsv_skips_long_lines_only(spark, tmp_path):
    path = tmp_path / "r.tsv"
    path.write_text("text\trating\tplace_name\nอร่อย\t5\tร้าน\ntoo\t1\tmany\tfields\nshort\t3\n", encoding="utf-16")
    out = tables.read_reviews(spark, str(path), ["text", "rating", "place_name"]).collect()
    assert sorted((r["text"], r["place_name"]) for r in out) == [("short", None), ("อร่อย", "ร้าน")]


def test_splits_and_error_export(spark, tmp_path):
    for name in ("train", "test"):
        spark.createDataFrame([("t", 4)], "review_body string, stars int").write.parquet(str(tmp_path / name))
    both = tables.read_splits(spark, {n: str(tmp_path / n) for n in ("train", "test")}, "review_body", "stars")
    assert {r["split"] for r in both.collect()} == {"train", "test"}
    assert tables.read_error_export(spark, str(tmp_path / "missing.csv")) is None
    (tmp_path / "no_text.csv").write_text("a,b\n1,2\n")
    assert tables.read_error_export(spark, str(tmp_path / "no_text.csv")) is None


@pytest.fixture()
def scored(spark):
    rows = [(1, "far off", 5, 1.2, [0.9, 0.1, 0.0, 0.0, 0.0]), (2, "shaky hit", 3, 3.1, [0.2, 0.2, 0.3, 0.2, 0.1]), (3, "fine", 4, 4.0, [0.0, 0.0, 0.1, 0.9, 0.0])]
    return spark.createDataFrame(rows, "review_id long, text string, user_rating int, ai_expected_rating double, probs array<double>")


def test_error_analysis_and_sinks(spark, scored, tmp_path):
    paths = sinks.write_error_analysis(scored, str(tmp_path / "e"))
    severe = tables.read_error_export(spark, paths["severe_errors"])
    assert [(r["text"], r["abs_error"]) for r in severe.collect()] == [("far off", "4")]
    assert [r["text"] for r in tables.read_csv(spark, paths["low_confidence_correct"]).collect()] == ["shaky hit"]
    assert spark.read.json(paths["confusion_summary"]).first()["pair"] == "5->1"
    for fmt in ("parquet", "csv", "json"):
        sinks.write_scored(scored, str(tmp_path / fmt), fmt)
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert "probs" not in tables.read_csv(spark, str(tmp_path / "csv")).columns
    sinks.write_predictions(scored.withColumn("model", F.lit("m")), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).filter("model = 'm'").count() == 3
    split = scored.withColumn("split", F.when(F.col("review_id") == 1, "holdout").otherwise("train"))
    sinks.write_holdout(split, str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).first()["text"] == "far off"


def test_report_round_trip(spark, scored, tmp_path):
    rows = scored.withColumns({"model": F.lit("m"), "model_order": F.lit(0)})
    sinks.write_report(evaluate(rows).report, str(tmp_path / "report"))
    back = {r["model"]: r for r in results.read_report(spark, str(tmp_path / "report")).collect()}
    assert back["m"]["best_model"] == "m" and back["m"]["n_samples"] == 3 and "majority" in back


def test_results_from_files(spark, tmp_path):
    def put(run, model, name, body):
        folder = tmp_path / run / model
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json").write_text(json.dumps(body, indent=1))

    ok = {"variant": "a", "status": "ok", "config_overrides": {"x": "1"}, "metrics": {"mae": 0.5, "accuracy": 0.6}, "duration": 2.0}
    put("r1", "baseline", "a", ok)
    put("r1", "baseline", "_index", {"variant": "index"})
    put("r2", "embedding", "b", {**ok, "variant": "b", "metrics": {"mae": 0.4}})
    put("r2", "embedding", "c", {"variant": "c", "status": "error", "error": "broke", "duration": 1.0})
    table = results.read_results(spark, str(tmp_path))
    assert sorted((r["run_id"], r["model"], r["variant"]) for r in table.collect()) == [
        ("r1", "baseline", "a"), ("r2", "embedding", "b"), ("r2", "embedding", "c"),
    ]
    ranked = experiments.comparison_export(table)
    assert [(r["rank"], r["variant"]) for r in ranked.collect()] == [(1, "b"), (2, "a")]
    assert tuple(ranked.columns) == experiments.EXPORT_COLUMNS
    sinks.write_comparison(ranked, str(tmp_path / "out.csv"))
    results.append_results(table.drop("config_overrides"), str(tmp_path / "log"))
    results.append_results(table.drop("config_overrides"), str(tmp_path / "log"))
    assert results.read_appended(spark, str(tmp_path / "log")).count() == 6
    spread = experiments.spread(table).first()
    assert (spread["best_variant"], spread["worst_variant"], spread["failed_variants"]) == ("b", "a", "c")
