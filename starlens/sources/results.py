"""Experiment results and evaluation reports: reading and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = """
    manifest string, variant string, hypothesis string, model string,
    config_overrides map<string,string>,
    metrics struct<mae:double, accuracy:double, f1_macro:double, f1_weighted:double, rmse:double,
        off_by_one_accuracy:double, recall_star_1:double, recall_star_2:double, anomaly_rate:double,
        anomaly_precision:double, anomaly_recall:double, anomaly_f1:double,
        per_class_recall:map<string,double>>,
    status string, error string, duration double
"""

REPORT_SCHEMA = """
    input string, best_model string,
    models map<string, struct<n_samples:bigint, mae:double, rmse:double, accuracy:double, f1_macro:double,
        f1_weighted:double, off_by_one_accuracy:double, recall_star_1:double, recall_star_2:double,
        anomaly_rate:double, anomaly_f1:double, confusion_matrix:array<array<bigint>>>>
"""


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All result files below ``path``/<run>/<model>/; files starting with ``_`` are ignored.

    Run id and model come from the path.
    """
    raw = (
        spark.read.schema(RESULT_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "[!_]*.json")
        .json(path)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    return raw.select(
        F.regexp_extract("_path", r"([^/]+)/([^/]+)/[^/]+$", 1).alias("run_id"),
        F.regexp_extract("_path", r"([^/]+)/([^/]+)/[^/]+$", 2).alias("model"),
        "variant",
        "hypothesis",
        "config_overrides",
        "metrics.*",
        "status",
        "error",
        F.col("duration").alias("duration_sec"),
    )


def append_results(results: DataFrame, path: str) -> None:
    """Append result rows, laid out by run and model."""
    results.write.mode("append").partitionBy("run_id", "model").json(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(best_model, model, model_order, metric columns) of a report file."""
    raw = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
    entries = raw.select("best_model", F.posexplode(F.map_entries("models")).alias("model_order", "m"))
    return entries.select("best_model", F.col("m.key").alias("model"), "model_order", "m.value.*")


def report_document(metrics: DataFrame, confusion: DataFrame, best: DataFrame) -> DataFrame:
    """One row holding the nested report: models with metrics and 5x5 matrix, and the champion."""
    rows = confusion.groupBy("model", "true_star").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pred_star", "reviews"))), lambda s: s["reviews"]).alias("row")
    )
    matrices = rows.groupBy("model").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("true_star", "row"))), lambda s: s["row"]).alias("confusion_matrix")
    )
    names = [c for c in metrics.columns if c not in ("model", "model_order")]
    joined = metrics.join(matrices, "model")
    # One entry per model.
    nested = joined.agg(
        F.map_from_entries(F.collect_list(F.struct("model", F.struct(*names, "confusion_matrix")))).alias("models")
    )
    return nested.withColumn("best_model", best.select("best_model").scalar())
