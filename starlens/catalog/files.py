"""Queries on readers and writers: a given table is written in a format, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from starlens.catalog.base import predictions, query
from starlens.catalog.evaluation import scored_texts
from starlens.catalog.text import cleaned
from starlens.operators import resample
from starlens.plans.evaluate import evaluate
from starlens.session import shared_dir
from starlens.sources import results, sinks, tables

_CLEAN = ["review_id", "text", "user_rating"]


def new_path(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/starlens-file-{uuid.uuid4().hex}/{name}"


def _typed(df):
    """Columns of text files are strings."""
    return df.select(F.col("review_id").cast("long").alias("review_id"), "text", F.col("user_rating").cast("int").alias("user_rating"))


@query("s01_s10_csv_reviews", "SELECT review_id, text, user_rating FROM clean")
def s01(spark, folder):
    """Cleaned texts hold no line break, so the files are read in splits."""
    path = new_path(spark, "reviews.csv")
    sinks.write_scored(cleaned(spark, folder).select(*_CLEAN), path, "csv")
    return _typed(tables.read_csv(spark, path, _CLEAN, multi_line=False))


@query("s02_utf16_reviews", "SELECT review_id, text, user_rating FROM clean")
def s02(spark, folder):
    path = new_path(spark, "reviews.tsv")
    rows = cleaned(spark, folder).select(*_CLEAN)
    rows.write.options(sep="\t", encoding="UTF-16", header=True, escape='"').csv(path)
    return _typed(tables.read_reviews(spark, path, _CLEAN))


@query(
    "s10_s13_scored_files",
    """SELECT fmt, review_id, review_body AS text, stars AS user_rating FROM reviews
       CROSS JOIN (VALUES ('parquet'), ('csv'), ('json')) AS v(fmt)""",
)
def s10(spark, folder):
    """Raw texts with their outer blanks, quotes and line breaks."""
    rows = scored_texts(spark, folder).select(*_CLEAN)
    out = []
    for fmt in ("parquet", "csv", "json"):
        path = new_path(spark, fmt)
        sinks.write_scored(rows, path, fmt)
        read = tables.read_csv(spark, path, _CLEAN) if fmt == "csv" else spark.read.schema(rows.schema).format(fmt).load(path)
        out.append(_typed(read).withColumn("fmt", F.lit(fmt)))
    return resample.union_sources(*out)


@query("s03_read_splits", "SELECT split, review_id % 1000 AS part, count(*) AS reviews, sum(user_rating) AS stars FROM split_rows GROUP BY ALL")
def s03(spark, folder):
    from starlens.catalog.sampling import ids

    split = resample.holdout_split(ids(spark, folder))
    paths = {}
    for name in ("train", "validation", "holdout"):
        paths[name] = new_path(spark, name)
        split.filter(F.col("split") == name).write.parquet(paths[name])
    rows = tables.read_splits(spark, paths, "review_id", "user_rating")
    return rows.groupBy("split", (F.col("review_body") % 1000).alias("part")).agg(
        F.count("*").alias("reviews"), F.sum("stars").alias("stars")
    )


@query("s12_holdout_file", "SELECT review_id, user_rating FROM split_rows WHERE split = 'holdout'")
def s12(spark, folder):
    from starlens.catalog.sampling import ids

    path = new_path(spark, "holdout")
    sinks.write_holdout(resample.holdout_split(ids(spark, folder)), path)
    return spark.read.parquet(path).select("review_id", "user_rating")


@query(
    "s07_s17_error_export",
    """SELECT r.review_id, b.review_body AS text, user_rating, pred AS pred_star_rounded, abs(user_rating - pred) AS abs_error
       FROM rounded r JOIN reviews b USING (review_id) WHERE model_order = 0 AND abs(user_rating - pred) >= 2""",
)
def s07(spark, folder):
    sure = F.array(*[F.lit(0.2)] * 5)
    paths = sinks.write_error_analysis(scored_texts(spark, folder).withColumn("probs", sure), new_path(spark, "errors"))
    read = tables.read_error_export(spark, paths["severe_errors"])
    return read.select(
        F.col("review_id").cast("long").alias("review_id"), "text",
        *[F.col(c).cast("int").alias(c) for c in ("user_rating", "pred_star_rounded", "abs_error")],
    )


@query(
    "s08_s14_report_file",
    """SELECT model, n_samples, round(mae, 6) AS mae, round(f1_macro, 6) AS f1_macro,
              (SELECT model FROM bundle ORDER BY mae, model_order LIMIT 1) AS best_model FROM bundle""",
)
def s08(spark, folder):
    path = new_path(spark, "report")
    sinks.write_report(evaluate(predictions(spark, folder)).report, path)
    read = results.read_report(spark, path).filter("model <> 'majority'")
    return read.select("model", "n_samples", F.round("mae", 6).alias("mae"), F.round("f1_macro", 6).alias("f1_macro"), "best_model")


@query("s11_prediction_files", "SELECT model, user_rating, pred AS pred_star_rounded, count(*) AS reviews FROM rounded GROUP BY ALL")
def s11_files(spark, folder):
    path = new_path(spark, "predictions")
    sinks.write_predictions(predictions(spark, folder).withColumn("text", F.lit("")), path)
    return spark.read.parquet(path).groupBy("model", "user_rating", "pred_star_rounded").agg(F.count("*").alias("reviews"))
