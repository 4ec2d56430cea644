"""Streaming queries; they run to the end of the given files and are compared as batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from starlens.catalog import sqltext as Q
from starlens.catalog.base import part, query, table
from starlens.functions import text as T
from starlens.operators.once import compute_once
from starlens.session import shared_dir
from starlens.streaming import jobs

part(
    "rated_events",
    """SELECT ts, event_type AS place_name, CAST(1 + user_id % 5 AS INTEGER) AS user_rating,
              1 + (CAST(round(value * 100) AS BIGINT) % 401) / 100e0 AS ai_expected_rating FROM events""",
)


def rate_events(events):
    """Events as reviews of venues (the event types)."""
    return events.select(
        "ts",
        F.col("event_type").alias("place_name"),
        (F.lit(1) + F.col("user_id") % 5).cast("int").alias("user_rating"),
        (F.lit(1.0) + F.round(F.col("value") * 100).cast("long") % 401 / F.lit(100.0)).alias("ai_expected_rating"),
    )


def as_naive(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


_RATE = """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, place_name, count(*) AS reviews,
           count(*) FILTER (abs(user_rating - ai_expected_rating) >= 2) AS anomalies,
           round(count(*) FILTER (abs(user_rating - ai_expected_rating) >= 2) / count(*), 6) AS anomaly_rate
    FROM rated_events GROUP BY ALL
"""


@query("x02_anomaly_rate", _RATE)
def x02(spark, folder):
    out = jobs.anomaly_rate(jobs.flag_events(rate_events(table(spark, folder, "events"))))
    return as_naive(out.withColumn("anomaly_rate", F.round("anomaly_rate", 6)))


@query(
    "x01_stream_scoring",
    f"""SELECT doc_id AS review_id, {Q.extended('text')} AS text, CAST(1 + (doc_id * 7 + n_chars) % 5 AS INTEGER) AS user_rating,
               round(abs(1 + (doc_id * 7 + n_chars) % 5 - (1 + ((doc_id * 37 + n_chars * 11) % 401) / 100e0)), 6) AS delta,
               abs(1 + (doc_id * 7 + n_chars) % 5 - (1 + ((doc_id * 37 + n_chars * 11) % 401) / 100e0)) >= 2e0 AS is_anomaly FROM documents""",
)
def x01(spark, folder):
    from starlens.catalog.base import MODELS, expectation

    _, a, b = MODELS[0]
    schema = table(spark, folder, "documents").schema
    arriving = jobs.read_stream(spark, folder, schema, "documents.parquet")
    rated = arriving.select(
        F.col("doc_id").alias("review_id"),
        "text",
        (F.lit(1) + (F.col("doc_id") * 7 + F.col("n_chars")) % 5).cast("int").alias("user_rating"),
        expectation(a, b).alias("ai_expected_rating"),
    )
    scored = jobs.flag_events(compute_once(rated, "text", T.extended(F.col("text"))))
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_to_files(scored, f"{place}/out", f"{place}/checkpoint").awaitTermination()
    out = spark.read.schema(scored.schema).parquet(f"{place}/out")
    return out.select("review_id", "text", "user_rating", F.round("delta", 6).alias("delta"), "is_anomaly")


@query("x02_stream_anomaly_rate", _RATE)
def x02_stream(spark, folder):
    """Each micro-batch writes the windows that it changed; the last state of every window counts, also of open ones."""
    schema = table(spark, folder, "events").schema
    arriving = rate_events(jobs.read_stream(spark, folder, schema, "events.parquet"))
    rates = jobs.anomaly_rate(jobs.flag_events(arriving))
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(changed, number):
        changed.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    jobs.run_per_batch(rates, write, f"{place}/checkpoint").awaitTermination()
    written = spark.read.schema(rates.schema.add("batch", "long")).parquet(f"{place}/out")
    last = written.groupBy("window_start", "place_name").agg(
        F.max_by(F.struct("reviews", "anomalies", "anomaly_rate"), "batch").alias("r")
    )
    out = last.select("window_start", "place_name", "r.*")
    return as_naive(out.withColumn("anomaly_rate", F.round("anomaly_rate", 6)))
