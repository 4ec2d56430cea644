"""Error analysis: severe errors, shaky hits, confusion pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions import ratings


def with_rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("pred_star_rounded", ratings.clip_star(F.col("ai_expected_rating")))


def severe_errors(df: DataFrame, min_delta: int = 2) -> DataFrame:
    """Rows whose rounded star is off by ``min_delta`` or more."""
    gap = F.abs(F.col("pred_star_rounded") - F.col("user_rating"))
    return with_rounded(df).withColumn("abs_error", gap).filter(F.col("abs_error") >= min_delta)


def low_confidence_hits(df: DataFrame, limit: float = 0.4, probs: str = "probs") -> DataFrame:
    """Rows that are right although no class is likely."""
    return (
        with_rounded(df)
        .withColumn("max_prob", F.array_max(probs))
        .filter((F.col("pred_star_rounded") == F.col("user_rating")) & (F.col("max_prob") < limit))
    )


def confusion_pairs(df: DataFrame, min_delta: int = 2) -> DataFrame:
    """(pair, reviews, severe_count): severe errors per "true->predicted", most frequent first."""
    severe = severe_errors(df, min_delta)
    pairs = severe.groupBy("user_rating", "pred_star_rounded").agg(F.count(F.lit(1)).alias("reviews"))
    name = F.concat_ws("->", F.col("user_rating").cast("string"), F.col("pred_star_rounded").cast("string"))
    total = pairs.agg(F.coalesce(F.sum("reviews"), F.lit(0))).scalar()
    return pairs.select(
        name.alias("pair"), "reviews", total.alias("severe_count"), F.lit(min_delta).alias("min_delta")
    ).orderBy(F.col("reviews").desc(), "user_rating", "pred_star_rounded")
