"""Linear scoring with a stored coefficient table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions import ratings


def logits(
    weighted: DataFrame,
    coefficients: DataFrame,
    keys: Sequence[str],
    classes: int = 5,
) -> DataFrame:
    """(keys, s1..sK): sum of weight times coefficient per class.

    ``coefficients`` has one row (term, coef array) per vocabulary term, so it
    is bounded by the vocabulary size and broadcast.
    """
    joined = weighted.join(F.broadcast(coefficients), "term")
    sums = [F.sum(F.col("weight") * F.col("coef")[k]).alias(f"s{k + 1}") for k in range(classes)]
    return joined.groupBy(*keys).agg(*sums)


def unit_logits(
    terms: DataFrame,
    vocabulary: DataFrame,
    coefficients: DataFrame,
    keys: Sequence[str],
    classes: int = 5,
) -> DataFrame:
    """(keys, s1..sK) straight from terms that carry the empty marker term.

    The unit length is divided out after the sums, so no window over the terms
    of a text is needed, and the marker (idf and coefficients zero) keeps texts
    without known terms.  Both small tables are bounded by the vocabulary size.
    """
    spark = terms.sparkSession
    nothing = F.array(*[F.lit(0.0)] * classes)
    blank = spark.range(1).select(F.lit("").alias("term"), F.lit(0.0).alias("idf"), nothing.alias("coef"))
    known = vocabulary.select("term", "idf").unionByName(blank.select("term", "idf"))
    weights = coefficients.select("term", "coef").unionByName(blank.select("term", "coef"))
    counted = (
        terms.join(F.broadcast(known), "term")
        .groupBy(*keys, "term", "idf")
        .agg((F.sum("uses") * F.col("idf")).alias("raw"))
    )
    sums = [F.sum(F.col("raw") * F.col("coef")[k]).alias(f"s{k + 1}") for k in range(classes)]
    summed = (
        counted.join(F.broadcast(weights), "term")
        .groupBy(*keys)
        .agg(*sums, F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"))
    )
    return summed.select(*keys, *[F.try_divide(f"s{k + 1}", "_norm").alias(f"s{k + 1}") for k in range(classes)])


def probabilities(intercepts: Sequence[float], classes: int = 5) -> Column:
    """Softmax over the summed logits; documents without a known term keep the intercepts."""
    values = [F.coalesce(F.col(f"s{k + 1}"), F.lit(0.0)) + F.lit(float(intercepts[k])) for k in range(classes)]
    return ratings.softmax(F.array(*values))


def predict(
    docs: DataFrame,
    weighted: DataFrame,
    coefficients: DataFrame,
    intercepts: Sequence[float],
    keys: Sequence[str] = ("review_id",),
) -> DataFrame:
    """The documents plus ``probs`` and ``ai_expected_rating``."""
    summed = logits(weighted, coefficients, keys, len(intercepts))
    scored = docs.join(summed, list(keys), "left").withColumn("probs", probabilities(intercepts, len(intercepts)))
    return scored.drop(*[f"s{k + 1}" for k in range(len(intercepts))]).withColumn(
        "ai_expected_rating", ratings.expected_rating(F.col("probs"))
    )
