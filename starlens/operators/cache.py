"""Reuse of encoded vectors, and corpus fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.operators import ranking
from starlens.session import stage


def text_key(model: str, strategy: str, text: Column) -> Column:
    """Cache key of one text under one encoder and one normalisation."""
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(strategy), text), 256)


def split_hits(df: DataFrame, cache: DataFrame, model: str, strategy: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose vector is stored (with it), and the distinct texts still to encode."""
    keyed = df.withColumn("cache_key", text_key(model, strategy, F.col("text")))
    # One stored vector per key, or a text that is stored n times and read m times would give n m rows.
    unique = cache.groupBy("cache_key").agg(F.first("embedding").alias("embedding"))
    hits = keyed.join(unique, "cache_key")
    missing = keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
    # Equal texts are encoded once; the partial aggregation absorbs a hot text.
    return hits, missing.select("cache_key", "text").distinct()


def corpus_fingerprint(
    df: DataFrame,
    text: str = "text",
    id_col: str = "review_id",
    fanout: int = 1024,
    least_levels: int = 4,
) -> DataFrame:
    """Order-sensitive sha256 of all texts, first 16 hex digits.

    A tree of digests: rows are numbered in the order of their unique ids, cut
    into ranges of ``fanout``, each range is hashed in order, and the range
    hashes are hashed again until one is left (``least_levels`` times at
    least).  No group holds more than ``fanout`` digests, whatever the ids.
    """
    digests = stage(df.select(F.col(id_col).alias("i"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("h")))
    numbered = ranking.ordinal(digests, F.col("i"), bucket=ranking.id_bucket(digests, "i"), name="n")
    nodes = numbered.select((F.col("n") - 1).alias("i"), "h")
    left, levels = digests.count(), 0
    while left > 1 or levels < least_levels:
        left, levels = -(-left // fanout), levels + 1
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda s: s["h"])
        nodes = nodes.groupBy(F.floor(F.col("i") / fanout).alias("g")).agg(
            F.sha2(F.array_join(ordered, "\n"), 256).alias("h")
        ).select(F.col("g").alias("i"), "h")
    return nodes.select(F.substring("h", 1, 16).alias("fingerprint"))


def composite_key(model: str, strategy: str, n_train: Column, n_validation: Column, fingerprint: Column) -> Column:
    """Key of one encoded data set: any change of model, strategy, size or text changes it."""
    joined = F.concat_ws(
        "|", F.lit(model), F.lit(strategy), n_train.cast("string"), n_validation.cast("string"), fingerprint
    )
    return F.substring(F.sha2(joined, 256), 1, 16)
