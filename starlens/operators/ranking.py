"""Exact ranks and rank cuts over huge groups without one task per group.

A plain ``row_number() over (partition by star)`` would send a fifth of the
data, or more, to one task.  Here the key space is divided into many buckets
first.  Bucket counts (at most strata x buckets rows) give the rank at which
every bucket starts, so

* ``cut_segments`` only has to sort the few buckets that a cut falls into and
  then reads the data once with plain comparisons, without any shuffle, and
* ``ordinal`` numbers each bucket on its own and adds the bucket's offset.

Both are exact for every distribution of the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def id_bucket(df: DataFrame, key: str, side: int = 64) -> Column:
    """Bucket of a whole-number key between ``side`` squared quantiles, so no bucket grows with clustered keys.

    The quantiles are read from the data first; they are looked up in two
    steps of at most ``side`` comparisons.
    """

    def listed(numbers) -> Column:
        # One literal after constant folding.
        return F.filter(F.split(F.lit(",".join(map(str, numbers))), ","), lambda x: x != "").cast("array<long>")

    steps = [i / side**2 for i in range(1, side**2)]
    shares = F.split(F.lit(",".join(map(str, steps))), ",").cast("array<double>")
    cuts = df.agg(F.percentile_approx(F.col(key).cast("long"), shares, 20 * side**2)).first()[0] or []
    spot = F.col(key)
    block = F.size(F.filter(listed(cuts[side - 1 :: side]), lambda c: c <= spot))
    inside = F.slice(listed(cuts), block * side + 1, F.lit(side))
    return (block * side + F.size(F.filter(inside, lambda c: c <= spot))).cast("int")


def _marked(df: DataFrame, key: Column, stratum: Column | None, bucket: Column) -> list[Column]:
    group = F.lit(0) if stratum is None else stratum.cast("int")
    return [group.alias("_s"), bucket.alias("_b"), key.alias("_k")]


def cut_segments(
    df: DataFrame,
    key: Column,
    cuts: Callable[[Column], list[Column]],
    *,
    stratum: Column | None = None,
    bucket: Column | None = None,
    name: str = "segment",
    prefix: int = 3,
) -> DataFrame:
    """Add the number of cut ranks that lie before each row's rank.

    ``cuts`` receives the number of rows of a stratum and returns cumulative
    ranks; with cuts (a, b) the first a rows by key get 0, rows up to rank b
    get 1 and the rest 2.  ``key`` must be unique and, unless ``bucket`` is
    given, a hex string spread evenly over its first ``prefix`` digits.
    ``stratum`` must have few values.
    """
    spot = F.substring(key, 1, prefix) if bucket is None else bucket
    narrow = df.select(*_marked(df, key, stratum, spot))
    by_group = W.partitionBy("_s")
    running = by_group.orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = (
        narrow.groupBy("_s", "_b")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_s", "_b", "n", F.sum("n").over(running).alias("upto"), F.sum("n").over(by_group).alias("total"))
    )
    ranks = F.array(*[c.cast("long") for c in cuts(F.col("total"))])
    hits = (
        counted.select("_s", "_b", "n", "upto", F.posexplode(ranks).alias("_i", "rank"))
        .filter(
            ((F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto")))
            | ((F.col("rank") <= 0) & (F.col("upto") == F.col("n")))
        )
        .select("_s", "_b", "_i", F.greatest(F.lit(0), F.col("rank") - F.col("upto") + F.col("n")).alias("place"))
    )
    # hits has at most strata x cuts rows, whatever the size of the data.
    inside = narrow.join(F.broadcast(hits.filter("place > 0")), ["_s", "_b"])
    order = W.partitionBy("_s", "_i").orderBy("_k")
    limits = (
        inside.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") == F.col("place"))
        .select("_s", "_k", F.lit(0).alias("zero"))
    )
    empty_key = F.lit(None).cast(narrow.schema["_k"].dataType)
    zeros = hits.filter("place = 0").select("_s", empty_key.alias("_k"), F.lit(1).alias("zero"))
    # One row per stratum.
    lookup = (
        limits.unionByName(zeros)
        .groupBy("_s")
        .agg(F.sum("zero").cast("int").alias("_zeros"), F.collect_list("_k").alias("_limits"))
    )
    group = F.lit(0) if stratum is None else stratum.cast("int")
    marked = df.withColumn("_s", group).join(F.broadcast(lookup), "_s", "left")
    passed = F.size(F.filter("_limits", lambda limit: key > limit))
    return marked.withColumn(name, F.coalesce(F.col("_zeros") + passed, F.lit(0))).drop("_s", "_zeros", "_limits")


def ordinal(
    df: DataFrame,
    key: Column,
    *,
    stratum: Column | None = None,
    bucket: Column | None = None,
    name: str = "ordinal",
    total: str | None = None,
    prefix: int = 4,
) -> DataFrame:
    """Add the 1-based rank of every row by ``key``, within the stratum if one is given."""
    spot = F.substring(key, 1, prefix) if bucket is None else bucket
    marked = df.select("*", *_marked(df, key, stratum, spot))
    before = W.partitionBy("_s").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("_s", "_b")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "_s",
            "_b",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"),
            F.sum("n").over(W.partitionBy("_s")).alias("_total"),
        )
    )
    # offsets has at most strata x buckets rows, whatever the size of the data.
    inner = W.partitionBy("_s", "_b").orderBy("_k")
    ranked = marked.join(F.broadcast(offsets), ["_s", "_b"]).withColumn(
        name, F.col("_offset") + F.row_number().over(inner)
    )
    if total:
        ranked = ranked.withColumn(total, F.col("_total"))
    return ranked.drop("_s", "_b", "_k", "_offset", "_total")


def count_of(df: DataFrame) -> Column:
    """Row count as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()
