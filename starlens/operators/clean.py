"""Cleaning: empty, short and duplicate reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def text_digest(text: Column) -> Column:
    """32 bytes standing for the text, so that keys stay small in shuffles and sorts."""
    return F.unhex(F.sha2(text, 256))


def drop_empty(df: DataFrame) -> DataFrame:
    return df.filter(F.length("text") > 0)


def drop_short(df: DataFrame, min_length: int = 5) -> DataFrame:
    return df.filter(F.length("text") >= min_length)


def drop_duplicates(df: DataFrame, keep: str = "first", order: str = "review_id") -> DataFrame:
    """Keep the first, the last or no row of every group of equal texts.

    The rank filter is pruned before the shuffle (window group limit), so a
    text that makes up a third of the data leaves each map task as one or two
    rows.
    """
    keyed = df.withColumn("_digest", text_digest(F.col("text")))
    group = W.partitionBy("_digest")
    if keep in ("first", "last"):
        ordered = group.orderBy(F.col(order).asc() if keep == "first" else F.col(order).desc())
        out = keyed.withColumn("_n", F.row_number().over(ordered)).filter("_n = 1")
    elif keep == "none":
        two = keyed.withColumn("_n", F.row_number().over(group.orderBy(order))).filter("_n <= 2")
        out = two.withColumn("_n", F.count(F.lit(1)).over(group)).filter("_n = 1")
    else:
        raise ValueError(f"keep must be first, last or none, not {keep}")
    return out.drop("_digest", "_n")


def clean_reviews(df: DataFrame, min_length: int = 5, keep: str | None = "first") -> DataFrame:
    out = drop_short(drop_empty(df), min_length)
    return out if keep is None else drop_duplicates(out, keep)


def cleaning_stats(df: DataFrame, min_length: int = 5, keep: str | None = "first", by: tuple[str, ...] = ()) -> DataFrame:
    """Sequential counters: empty, then short among the rest, then duplicates among the rest."""
    size = F.length("text")
    kind = F.when(size == 0, "empty").when(size < min_length, "short").otherwise("kept")
    digest = F.when(size >= F.lit(max(min_length, 1)), text_digest(F.col("text")))
    groups = df.groupBy(*by, kind.alias("kind"), digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    surplus = {
        None: F.lit(0),
        "first": F.col("n") - 1,
        "last": F.col("n") - 1,
        "none": F.when(F.col("n") > 1, F.col("n")).otherwise(0),
    }[keep]

    def rows(name: str, value: Column = F.col("n")) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == name, value)), F.lit(0))

    counted = groups.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("initial_rows"),
        rows("empty").alias("removed_empty"),
        rows("short").alias("removed_short"),
        rows("kept", surplus).alias("removed_duplicate"),
    )
    removed = F.col("removed_empty") + F.col("removed_short") + F.col("removed_duplicate")
    return counted.withColumn("final_rows", F.col("initial_rows") - removed)
