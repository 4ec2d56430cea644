"""Venues: assignment, ids, first reviews, rollups and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starlens.functions import ratings
from starlens.operators import ranking


def assign_venues(
    df: DataFrame,
    venues: int | None = None,
    per_venue: int = 5,
    limit: int = 8,
    id_col: str = "review_id",
    name: str = "place_name",
) -> DataFrame:
    """Deal reviews out to min(8, max(1, n // 5)) venues in file order."""
    if venues is None:
        n = ranking.count_of(df)
        many = F.least(F.lit(limit).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(n / per_venue)))
    else:
        many = F.lit(venues).cast("long")
    # A column, so that the scalar subquery is read once.
    numbered = ranking.ordinal(df, F.col(id_col), bucket=ranking.id_bucket(df, id_col), name="_n")
    slot = (F.col("_n") - 1) % many + 1
    return numbered.withColumn(name, F.concat(F.lit("ร้านที่ "), slot.cast("string"))).drop("_n")


def first_per_venue(df: DataFrame, k: int = 5, id_col: str = "review_id") -> DataFrame:
    """First k reviews of every venue; reviews without a venue are dropped.

    The rank filter is pruned on the map side, so a hot venue sends at most k
    rows per task.
    """
    order = W.partitionBy("place_name").orderBy(id_col)
    known = df.filter(F.col("place_name").isNotNull())
    return known.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def surviving_venues(df: DataFrame, survivors: DataFrame) -> DataFrame:
    """Reviews whose venue occurs among the survivors."""
    return df.join(survivors.select("place_name").distinct(), "place_name", "left_semi")


def venue_ids(df: DataFrame, id_col: str = "review_id") -> DataFrame:
    """(place_name, restaurant_id): venues numbered by first appearance."""
    named = df.filter(F.col("place_name").isNotNull() & (F.col("place_name") != ""))
    first = named.groupBy("place_name").agg(F.min(id_col).alias("_first"))
    numbered = ranking.ordinal(
        first, F.col("_first"), bucket=ranking.id_bucket(first, "_first"), name="restaurant_id"
    )
    return numbered.drop("_first")


def attach_venue_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Join on the venue name; adaptive execution picks the strategy and splits hot venues."""
    return df.join(ids, "place_name")


def rollup(scored: DataFrame, by: str = "place_name") -> DataFrame:
    """Averages, counts and colour per venue, pre-aggregated before the shuffle."""
    delta = ratings.rating_delta(F.col("user_rating"), F.col("ai_expected_rating"))
    sums = (
        scored.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(
            F.avg("user_rating").alias("_user"),
            F.avg("ai_expected_rating").alias("_ai"),
            F.count(F.lit(1)).alias("review_count"),
            F.count_if("is_anomaly").alias("anomaly_count"),
            F.avg(delta).alias("mean_delta"),
            F.max(delta).alias("max_delta"),
        )
    )
    return sums.select(
        by,
        F.round("_user", 2).alias("avg_user_rating"),
        F.round("_ai", 2).alias("avg_ai_rating"),
        "review_count",
        "anomaly_count",
        (F.col("anomaly_count") > 0).alias("has_anomaly"),
        ratings.venue_color(F.col("_ai")).alias("ai_hex_color"),
        "mean_delta",
        "max_delta",
    )


def nest_reviews(venues: DataFrame, reviews: DataFrame, k: int = 5, id_col: str = "review_id") -> DataFrame:
    """Venues with a ``reviews`` array of their first k reviews (k bounds the array)."""
    held = first_per_venue(reviews, k, id_col)
    fields = [id_col, *[c for c in held.columns if c not in (id_col, "place_name")]]
    arrays = held.groupBy("place_name").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("reviews"))
    return venues.join(arrays, "place_name", "left")


def city_counters(venues: DataFrame) -> DataFrame:
    """Tracked venues, venues with an anomaly and the overall divergence."""
    weighted = F.sum(F.col("mean_delta") * F.col("review_count"))
    return venues.agg(
        F.count(F.lit(1)).alias("tracked_venues"),
        F.count_if("has_anomaly").alias("venues_with_anomaly"),
        F.coalesce(F.sum("review_count"), F.lit(0)).alias("reviews"),
        (weighted / F.sum("review_count")).alias("mean_delta"),
        F.max("max_delta").alias("max_delta"),
    )


def search(venues: DataFrame, text: str, columns: tuple[str, ...] = ("name", "cuisine")) -> DataFrame:
    """Case-insensitive part of the name or the cuisine."""
    needle = text.lower()
    hit: Column = F.lit(False)
    for column in columns:
        hit = hit | F.lower(column).contains(needle)
    return venues.filter(hit)


def by_id(venues: DataFrame, restaurant_id: int) -> DataFrame:
    return venues.filter(F.col("restaurant_id") == restaurant_id)


def list_view(venues: DataFrame) -> DataFrame:
    """Venues without their nested reviews."""
    return venues.drop("reviews")
