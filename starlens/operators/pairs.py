"""Training examples for embedding fine-tuning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions.hashing import hash_int, hash_key
from starlens.operators import ranking


def supervised_examples(df: DataFrame, star: str = "user_rating") -> DataFrame:
    """(text, label) with labels 0..4."""
    return df.select("review_id", "text", (F.col(star) - 1).alias("label"))


def triplet_ids(
    df: DataFrame,
    seed: int = 42,
    pairs_per_row: int = 1,
    star: str = "user_rating",
    id_col: str = "review_id",
) -> DataFrame:
    """(anchor_id, pair, positive_id, negative_id).

    The positive is any row of the anchor's star, the negative any row of a
    star drawn uniformly from the others.  Rows are numbered per star, so a
    draw is one equi-join on (star, number) with exactly one partner.
    """
    key = hash_key(seed, F.col(id_col))
    numbered = ranking.ordinal(
        df.select(F.col(id_col).alias("id"), F.col(star).cast("int").alias("star")),
        hash_key(seed, F.col("id")),
        stratum=F.col("star"),
        name="number",
        prefix=3,
    )
    sizes = (
        df.groupBy(F.col(star).cast("int").alias("star"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.sort_array(F.collect_list(F.struct("star", "n"))).alias("sizes"))
        .scalar()
    )
    anchors = df.select(
        F.col(id_col).alias("anchor_id"),
        F.col(star).cast("int").alias("star"),
        F.explode(F.sequence(F.lit(0), F.lit(pairs_per_row - 1))).alias("pair"),
        sizes.alias("sizes"),
    )
    place = [F.col("anchor_id"), F.col("pair")]
    others = F.filter("sizes", lambda s: s["star"] != F.col("star"))
    own = F.filter("sizes", lambda s: s["star"] == F.col("star"))[0]
    other = F.element_at("others", (hash_int(f"{seed}:star", *place) % F.size("others") + 1).cast("int"))
    drawn = (
        anchors.withColumn("others", others)
        .filter(F.size("others") > 0)
        .withColumn("positive_number", hash_int(f"{seed}:positive", *place) % own["n"] + 1)
        .withColumn("other", other)
        .withColumn("negative_number", hash_int(f"{seed}:negative", *place) % F.col("other.n") + 1)
        .select("anchor_id", "pair", "star", "positive_number", F.col("other.star").alias("other_star"), "negative_number")
    )
    positive = numbered.select(
        "star", F.col("number").alias("positive_number"), F.col("id").alias("positive_id")
    )
    negative = numbered.select(
        F.col("star").alias("other_star"), F.col("number").alias("negative_number"), F.col("id").alias("negative_id")
    )
    return (
        drawn.join(positive, ["star", "positive_number"])
        .join(negative, ["other_star", "negative_number"])
        .select("anchor_id", "pair", "positive_id", "negative_id")
    )


def triplet_texts(ids: DataFrame, df: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Put the three texts next to the ids."""
    out = ids
    for part in ("anchor", "positive", "negative"):
        texts = df.select(F.col(id_col).alias(f"{part}_id"), F.col("text").alias(f"{part}_text"))
        out = out.join(texts, f"{part}_id")
    return out
