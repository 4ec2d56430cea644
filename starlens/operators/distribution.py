"""Star counts, shares, deltas and class weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens import lexicon


def _star_counts(df: DataFrame, star: Column, by: tuple[str, ...]) -> DataFrame:
    """One row per star, zero where none occurs; counted in one partial aggregation."""
    counts = [F.count_if(star == s).alias(f"n{s}") for s in lexicon.STARS]
    wide = df.groupBy(*by).agg(*counts)
    cells = F.array(*[F.struct(F.lit(s).alias("star"), F.col(f"n{s}").alias("reviews")) for s in lexicon.STARS])
    return wide.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.star", "cell.reviews")


def rating_distribution(df: DataFrame, star: str = "user_rating", by: tuple[str, ...] = ()) -> DataFrame:
    return _star_counts(df, F.col(star), by)


def rating_shares(df: DataFrame, star: str = "user_rating", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts plus percentage; an empty table has shares of zero."""
    counts = [F.count_if(F.col(star) == s) for s in lexicon.STARS]
    wide = df.groupBy(*by).agg(F.array(*counts).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    cells = F.transform(
        "counts",
        lambda n, i: F.struct(
            (i + 1).alias("star"),
            n.alias("reviews"),
            (F.lit(100.0) * n / F.greatest(total, F.lit(1))).alias("share_pct"),
        ),
    )
    return wide.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.*")


def compare_distributions(train: DataFrame, test: DataFrame, star: str = "user_rating") -> DataFrame:
    """Shares of two tables side by side and the difference in percentage points."""
    left = rating_shares(train, star).withColumnsRenamed({"reviews": "train_reviews", "share_pct": "train_pct"})
    right = rating_shares(test, star).withColumnsRenamed({"reviews": "test_reviews", "share_pct": "test_pct"})
    # Five rows on each side.
    return left.join(F.broadcast(right), "star").withColumn("delta_pp", F.col("test_pct") - F.col("train_pct"))


def class_weights(
    df: DataFrame,
    star: str = "user_rating",
    classes: int = 5,
    low_star_boost: float = 1.0,
) -> DataFrame:
    """Balanced weights n / (K n_c); low classes are boosted; an absent class fails the job."""
    value = F.col(star)
    members = {
        5: [value == s for s in lexicon.STARS],
        3: [value <= 2, value == 3, value >= 4],
    }[classes]
    boosted = 2 if classes == 5 else 1
    wide = df.agg(F.array(*[F.count_if(m) for m in members]).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)

    def cell(n: Column, i: Column) -> Column:
        missing = F.raise_error(F.concat(F.lit("class without rows: "), i.cast("string")))
        weight = F.when(n > 0, total / (F.lit(classes) * n)).otherwise(missing.cast("double"))
        boost = F.when(i < boosted, F.lit(float(low_star_boost))).otherwise(F.lit(1.0))
        return F.struct(i.alias("label"), n.alias("reviews"), (weight * boost).alias("class_weight"))

    return wide.select(F.explode(F.transform("counts", cell)).alias("cell")).select("cell.*")


def sample_weights(df: DataFrame, weights: DataFrame, label: Column) -> DataFrame:
    """Look up the class weight of every row (the weight table has one row per class)."""
    return df.withColumn("label", label.cast("int")).join(
        F.broadcast(weights.select("label", "class_weight")), "label"
    )
