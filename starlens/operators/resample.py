"""Splits, folds, samples and replication, all exact and reproducible.

Random order means the order of md5(seed:id), so results do not depend on the
number of partitions.  Sampling never sorts the data (see ``ranking``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions.hashing import hash_key
from starlens.operators import ranking


def _share(fraction: float, total: Column) -> Column:
    return F.bround(F.lit(float(fraction)) * total, 0).cast("long")


def holdout_split(
    df: DataFrame,
    fraction: float = 0.2,
    seed: int = 42,
    star: str = "user_rating",
    id_col: str = "review_id",
) -> DataFrame:
    """Per star: ``fraction`` to holdout, ``fraction`` of the rest to validation, the rest to train."""

    def cuts(total: Column) -> list[Column]:
        holdout = _share(fraction, total)
        return [holdout, holdout + _share(fraction, total - holdout)]

    marked = ranking.cut_segments(df, hash_key(seed, F.col(id_col)), cuts, stratum=F.col(star), name="_segment")
    names = F.array(F.lit("holdout"), F.lit("validation"), F.lit("train"))
    return marked.withColumn("split", F.element_at(names, F.col("_segment") + 1)).drop("_segment")


def kfold(
    df: DataFrame,
    folds: int = 5,
    seed: int = 42,
    star: str = "user_rating",
    id_col: str = "review_id",
) -> DataFrame:
    """Stratified folds 0..k-1 whose sizes per star differ by at most one."""

    def cuts(total: Column) -> list[Column]:
        base, extra = F.floor(total / folds), total % folds
        return [base * f + F.least(F.lit(f), extra) for f in range(1, folds)]

    return ranking.cut_segments(df, hash_key(seed, F.col(id_col)), cuts, stratum=F.col(star), name="fold")


def undersample_star(
    df: DataFrame,
    star_value: int = 4,
    keep_fraction: float = 1.0,
    seed: int = 42,
    star: str = "user_rating",
    id_col: str = "review_id",
) -> DataFrame:
    """Keep exactly round(f n) rows of one star and everything else."""
    if keep_fraction >= 1.0:
        return df
    chosen = F.col(star) == star_value
    marked = ranking.cut_segments(
        df,
        hash_key(seed, F.col(id_col)),
        lambda total: [_share(keep_fraction, total)],
        stratum=chosen.cast("int"),
        name="_segment",
    )
    return marked.filter(~chosen | (F.col("_segment") == 0)).drop("_segment")


def sample_rows(df: DataFrame, rows: int | Column, seed: int = 42, id_col: str = "review_id") -> DataFrame:
    """Exactly ``rows`` rows (all of them if there are fewer); may depend on a scalar subquery."""
    wanted = F.lit(rows) if isinstance(rows, int) else rows
    marked = ranking.cut_segments(df, hash_key(seed, F.col(id_col)), lambda total: [wanted], name="_segment")
    return marked.filter("_segment = 0").drop("_segment")


def shuffle_rows(df: DataFrame, seed: int = 42, id_col: str = "review_id") -> DataFrame:
    """Position of every row in the shuffled order; write it out sorted by that position."""
    return ranking.ordinal(df, hash_key(seed, F.col(id_col)), name="position")


def stratified_reduce(
    df: DataFrame,
    target_rows: int = 10000,
    seed: int = 42,
    star: str | None = "user_rating",
    id_col: str = "review_id",
) -> DataFrame:
    """About ``target_rows`` rows with the shares of every star kept; a small table stays whole."""
    if star is None:
        return sample_rows(df, target_rows, seed, id_col)
    everything = ranking.count_of(df)

    def cuts(total: Column) -> list[Column]:
        fraction = F.lit(float(target_rows)) / everything
        return [F.when(everything <= target_rows, total).otherwise(F.bround(fraction * total, 0).cast("long"))]

    marked = ranking.cut_segments(df, hash_key(seed, F.col(id_col)), cuts, stratum=F.col(star), name="_segment")
    return marked.filter("_segment = 0").drop("_segment")


def oversample_low_stars(
    df: DataFrame,
    factor: int = 3,
    low_stars: tuple[int, ...] = (1, 2),
    star: str = "user_rating",
) -> DataFrame:
    """Rows of low stars appear ``factor`` times; ``copy`` numbers the copies from 0."""
    copies = F.when(F.col(star).isin(*low_stars), F.lit(max(int(factor), 1))).otherwise(F.lit(1))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))


def mix_mock(
    reviews: DataFrame,
    mock: DataFrame | None,
    fraction: float,
    seed: int = 42,
    id_col: str = "review_id",
) -> DataFrame:
    """Add min(max(1, floor(n f)), n_mock) rows of a second, cleaned table."""
    if mock is None or fraction <= 0:
        return reviews
    n = ranking.count_of(reviews)
    wanted = F.greatest(F.lit(1).cast("long"), F.floor(n * F.lit(float(fraction))))
    return reviews.unionByName(sample_rows(mock, wanted, seed, id_col), allowMissingColumns=True)


def union_sources(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns missing in one are null there."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def first_rows_split(df: DataFrame, share: float = 0.2, floor: int = 200, id_col: str = "review_id") -> DataFrame:
    """Positional split: the first max(floor, share n) rows are test, the rest train."""
    marked = ranking.cut_segments(
        df,
        F.col(id_col),
        lambda total: [F.greatest(F.lit(floor).cast("long"), F.floor(total * F.lit(share)))],
        bucket=ranking.id_bucket(df, id_col),
        name="_segment",
    )
    return marked.withColumn("split", F.when(F.col("_segment") == 0, "test").otherwise("train")).drop("_segment")
