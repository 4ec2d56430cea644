"""Profile of one data set, and the comparison of two."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.operators import clean, distribution, profile
from starlens.params import Params
from starlens.session import stage


@dataclass(frozen=True)
class Profile:
    summary: DataFrame
    top_tokens: DataFrame
    token_overlap: DataFrame
    samples: DataFrame


def profile_dataset(df: DataFrame, params: Params = Params(), name: str | None = None) -> Profile:
    """``df``: normalised (review_id, text, user_rating).

    ``summary`` is a long table (item, star, value).  The cleaned table is
    written once, because five passes read it.
    """
    kept = stage(clean.clean_reviews(df, params.min_text_length, params.duplicate_keep))
    first = df.agg(F.count(F.lit(1)).cast("double").alias("initial_rows")).select(
        F.explode(F.array(F.struct(F.lit("initial_rows").alias("item"), F.col("initial_rows").alias("value")))).alias("r")
    )
    whole = kept.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("final_rows").alias("item"), "value")
    ratios = profile.script_ratios(kept).select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in ("thai_ratio", "latin_ratio")])
        ).alias("r")
    )
    totals = first.select("r.*").unionByName(whole).unionByName(ratios.select("r.*")).withColumn("star", F.lit(""))

    def by_star(table: DataFrame, columns: dict[str, str], digits: int) -> DataFrame:
        pairs = [
            F.struct(F.lit(item).alias("item"), F.round(F.col(c).cast("double"), digits).alias("value"))
            for item, c in columns.items()
        ]
        return table.select(F.col("star").cast("string").alias("star"), F.explode(F.array(*pairs)).alias("r")).select("star", "r.*")

    shares = by_star(distribution.rating_shares(kept), {"star_count": "reviews", "star_pct": "share_pct"}, 2)
    lengths = by_star(profile.length_stats(kept), {"length_median": "median", "length_p90": "p90"}, 4)
    top = profile.top_tokens(profile.star_tokens(kept))
    summary = totals.unionByName(shares).unionByName(lengths).select("item", "star", "value")
    if name:
        summary = summary.withColumn("dataset", F.lit(name))
    return Profile(summary, top, profile.token_overlap(top), profile.sample_reviews(kept))


def compare_datasets(left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    """Vocabulary coverage, tokens only the left knows, and share deltas of two cleaned tables."""
    own, other = profile.vocabulary(left), profile.vocabulary(right)
    return {
        "coverage": profile.vocabulary_coverage(own, other),
        "only_left": profile.vocabulary_only(own, other),
        "share_delta": distribution.compare_distributions(right, left),
    }
