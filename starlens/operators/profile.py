"""Dataset profiling: scripts, lengths, tokens, vocabularies, samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starlens import lexicon
from starlens.functions import text as T

THAI = r"[\x{0E00}-\x{0E7F}]"
LATIN = r"[A-Za-z]"


def review_tokens(text: Column) -> Column:
    """Tokens of the extended-normalised text."""
    return T.tokens(T.extended(text))


def script_ratios(df: DataFrame, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """Share of Thai and of Latin characters, four decimals, zero for empty tables."""
    summed = df.groupBy(*by).agg(
        F.coalesce(F.sum(T.count_matches(F.col(text), THAI)), F.lit(0)).alias("_thai"),
        F.coalesce(F.sum(T.count_matches(F.col(text), LATIN)), F.lit(0)).alias("_latin"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("_all"),
    )
    whole = F.greatest(F.col("_all"), F.lit(1))
    return summed.select(
        *by,
        F.round(F.col("_thai") / whole, 4).alias("thai_ratio"),
        F.round(F.col("_latin") / whole, 4).alias("latin_ratio"),
    )


def length_stats(df: DataFrame, text: str = "text", star: str = "user_rating") -> DataFrame:
    """(star, n, median, p90) with linear interpolation, zeros for absent stars.

    Lengths are counted per (star, length) first, so the percentile works on
    the distinct lengths only.
    """
    lengths = df.groupBy(F.col(star).alias("star"), F.length(text).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.groupBy("star").agg(
        F.sum("n").alias("n"),
        F.percentile("size", F.lit(0.5), F.col("n")).alias("median"),
        F.percentile("size", F.lit(0.9), F.col("n")).alias("p90"),
    )
    stars = df.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("star"))
    return stars.join(F.broadcast(found), "star", "left").fillna(0, ["n", "median", "p90"])


def star_tokens(
    df: DataFrame,
    star: str = "user_rating",
    text: str = "text",
    tokenizer: Callable[[Column], Column] = review_tokens,
) -> DataFrame:
    """(star, token, tokens): frequency of tokens longer than one character."""
    words = df.select(F.col(star).alias("star"), F.explode(tokenizer(F.col(text))).alias("token"))
    return words.filter(F.length("token") > 1).groupBy("star", "token").agg(F.count(F.lit(1)).alias("uses"))


def top_tokens(counted: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent tokens of every star, ties by token."""
    order = W.partitionBy("star").orderBy(F.col("uses").desc(), "token")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def token_overlap(top: DataFrame, pairs: Sequence[tuple[int, int]] = ((3, 4), (3, 5), (4, 5))) -> DataFrame:
    """Jaccard similarity of the top tokens of star pairs, four decimals.

    ``top`` holds at most k tokens per star.
    """
    sets = top.agg(
        *[F.collect_set(F.when(F.col("star") == s, F.col("token"))).alias(f"s{s}") for s in lexicon.STARS]
    )
    rows = []
    for a, b in pairs:
        shared = F.size(F.array_intersect(f"s{a}", f"s{b}"))
        union = F.greatest(F.size(F.array_union(f"s{a}", f"s{b}")), F.lit(1))
        rows.append(F.struct(F.lit(f"{a}_{b}").alias("pair"), F.round(shared / union, 4).alias("jaccard")))
    return sets.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def vocabulary(
    df: DataFrame,
    text: str = "text",
    tokenizer: Callable[[Column], Column] = review_tokens,
) -> DataFrame:
    """Distinct tokens."""
    return df.select(F.explode(tokenizer(F.col(text))).alias("token")).distinct()


def vocabulary_coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """Share of the left vocabulary that the right one knows, four decimals."""
    # One grouping over both vocabularies instead of an intersection and two counts.
    marked = left.select("token", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("token", F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = marked.groupBy("token").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    summed = sides.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_vocabulary"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_vocabulary"),
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("shared"),
    )
    share = F.round(F.col("shared") / F.greatest(F.col("left_vocabulary"), F.lit(1)), 4)
    return summed.withColumn("coverage", share)


def vocabulary_only(left: DataFrame, right: DataFrame, k: int = 30) -> DataFrame:
    """First k tokens, in order, that only the left vocabulary has."""
    return left.join(right, "token", "left_anti").orderBy("token").limit(k)


def first_per_star(
    df: DataFrame, k: int, star: str = "user_rating", id_col: str = "review_id"
) -> DataFrame:
    """First k reviews of every star in file order (pruned on the map side)."""
    order = W.partitionBy(star).orderBy(id_col)
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def sample_reviews(df: DataFrame, per_star: int = 2, chars: int = 200, star: str = "user_rating", id_col: str = "review_id") -> DataFrame:
    """A few reviews per star for the report, shown with their first characters."""
    few = first_per_star(df.select(id_col, star, "text"), per_star, star, id_col)
    return few.withColumn("text", F.substring("text", 1, chars))
