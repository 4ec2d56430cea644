"""From raw review tables to the standard table (text, user_rating, ...)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens import lexicon
from starlens.functions import ratings, text as T
from starlens.operators.once import compute_once


def pick_column(columns: Sequence[str], aliases: Sequence[str], kind: str) -> str:
    """The first column, in file order, whose lower-case name is an alias."""
    known = {a.lower() for a in aliases}
    for name in columns:
        if name.lower() in known:
            return name
    raise ValueError(f"no {kind} column: expected one of {tuple(aliases)}, got {list(columns)}")


def resolve_columns(df: DataFrame) -> DataFrame:
    """Rename the text and rating columns to ``text`` and ``user_rating``; keep id and place."""
    text = pick_column(df.columns, lexicon.TEXT_ALIASES, "text")
    rating = pick_column(df.columns, lexicon.RATING_ALIASES, "rating")
    kept = [F.col(c) for c in ("review_id",) if c in df.columns]
    kept += [F.col(f"`{text}`").alias("text"), F.col(f"`{rating}`").alias("user_rating")]
    kept += [F.col(c) for c in ("place_name",) if c in df.columns]
    return df.select(*kept)


def coerce_ratings(df: DataFrame) -> DataFrame:
    """Unparsable ratings are dropped, the others rounded half to even."""
    parsed = df.withColumn("user_rating", ratings.parse_rating(F.col("user_rating")))
    return parsed.filter(F.col("user_rating").isNotNull()).withColumn(
        "user_rating", ratings.round_star(F.col("user_rating"))
    )


def require_range(df: DataFrame) -> DataFrame:
    """Fail the job when a star lies outside 1..5."""
    star = F.col("user_rating")
    message = F.concat(F.lit("user_rating must be 1..5, found "), star.cast("string"))
    checked = F.when(ratings.in_range(star), star).otherwise(F.raise_error(message).cast("int"))
    return df.withColumn("user_rating", checked)


def split_range(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows inside 1..5 and the quarantined rest."""
    inside = ratings.in_range(F.col("user_rating"))
    return df.filter(inside), df.filter(~inside)


def standardise(
    df: DataFrame,
    normaliser: Callable[[Column], Column] = T.extended,
    on_invalid: str = "raise",
) -> DataFrame:
    """Aliases, ratings, range and text normalisation without a shuffle."""
    out = coerce_ratings(resolve_columns(df))
    if on_invalid == "raise":
        out = require_range(out)
    elif on_invalid == "drop":
        out = split_range(out)[0]
    else:
        raise ValueError(f"unknown on_invalid: {on_invalid}")
    return compute_once(out, "text", normaliser(F.col("text")))
