"""Aspect-based sentiment: which sentence speaks of which aspect, and how it rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens import lexicon
from starlens.functions import text as T


def mentions(sentence: Column, keywords: Sequence[str]) -> Column:
    """True if any keyword is part of the sentence."""
    hit = F.lit(False)
    for word in keywords:
        hit = hit | sentence.contains(word)
    return hit


def aspect_sentences(
    df: DataFrame,
    keys: Sequence[str] = ("review_id",),
    text: str = "text",
    aspects: Mapping[str, Sequence[str]] = lexicon.ASPECT_KEYWORDS,
) -> DataFrame:
    """(keys, place, sentence, aspect), one row per sentence and matching aspect.

    Splitting and the keyword test are generated code in the scan stage;
    sentences without an aspect are dropped there.
    """
    sentence = F.col("sentence")
    sentences = df.select(*keys, F.posexplode(T.blank_split(F.col(text))).alias("place", "sentence")).filter(
        mentions(sentence, [w for words in aspects.values() for w in words])
    )
    named = [F.when(mentions(sentence, words), F.lit(name)) for name, words in aspects.items()]
    return sentences.withColumn("aspect", F.explode(F.array_compact(F.array(*named))))


def aspect_averages(
    scored: DataFrame,
    keys: Sequence[str] = ("review_id",),
    rating: str = "ai_expected_rating",
    aspects: Sequence[str] = lexicon.ASPECTS,
) -> DataFrame:
    """(keys, aspect_*): mean rating of the sentences of each aspect, null where none."""
    means = [F.avg(F.when(F.col("aspect") == a, F.col(rating))).alias(f"aspect_{a}") for a in aspects]
    return scored.groupBy(*keys).agg(*means)


def attach_aspects(
    reviews: DataFrame,
    averages: DataFrame,
    keys: Sequence[str] = ("review_id",),
    rating: str = "ai_expected_rating",
    aspects: Sequence[str] = lexicon.ASPECTS,
) -> DataFrame:
    """Reviews with their aspect ratings; an aspect not spoken of takes the review's rating."""
    joined = reviews.join(averages, list(keys), "left")
    filled = {f"aspect_{a}": F.coalesce(F.col(f"aspect_{a}"), F.col(rating)) for a in aspects}
    return joined.withColumns(filled)
