"""Score reviews, rate their aspects and flag anomalies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions import ratings as R
from starlens.operators import aspects, hooks, linear, vectorise
from starlens.operators.features import FeatureModel
from starlens.operators.learners import StarModel
from starlens.operators.once import compute_once
from starlens.params import Params
from starlens.session import stage


@dataclass(frozen=True)
class LinearModel:
    """Vocabulary (term, idf), coefficients (term, coef array) and intercepts."""

    vocabulary: DataFrame
    coefficients: DataFrame
    intercepts: Sequence[float]


@dataclass(frozen=True)
class TrainedModel:
    """Fitted vectorisers and the classifier that reads their features."""

    features: FeatureModel
    stars: StarModel


#: The third kind loads a user's model in each task, see ``hooks.score_with``.
Scorer = LinearModel | TrainedModel | Callable[[], Callable]


def rate_rows(df: DataFrame, model: TrainedModel | Callable[[], Callable], text: str = "text") -> DataFrame:
    """Add ``probs`` (not in regression mode) and ``ai_expected_rating`` in the scan stage, without a shuffle."""
    if isinstance(model, TrainedModel):
        return model.stars.predict(model.features.transform(df, text)).drop("features")
    return hooks.score_with(df, model, text)


def rate_texts(docs: DataFrame, model: Scorer, keys: Sequence[str], text: str = "text") -> DataFrame:
    """(keys, probs, ai_expected_rating) of every text, within the partitioning of ``docs``."""
    if not isinstance(model, LinearModel):
        rated = rate_rows(docs.select(*keys, text), model, text)
        return rated.drop(text)
    classes = len(model.intercepts)
    terms = vectorise.word_terms(docs, keys, text, marker=True)
    summed = linear.unit_logits(terms, model.vocabulary, model.coefficients, keys, classes)
    probs = linear.probabilities(model.intercepts, classes)
    return compute_once(summed, "probs", probs).select(
        *keys, "probs", R.expected_rating(F.col("probs")).alias("ai_expected_rating")
    )


def flag(scored: DataFrame, threshold: float = 2.0) -> DataFrame:
    user, expected = F.col("user_rating"), F.col("ai_expected_rating")
    return scored.withColumns(
        {
            "ai_hex_color": R.star_color(expected),
            "delta": R.rating_delta(user, expected),
            "is_anomaly": R.is_anomaly(user, expected, threshold),
        }
    )


def score_reviews(reviews: DataFrame, model: Scorer, params: Params = Params(), skip_aspects: bool = False) -> DataFrame:
    """Cleaned reviews (review_id, text, user_rating, ...) to scored reviews.

    The input is written first, because whole texts, their sentences and the
    output columns are several passes over it.  For a linear model the texts
    are partitioned by review_id once; term counts, sentence ratings, aspect
    means and the joins back all stay in that partitioning.  Trained and
    user's models rate texts and sentences where they are read; only the join
    with the aspect means moves rows.
    """
    docs = stage(reviews)
    if isinstance(model, LinearModel):
        docs = vectorise.by_document(docs)
        scored = docs.join(rate_texts(docs, model, ("review_id",)), "review_id")
    else:
        scored = rate_rows(docs, model)
    if not skip_aspects:
        sentences = aspects.aspect_sentences(docs.select("review_id", "text"))
        # A sentence of two aspects is rated once per aspect, as one row each.
        rated = rate_texts(sentences, model, ("review_id", "place", "aspect"), "sentence")
        scored = aspects.attach_aspects(scored, aspects.aspect_averages(rated))
    return flag(scored, params.anomaly_threshold)
