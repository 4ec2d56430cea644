"""Evaluate stored predictions of several models in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.functions import text as T
from starlens.operators import metrics as M
from starlens.operators import resample
from starlens.params import Params
from starlens.session import stage
from starlens.sources import registry, results


@dataclass(frozen=True)
class Evaluation:
    metrics: DataFrame
    confusion: DataFrame
    champion: DataFrame
    report: DataFrame


def evaluate(predictions: DataFrame, params: Params = Params()) -> Evaluation:
    """Metrics of every model and of the constant-star reference, champion and report.

    ``predictions``: (model, model_order, user_rating, ai_expected_rating, ...).
    The reference takes part in the report, not in the choice of the champion.
    """
    options = {"threshold": params.anomaly_threshold, "min_delta": params.severe_delta}
    # One row per model; everything below is derived from it, so the predictions are read once.
    own = stage(M.counts(predictions, ("model", "model_order"), **options))
    first = own.orderBy("model_order", "model").limit(1).withColumn("model", F.lit("majority"))
    wide = own.unionByName(M.constant_counts(first, params.majority_star, **options))
    metrics = M.bundle_of(wide)
    contenders = M.bundle_of(own, ("model", "model_order"))
    confusion = M.confusion_of(wide)
    best = M.champion(contenders, params.champion_metric)
    report = results.report_document(metrics, confusion, best)
    return Evaluation(metrics, confusion, best, report)


def evaluate_stored(
    spark: SparkSession, names: Sequence[str], root: str, rows: DataFrame, requested: Sequence[str] | None = None, params: Params = Params()
) -> tuple[Evaluation, DataFrame]:
    """Evaluate the models below ``root`` that are ready, and name those that were asked for but are not.

    ``rows``: (review_id, user_rating) with ``text`` for models that bring their
    vectorisers and ``features`` for those that do not.  Texts are normalised
    by the strategy that the model was trained with.
    """
    ready, skipped = registry.resolve_models(registry.readiness(spark, names, root), requested)
    found = {r["model"] for r in ready.collect()}  # one row per known model
    if not found:
        raise ValueError(f"no model below {root} is ready")
    parts = []
    for place, name in enumerate(n for n in names if n in found):
        vectoriser, model = registry.load_model(spark, name, root)
        own = rows
        if vectoriser is not None:
            meta = registry.load_meta(spark, name, root).first().asDict()
            normalise = T.strategy(T.strategy_for_model(name, meta))
            own = vectoriser.transform(rows.select("review_id", "user_rating", normalise(F.col("text")).alias("text")))
        rated = model.predict(own).select("review_id", "user_rating", "ai_expected_rating")
        parts.append(rated.withColumns({"model": F.lit(name), "model_order": F.lit(place)}))
    return evaluate(resample.union_sources(*parts), params), skipped
