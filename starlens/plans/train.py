"""Train, compare, search and sweep star models.

The loops below run on the driver over a handful of configurations; every
iteration is a set of distributed Spark jobs over the same staged features.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions import ratings as R
from starlens.operators import boosting
from starlens.operators import features as FE
from starlens.operators import learners as L
from starlens.operators import metrics as M
from starlens.operators import resample, stacked
from starlens.params import Params
from starlens.session import stage


@dataclass(frozen=True)
class Comparison:
    models: dict[str, L.StarModel]
    predictions: DataFrame
    metrics: DataFrame
    best: str


def _labelled(df: DataFrame, params: Params) -> DataFrame:
    """Rows as the learners read them; written once, because every fit passes over them many times."""
    return stage(L.with_training_columns(df, params).select("features", "label", "weight"), "")


def compare_families(
    train: DataFrame,
    validation: DataFrame,
    params: Params = Params(),
    families: Sequence[str] = L.FAMILIES,
    evaluation: DataFrame | None = None,
) -> Comparison:
    """Fit every family on (features, user_rating), keep the lowest validation MAE (first wins ties).

    Calibration and early stopping use ``validation``; give a separate
    ``evaluation`` set to score on rows no model has seen.
    """
    rows, others = _labelled(train, params), _labelled(validation, params)
    judged = validation if evaluation is None else evaluation
    models, parts = {}, []
    together = [f for f in families if f in LINEAR]
    if len(together) > 1 and params.mode != "regression":
        models = _fit_linear_families(rows, others, params, together)
    for order, family in enumerate(families):
        if family not in models:
            models[family] = L.fit(family, rows, others, params)
        scored = models[family].predict(judged).select(
            F.lit(family).alias("model"), F.lit(order).alias("model_order"), "review_id", "user_rating", "ai_expected_rating"
        )
        parts.append(scored)
    predictions = resample.union_sources(*parts)
    metrics = stage(M.bundle(predictions, ("model", "model_order")))
    best = M.champion(metrics, "mae").first()["best_model"]
    return Comparison(models, predictions, metrics, best)


#: Families whose models are trained together.
LINEAR = ("logistic", "svm")

_ROUNDS = {"logistic": "lr_max_iter", "svm": "svm_max_iter"}


def _plan(family: str, groups, params: Params, class_weight=None) -> stacked.Plan:
    return stacked.Plan(
        family, frozenset(groups), L.CLASSES[params.mode], params.linear_strength, getattr(params, _ROUNDS[family]), class_weight
    )


def _fit_linear_families(rows: DataFrame, others: DataFrame, params: Params, families: Sequence[str]) -> dict[str, L.StarModel]:
    """The linear families in one stack; the sigmoids learn from ``others``."""
    table = stacked.blocks(rows.withColumn("part", F.lit(0)).unionByName(others.withColumn("part", F.lit(1))))
    made = stacked.fit_families(table, [_plan(f, {0}, params) for f in families], [frozenset({1})] * len(families))
    return {f: L.StarModel(f, params.mode, stages) for f, stages in zip(families, made)}


def validation_mae(model: L.StarModel, rows: DataFrame) -> DataFrame:
    """MAE of the expected rating of one model."""
    return M.bundle(model.predict(rows), ()).select("mae")


def split_features(df: DataFrame, params: Params = Params()) -> dict[str, DataFrame]:
    """Holdout, validation and train parts of a staged feature table."""
    split = stage(resample.holdout_split(df, params.holdout_fraction, params.seed), "review_id")
    return {name: split.filter(F.col("split") == name).drop("split") for name in ("train", "validation", "holdout")}


def train_on_texts(
    df: DataFrame,
    params: Params = Params(),
    families: Sequence[str] = L.FAMILIES,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[FE.FeatureModel, Comparison]:
    """Reviews (review_id, text, user_rating): split, ``prepare`` and vectorise on train only, compare on holdout."""
    parts = split_features(df.select("review_id", "text", "user_rating"), params)
    if prepare is not None:
        parts["train"] = stage(prepare(parts["train"]).select("review_id", "text", "user_rating"))
    vectoriser = FE.fit_features(parts["train"], params)
    ready = {n: stage(vectoriser.transform(p).select("review_id", "user_rating", "features")) for n, p in parts.items()}
    return vectoriser, compare_families(ready["train"], ready["validation"], params, families, ready["holdout"])


def cross_validate(df: DataFrame, params: Params, family: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(fold, metrics): every fold is judged once; resampling (``prepare``) sees training folds only."""
    if prepare is None and params.mode != "regression":
        return cross_validate_many(df, [(family, params)]).drop("candidate")
    folded = stage(resample.kfold(df, params.folds, params.seed))
    parts = []
    for fold in range(params.folds):
        train = folded.filter(F.col("fold") != fold).drop("fold")
        held = folded.filter(F.col("fold") == fold).drop("fold")
        rows = _labelled(train if prepare is None else prepare(train), params)
        # Calibration rows: a slice of the training folds, never the judged fold.
        calibration = _labelled(resample.holdout_split(train, 0.2, params.seed + 1).filter("split = 'holdout'").drop("split"), params)
        model = L.fit(family, rows, calibration, params)
        parts.append(M.bundle(model.predict(held), ()).withColumn("fold", F.lit(fold)))
    return resample.union_sources(*parts)


def fold_weights(counts: Mapping[tuple[int, int], int], parts: frozenset[int], params: Params) -> tuple[float, ...] | None:
    """Balanced class weights with the low-star boost over some row groups."""
    if not params.use_class_weight:
        return None
    classes = L.CLASSES[params.mode]
    own = [sum(n for (part, label), n in counts.items() if part in parts and label == k) for k in range(classes)]
    boosted = 2 if classes == 5 else 1
    plain = [sum(own) / (classes * n) if n else 0.0 for n in own]
    found = [w * (params.low_star_boost if k < boosted else 1.0) for k, w in enumerate(plain)]
    return tuple(w * p if params.compat else w for w, p in zip(found, plain))


def cross_validate_many(df: DataFrame, candidates: Sequence[tuple[str, Params]]) -> DataFrame:
    """(candidate, fold, metrics) of (family, params) on the same folds.

    All linear models of all folds and candidates share every pass over the
    rows, and so do the boosted models of one candidate's folds.  A fifth of
    the training rows of each fold calibrates margins or stops the rounds; the
    judged fold is never used for that.  Folds, seed and mode are those of the
    first candidate.
    """
    base = candidates[0][1]
    folded = stage(resample.holdout_split(resample.kfold(df, base.folds, base.seed), 0.2, base.seed + 1))
    # group 2 f: rows of fold f to learn from; 2 f + 1: its rows for calibration
    part = 2 * F.col("fold") + (F.col("split") == "holdout").cast("int")
    label = R.training_label(F.col("user_rating"), base.mode)
    table = stacked.blocks(folded.select("features", label.alias("label"), F.lit(1.0).alias("weight"), part.alias("part")))
    counts = {(r["p"], r["l"]): r["count"] for r in folded.groupBy(part.alias("p"), label.alias("l")).count().collect()}

    def groups(fold: int, calibration: bool) -> frozenset[int]:
        return frozenset(2 * f + calibration for f in range(base.folds) if f != fold)

    every = [(i, fold) for i in range(len(candidates)) for fold in range(base.folds)]
    models: dict[tuple[int, int], L.StarModel] = {}
    linear = [(i, fold) for i, fold in every if candidates[i][0] in LINEAR]
    if linear:
        plans = []
        for i, fold in linear:
            family, params = candidates[i]
            # only margins need rows of their own
            learns = groups(fold, False) | (frozenset() if family == "svm" else groups(fold, True))
            plans.append(_plan(family, learns, params, fold_weights(counts, learns, params)))
        made = stacked.fit_families(table, plans, [groups(fold, True) for _, fold in linear])
        models |= {key: L.StarModel(candidates[key[0]][0], base.mode, stages) for key, stages in zip(linear, made)}
    for i, (family, params) in enumerate(candidates):
        if family == "boosted":
            parts = [
                boosting.Part(groups(f, False), groups(f, True), fold_weights(counts, groups(f, False), params))
                for f in range(base.folds)
            ]
            settings = L.boosting_settings(params)
            for fold, model in enumerate(boosting.fit_many(table, parts, settings)):
                stages = PipelineModel([boosting.SoftmaxTrees.of(model, settings.classes)])
                models[i, fold] = L.StarModel(family, base.mode, stages)
    parts = []
    for i, fold in every:
        if (i, fold) not in models:
            family, params = candidates[i]
            rows = _labelled(folded.filter(F.col("fold") != fold), params)
            models[i, fold] = L.fit(family, rows, rows, params)
        scored = models[i, fold].predict(folded.filter(F.col("fold") == fold)).select(
            F.lit(i).alias("candidate"), F.lit(fold).alias("fold"), "user_rating", "ai_expected_rating"
        )
        parts.append(scored)
    return M.bundle(stage(resample.union_sources(*parts)), ("candidate", "fold"))


def search(
    df: DataFrame,
    grid: Sequence[Mapping],
    params: Params = Params(),
    prepare: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(candidate, family, settings, mae_mean, mae_std), lowest mean MAE first.

    A grid entry names a ``family`` and parameter overrides.  Without
    ``prepare`` all candidates are judged on the same folds in shared passes.
    """
    changes = [{k: v for k, v in entry.items() if k != "family"} for entry in grid]
    candidates = [(entry["family"], params.override(**c)) for entry, c in zip(grid, changes)]
    if prepare is None and params.mode != "regression":
        folds = cross_validate_many(df, candidates)
    else:
        folds = resample.union_sources(*[
            cross_validate(df, own, family, prepare).withColumn("candidate", F.lit(i)) for i, (family, own) in enumerate(candidates)
        ])
    names = df.sparkSession.createDataFrame(
        [(i, entry["family"], str(c)) for i, (entry, c) in enumerate(zip(grid, changes))], "candidate int, family string, settings string"
    )
    found = folds.groupBy("candidate").agg(
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"), F.avg("accuracy").alias("accuracy_mean")
    )
    return found.join(F.broadcast(names), "candidate").orderBy("mae_mean", "candidate")


def encoder_grid(
    encoded: Mapping[str, Callable[[], DataFrame]],
    families: Sequence[str] = ("logistic",),
    params: Params = Params(),
) -> DataFrame:
    """One row per encoder and head: encode once, train every head, hard-prediction MAE, failures kept.

    ``encoded`` maps an encoder to a function giving (review_id, user_rating, features).
    """
    spark, rows = None, []
    for encoder, make in encoded.items():
        try:
            table = stage(make())
            spark = table.sparkSession
            parts = split_features(table, params)
        except Exception as error:  # an encoder that fails is a result, too
            rows.append((encoder, None, "error", None, None, str(error)))
            continue
        labelled = {n: _labelled(parts[n], params) for n in ("train", "validation")}
        for family in families:
            try:
                model = L.fit(family, labelled["train"], labelled["validation"], params)
                found = M.bundle(model.predict(parts["holdout"]), (), hard=True).first()
                rows.append((encoder, family, "ok", found["mae"], found["accuracy"], None))
            except Exception as error:
                rows.append((encoder, family, "error", None, None, str(error)))
    if spark is None:
        raise ValueError("no encoder could be run")
    schema = "encoder string, family string, status string, mae double, accuracy double, error string"
    return spark.createDataFrame(rows, schema)


def best_head(grid: DataFrame) -> DataFrame:
    """Best head per encoder by MAE."""
    key = F.when(F.col("status") == "ok", F.struct("mae", "family"))
    return grid.groupBy("encoder").agg(F.min_by("family", key).alias("family"), F.min("mae").alias("mae"))


def sweep(
    run_id: str,
    variants: Sequence[Mapping],
    evaluate: Callable[[Params], DataFrame],
    spark,
    params: Params = Params(),
    model: str = "baseline",
    stop_at_accuracy: float | None = None,
) -> DataFrame:
    """Result rows of a sweep: per variant apply the overrides, run, keep metrics or the error.

    ``evaluate`` gets the variant's parameters and returns one row of metrics.
    """
    names = ("mae", "accuracy", "f1_macro", "f1_weighted", "rmse", "off_by_one_accuracy")
    rows = []
    for variant in variants:
        begin = time.monotonic()
        found, status, problem = dict.fromkeys(names), "ok", None
        try:
            first = evaluate(params.override(**variant.get("config", {}))).first()
            found = {n: first[n] for n in names}
        except Exception as error:
            status, problem = "error", str(error)
        seconds = time.monotonic() - begin
        settings = {k: str(v) for k, v in variant.get("config", {}).items()}
        rows.append((run_id, model, variant["name"], variant.get("hypothesis", ""), settings, *found.values(), seconds, status, problem))
        if stop_at_accuracy is not None and (found["accuracy"] or 0) > stop_at_accuracy:
            break
    schema = (
        "run_id string, model string, variant string, hypothesis string, config_overrides map<string,string>, "
        + ", ".join(f"{n} double" for n in names)
        + ", duration_sec double, status string, error string"
    )
    return spark.createDataFrame(rows, schema)
