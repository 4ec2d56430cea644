"""Queries on training.  Fits have no SQL counterpart, so the queries state what must hold for each of them."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from starlens.catalog.base import query, quote, table
from starlens.catalog.sampling import synonyms
from starlens.catalog.text import cleaned
from starlens.operators import features as FE
from starlens.operators import learners as L
from starlens.params import Params
from starlens.plans import ablation
from starlens.plans import train as P
from starlens.plans.training_set import prepare_training_set
from starlens.session import stage

FULL = Params()


def embedded(spark, folder):
    """(review_id, user_rating, features) of the embeddings table."""
    rows = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("review_id"), (F.col("label") % 5 + 1).cast("int").alias("user_rating"), "embedding"
    )
    return FE.embedding_features(rows).drop("embedding")


def texts(spark, folder):
    return stage(cleaned(spark, folder).select("review_id", "text", "user_rating"), "review_id")


_FEATURES = FULL.word_max_features + FULL.char_max_features + 3


@query(
    "m03_m05_text_features",
    f"""SELECT review_id, CAST(user_rating - 1 AS INTEGER) AS label, true AS width_fits,
               round(count(*) OVER () / (5 * count(*) OVER (PARTITION BY user_rating))
                     * CASE WHEN user_rating <= 2 THEN {FULL.low_star_boost}e0 ELSE 1e0 END, 6) AS weight
        FROM clean""",
)
def m03(spark, folder):
    rows = texts(spark, folder)
    # the weights first: counting the stars of finished features would tokenise all texts again
    weighted = FE.fit_features(rows, FULL.override(use_extra_features=True)).transform(L.with_training_columns(rows, FULL))
    size = F.size(vector_to_array("features"))
    return weighted.select(
        "review_id", "label", F.round("weight", 6).alias("weight"), size.between(4, _FEATURES).alias("width_fits")
    )


@query(
    "m04_lsa",
    f"SELECT vec_id AS review_id, CAST(least({FULL.lsa_components}, len(embedding)) AS INTEGER) AS components, true AS explained FROM embeddings",
)
def m04(spark, folder):
    """All directions of the vectors are kept here, so they explain all of the variance."""
    rows = stage(embedded(spark, folder))
    reduction = FE.fit_reduction(rows, FULL.lsa_components)
    out = FE.reduce_features(rows, reduction)
    explained = F.lit(abs(reduction.explained - 1) < 1e-6)
    return out.select("review_id", F.size(vector_to_array("features")).alias("components"), explained.alias("explained"))


def facts(found: P.Comparison):
    """What must hold for any fit, one row per model: rows judged, ratings in range, metrics recomputed from the predictions."""
    d = F.abs(F.col("user_rating") - F.col("ai_expected_rating"))
    own = found.predictions.groupBy("model").agg(
        F.min(F.col("ai_expected_rating").between(1, 5)).alias("in_range"), F.avg(d).alias("own"), F.count("*").alias("n")
    )
    return found.metrics.join(own, "model").select(
        "model", "n_samples", "in_range",
        ((F.abs(F.col("mae") - F.col("own")) < 1e-9) & (F.col("n") == F.col("n_samples"))).alias("metrics_agree"),
        (F.col("model") == found.best).alias("is_best"),
    )


def _facts_sql(families, sizes: str) -> str:
    held = f"(SELECT CAST(sum(round_even({FULL.holdout_fraction}e0 * n, 0)) AS BIGINT) FROM (SELECT count(*) AS n FROM {sizes}))"
    names = ", ".join(f"('{f}')" for f in families)
    return f"SELECT model, {held} AS n_samples, true AS in_range, true AS metrics_agree FROM (VALUES {names}) AS v(model)"


_VECTOR_STARS = "embeddings GROUP BY label % 5"


def _register(name: str, families, params=FULL) -> None:
    @query(name, _facts_sql(families, _VECTOR_STARS))
    def run(spark, folder):
        parts = P.split_features(embedded(spark, folder), params)
        found = P.compare_families(parts["train"], parts["validation"], params, families, parts["holdout"])
        return facts(found).drop("is_best")


_register("m06_m15_logistic", ("logistic",))
_register("m07_calibrated_svm", ("svm",))
_register("m08_forest", ("forest",))
_register("m09_boosted_trees", ("boosted",))
_register("m10_regression", ("boosted",), FULL.override(mode="regression"))
_register("m11_three_class", ("logistic",), FULL.override(mode="three_class"))
_register("m13_embedding_heads", L.FAMILIES)


@query("m12_compare_families", _facts_sql(L.FAMILIES, "clean GROUP BY user_rating"))
def m12(spark, folder):
    """All families on texts; undersampling, oversampling and augmentation see the training part only."""
    words = synonyms(spark)

    def prepare(train):
        return prepare_training_set(train, None, words, FULL)

    _, found = P.train_on_texts(texts(spark, folder), FULL, L.FAMILIES, prepare)
    return facts(found).drop("is_best")


GRID = [{"family": f} for f in L.FAMILIES] + [{"family": "logistic", "lr_max_iter": 10}, {"family": "forest", "tree_depth": 3}]


@query(
    "m16_search",
    "SELECT CAST(candidate AS INTEGER) AS candidate, family, settings, true AS in_range FROM (VALUES "
    + ", ".join(
        f"({i}, '{g['family']}', {quote(str({k: v for k, v in g.items() if k != 'family'}))})" for i, g in enumerate(GRID)
    )
    + ") AS v(candidate, family, settings)",
)
def m16(spark, folder):
    found = P.search(stage(embedded(spark, folder)), GRID, FULL)
    sound = F.col("mae_mean").between(0, 4) & (F.col("mae_std") >= 0) & F.col("accuracy_mean").between(0, 1)
    return found.select("candidate", "family", "settings", sound.alias("in_range"))


# Feature combinations; those with reduced features are left to callers, see the README.
COMBINATIONS = {
    "word": {"use_char_features": False},
    "word_extra": {"use_char_features": False, "use_extra_features": True},
    "word_char": {},
    "word_char_extra": {"use_extra_features": True},
    "words_5000": {"word_max_features": 5000, "use_extra_features": True},
    "words_12000": {"word_max_features": 12000, "use_extra_features": True},
    "grams_6000": {"char_max_features": 6000, "char_ngrams": (2, 6), "use_extra_features": True},
}


@query(
    "m17_feature_ablation",
    f"SELECT combination, true AS in_range FROM (VALUES {', '.join(f'({quote(c)})' for c in COMBINATIONS)}) AS v(combination)",
)
def m17(spark, folder):
    """Seven combinations in five folds: vectorisers per fold, one stack of 35 models."""
    found = ablation.ablate_features(texts(spark, folder), COMBINATIONS, FULL)
    sound = F.col("mae_mean").between(0, 4) & (F.col("mae_std") >= 0) & F.col("f1_macro_mean").between(0, 1)
    return found.select("combination", sound.alias("in_range"))


@query("m19_encoder_grid", "SELECT encoder, true AS in_range, true AS known_head FROM (VALUES ('hashing'), ('word2vec')) AS v(encoder)")
def m19(spark, folder):
    rows = texts(spark, folder)
    encoders = {
        kind: lambda kind=kind: FE.encode_offline(rows, kind).select("review_id", "user_rating", "features")
        for kind in ("hashing", "word2vec")
    }
    best = P.best_head(P.encoder_grid(encoders, ("logistic", "forest"), FULL))
    return best.select(
        "encoder", F.col("mae").between(0, 4).alias("in_range"), F.col("family").isin("logistic", "forest").alias("known_head")
    )


VARIANTS = [
    {"name": "few_rounds", "config": {"lr_max_iter": 3}},
    {"name": "plain_weights", "config": {"low_star_boost": 1.0}},
    {"name": "broken", "config": {"mode": "unknown"}},
]


@query(
    "q10_sweep",
    "SELECT variant, status, setting, status = 'ok' AS measured FROM (VALUES ('few_rounds', 'ok', '3'), ('plain_weights', 'ok', '1.0'), "
    "('broken', 'error', 'unknown')) AS v(variant, status, setting)",
)
def q10(spark, folder):
    parts = P.split_features(embedded(spark, folder), FULL)

    def evaluate(params):
        return P.compare_families(parts["train"], parts["validation"], params, ("logistic",), parts["holdout"]).metrics

    out = P.sweep("run0", VARIANTS, evaluate, spark, FULL)
    setting = F.map_values("config_overrides")[0]
    return out.select("variant", "status", setting.alias("setting"), (F.col("mae").between(0, 4) & F.col("error").isNull()).alias("m")).select(
        "variant", "status", "setting", F.coalesce("m", F.lit(False)).alias("measured")
    )


@query("s18_saved_model", "SELECT vec_id AS review_id, CAST(label % 5 + 1 AS INTEGER) AS user_rating, true AS same FROM embeddings")
def s18(spark, folder):
    """Every row is rated alike by a model and by what its stored form gives back."""
    from starlens.session import shared_dir
    from starlens.sources import registry

    rows = stage(embedded(spark, folder))
    labelled = L.with_training_columns(rows, FULL)
    root = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    model = L.fit("logistic", labelled, labelled, FULL)
    registry.save_model(spark, "embedding", root, None, model, "keep_digits", 0.0)
    _, loaded = registry.load_model(spark, "embedding", root)
    own = model.predict(rows).select("review_id", F.col("ai_expected_rating").alias("own"))
    again = loaded.predict(rows).select("review_id", "user_rating", "ai_expected_rating")
    return again.join(own, "review_id").select(
        "review_id", "user_rating", F.col("own").eqNullSafe(F.col("ai_expected_rating")).alias("same")
    )


@query(
    "q06_score_trained",
    "SELECT review_id, user_rating, true AS in_range, true AS aspects_in_range, true AS flags_agree FROM clean",
)
def q06_trained(spark, folder):
    """Score whole reviews and their sentences with a model trained on the same table."""
    from starlens.plans.score import TrainedModel, score_reviews

    rows = texts(spark, folder)
    vectoriser, found = P.train_on_texts(rows, FULL, ("logistic",))
    out = score_reviews(rows, TrainedModel(vectoriser, found.models["logistic"]), FULL)
    rating = F.col("ai_expected_rating")
    gap = F.abs(F.col("user_rating") - rating)
    aspects_fit = F.lit(True)
    for name in (c for c in out.columns if c.startswith("aspect_")):
        aspects_fit = aspects_fit & F.col(name).between(1, 5)
    return out.select(
        "review_id", "user_rating", rating.between(1, 5).alias("in_range"), aspects_fit.alias("aspects_in_range"),
        ((F.abs(F.col("delta") - gap) < 1e-9) & (F.col("is_anomaly") == (gap >= FULL.anomaly_threshold))).alias("flags_agree"),
    )


@query(
    "s19_q07_evaluate_stored",
    _facts_sql(("plain", "boosted_low_stars", "majority"), _VECTOR_STARS).replace(
        "true AS in_range, true AS metrics_agree", "true AS in_range"
    )
    + " UNION ALL SELECT 'absent', NULL, NULL",
)
def s19(spark, folder):
    """Train and store two models, then evaluate what the registry holds; a third name has no model."""
    from starlens.plans.evaluate import evaluate_stored
    from starlens.session import shared_dir
    from starlens.sources import registry

    parts = P.split_features(embedded(spark, folder), FULL)
    root = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    for name, boost in (("plain", 1.0), ("boosted_low_stars", FULL.low_star_boost)):
        params = FULL.override(low_star_boost=boost)
        labelled = L.with_training_columns(parts["train"], params)
        registry.save_model(spark, name, root, None, L.fit("logistic", labelled, labelled, params), "keep_digits", 0.0)
    found, skipped = evaluate_stored(spark, ["plain", "boosted_low_stars", "absent"], root, parts["holdout"])
    judged = found.metrics.select("model", "n_samples", F.col("mae").between(0, 4).alias("in_range"))
    return judged.unionByName(skipped.select("model"), allowMissingColumns=True)
