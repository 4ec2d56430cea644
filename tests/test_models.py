"""Learners, stored models, sweeps and streams."""

import random

import pytest
from pyspark.sql import functions as F

from starlens.catalog import load
from starlens.operators import features as FE, learners as L
from starlens.params import Params
from starlens.plans import train as P
from starlens.sources import registry
from starlens.streaming import jobs

FAST = Params(lr_max_iter=10, svm_max_iter=5, forest_trees=5, gbt_rounds=2, tree_depth=3, folds=2, low_star_boost=1.0)


@pytest.fixture(scope="module")
def points(spark):
    draw = random.Random(3)
    rows = [(i, i % 5 + 1, [float(i % 5 + 1) + draw.gauss(0, 0.2), draw.random()]) for i in range(200)]
    frame = spark.createDataFrame(rows, "review_id long, user_rating int, embedding array<double>")
    return FE.embedding_features(frame).drop("embedding").cache()


@pytest.mark.parametrize("family", L.FAMILIES)
def test_families(points, family):
    rows = L.with_training_columns(points, FAST)
    out = L.fit(family, rows, rows, FAST).predict(points)
    assert set(out.columns) == {*points.columns, "probs", "ai_expected_rating"}
    for r in out.collect():
        assert sum(r["probs"]) == pytest.approx(1) and 1 <= r["ai_expected_rating"] <= 5
    constant = out.agg(F.avg(F.abs(F.col("user_rating") - 4))).first()[0]
    assert out.agg(F.avg(F.abs(F.col("user_rating") - F.col("ai_expected_rating")))).first()[0] < constant


def test_modes_and_comparison(points):
    for mode in ("three_class", "regression"):
        params = FAST.override(mode=mode)
        rows = L.with_training_columns(points, params)
        out = L.fit("forest", rows, rows, params).predict(points)
        assert out.agg(F.min("ai_expected_rating"), F.max("ai_expected_rating")).first()[0] >= 1
    parts = P.split_features(points, FAST)
    found = P.compare_families(parts["train"], parts["validation"], FAST, ("logistic", "forest"), parts["holdout"])
    best = min(found.metrics.collect(), key=lambda r: (r["mae"], r["model_order"]))
    assert found.best == best["model"]


def test_saved_model_gives_the_same(spark, points, tmp_path):
    rows = L.with_training_columns(points, FAST)
    model = L.fit("logistic", rows, rows, FAST)
    registry.save_model(spark, "embedding", str(tmp_path), None, model, "keep_digits", 0.1)
    _, loaded = registry.load_model(spark, "embedding", str(tmp_path))
    a = {r["review_id"]: r["ai_expected_rating"] for r in model.predict(points).collect()}
    b = {r["review_id"]: r["ai_expected_rating"] for r in loaded.predict(points).collect()}
    assert a == b
    ready, skipped = registry.resolve_models(registry.readiness(spark, ["embedding", "baseline"], str(tmp_path)), None)
    assert [r["model"] for r in ready.collect()] == ["embedding"] and [r["model"] for r in skipped.collect()] == ["baseline"]
    assert registry.load_meta(spark, "embedding", str(tmp_path)).first()["preprocess_strategy"] == "keep_digits"


def test_sweep_keeps_failures(spark, points):
    def evaluate(params):
        rows = L.with_training_columns(points, params)
        return P.M.bundle(L.fit("logistic", rows, rows, params).predict(points), ())

    out = P.sweep("r", [{"name": "a"}, {"name": "b", "config": {"mode": "none"}}], evaluate, spark, FAST).collect()
    assert [(r["variant"], r["status"], r["mae"] is None) for r in out] == [("a", "ok", False), ("b", "error", True)]


def test_text_features_agree_with_the_relational_ones(spark):
    from starlens.operators import vectorise
    from pyspark.ml.functions import vector_to_array

    texts = ["good food here", "bad food here", "good place", "bad place then", "food food good"]
    rows = spark.createDataFrame([(i, t, i % 5 + 1) for i, t in enumerate(texts)], "review_id long, text string, user_rating int")
    params = FAST.override(use_char_features=False, word_max_features=50)
    made = FE.fit_features(rows, params).transform(rows)
    terms = vectorise.word_terms(vectorise.by_document(rows))
    vocab = vectorise.fit_vocabulary(terms, F.lit(5), 50)
    order = {r["term"]: i for i, r in enumerate(vocab.orderBy(F.col("ctf").desc(), "term").collect())}
    want = {(r["review_id"], order[r["term"]]): r["weight"] for r in vectorise.weigh(terms, vocab).collect()}
    for r in made.select("review_id", vector_to_array("features").alias("f")).collect():
        for i, v in enumerate(r["f"]):
            assert v == pytest.approx(want.get((r["review_id"], i), 0.0))


def test_reduced_features_are_stored_with_their_parameters(spark, tmp_path):
    texts = ["good food here", "bad food here", "good place", "bad place then", "food food good", "then here"] * 3
    rows = spark.createDataFrame([(i, t, i % 5 + 1) for i, t in enumerate(texts)], "review_id long, text string, user_rating int")
    params = FAST.override(word_ngrams=(1, 1), use_lsa=True, use_extra_features=True, lsa_components=2, low_star_boost=2.0)
    made = FE.fit_features(rows, params)
    ready = made.transform(rows)
    first = ready.first()["features"]
    assert len(first) == 2 + 3 and set(ready.columns) == {*rows.columns, "features"}
    assert first[2] == len("good food here")  # extras stand behind the reduced terms, as they are
    labelled = L.with_training_columns(ready, params)
    registry.save_model(spark, "baseline", str(tmp_path), made, L.fit("logistic", labelled, labelled, params), "extended", 0.1)
    again, _ = registry.load_model(spark, "baseline", str(tmp_path))
    assert again.params == params
    a = {r["review_id"]: list(r["features"]) for r in ready.collect()}
    assert a == {r["review_id"]: list(r["features"]) for r in again.transform(rows).collect()}
    ready_now = registry.readiness(spark, ["baseline", "other"], str(tmp_path))
    assert {r["model"]: r["ready"] for r in ready_now.collect()} == {"baseline": True, "other": False}


def test_classes_weighed_twice(points):
    once = {r["label"]: r["weight"] for r in L.with_training_columns(points.limit(37), FAST).collect()}
    both = {r["label"]: r["weight"] for r in L.with_training_columns(points.limit(37), FAST.override(compat=True)).collect()}
    assert both == pytest.approx({k: v * v for k, v in once.items()})


def test_offline_encoders(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["good food", "bad food", ""] * 4)], "review_id long, text string")
    for kind in ("hashing", "word2vec"):
        for r in FE.encode_offline(rows, kind, 8).collect():
            assert len(r["features"]) == 8 and (r["features"].norm(2) == pytest.approx(1) or r["features"].norm(2) == 0)


def test_reduction(points):
    reduction = FE.fit_reduction(points, 1)
    assert 0.5 < reduction.explained <= 1.0
    assert FE.reduce_features(points, reduction).count() == 200


def test_stream_equals_batch(spark, tmp_path):
    schema = "ts timestamp, place_name string, user_rating int, ai_expected_rating double"
    rows = spark.range(500).selectExpr(
        "timestamp_seconds(id * 600) AS ts", "concat('v', id % 3) AS place_name", "cast(id % 5 + 1 as int) AS user_rating", "1.0 + id % 4 AS ai_expected_rating"
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spec = spark.read.parquet(str(tmp_path / "in")).schema
    flagged = jobs.flag_events(jobs.read_stream(spark, str(tmp_path / "in"), spec))
    jobs.run_to_files(flagged, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    batch = jobs.flag_events(rows)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
    seen = {}

    def keep(df, number):
        for r in df.collect():
            seen[(r["window_start"], r["place_name"])] = (r["reviews"], r["anomalies"])

    jobs.run_per_batch(jobs.anomaly_rate(flagged), keep, str(tmp_path / "c2")).awaitTermination()
    want = {(r["window_start"], r["place_name"]): (r["reviews"], r["anomalies"]) for r in jobs.anomaly_rate(batch).collect()}
    assert seen == want
    assert schema


def test_no_python_workers_in_built_in_queries(spark, data):
    for name in ("q06_score_reviews", "f05_f09_strategies", "m01_j05_word_tfidf", "q03_q04_augment_minority", "a20_venue_rollup"):
        plan = load()[name].run(spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_reviews_are_scored_by_any_model(spark):
    import numpy as np
    from starlens.plans.score import TrainedModel, score_reviews

    texts = ["อร่อยมาก บริการแย่", "good place good food", "bad place bad food", "nothing", "fine", "", None]
    rows = spark.createDataFrame(
        [(i, t, i % 5 + 1, "p") for i, t in enumerate(texts)], "review_id long, text string, user_rating int, place_name string"
    )
    known = rows.where("text <> ''")
    for mode in ("five_class", "regression"):
        params = FAST.override(use_char_features=False, word_max_features=50, word_min_df=1, mode=mode)
        made = FE.fit_features(known, params)
        labelled = L.with_training_columns(made.transform(known), params)
        model = TrainedModel(made, L.fit("logistic", labelled, labelled, params))
        out = score_reviews(known, model, params)
        assert {*rows.columns, "ai_expected_rating", "delta", "is_anomaly", "aspect_food"} <= set(out.columns) and "features" not in out.columns
        assert sorted(r["review_id"] for r in out.where("ai_expected_rating between 1 and 5").collect()) == [0, 1, 2, 3, 4]
        plan = score_reviews(known, model, params, skip_aspects=True)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan

    def load():
        return lambda batch: np.tile([0.0, 0.0, 0.0, 0.0, 1.0], (len(batch), 1))

    own = score_reviews(rows, load).collect()
    assert len(own) == 7 and all(r["ai_expected_rating"] == 5 and r["aspect_food"] == 5 for r in own)


def test_stored_models_are_evaluated(spark, tmp_path):
    from starlens.plans.evaluate import evaluate_stored

    texts = ["good food here", "bad food here", "good place", "bad place then", "food food good"]
    rows = spark.createDataFrame([(i, t, i % 5 + 1) for i, t in enumerate(texts)], "review_id long, text string, user_rating int")
    params = FAST.override(use_char_features=False, word_max_features=50)
    made = FE.fit_features(rows, params)
    labelled = L.with_training_columns(made.transform(rows), params)
    registry.save_model(spark, "words", str(tmp_path), made, L.fit("logistic", labelled, labelled, params), "keep_digits", 0.0)
    found, skipped = evaluate_stored(spark, ["words", "absent"], str(tmp_path), rows)
    assert {r["model"]: r["n_samples"] for r in found.metrics.collect()} == {"words": 5, "majority": 5}
    assert [r["model"] for r in skipped.collect()] == ["absent"]
    with pytest.raises(ValueError):
        evaluate_stored(spark, ["absent"], str(tmp_path), rows)


def test_encoders_cut_texts_into_words_once(spark):
    """What an encoder reads is a stored table of words, however often it does."""
    rows = spark.createDataFrame([(i, f"อร่อย good food {i % 3}") for i in range(12)], "review_id long, text string")
    for kind in ("hashing", "word2vec"):
        out = FE.encode_offline(rows, kind, size=8)
        assert out.columns == ["review_id", "text", "features"] and out.count() == 12
        assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
