"""Fold tables against vectorisers and models fitted one by one."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from starlens.operators import features as FE
from starlens.operators import resample, stacked, vectorise
from starlens.params import Params
from starlens.plans import ablation
from starlens.plans.train import fold_weights

PARAMS = Params(folds=3, lr_max_iter=60, word_max_features=40, char_max_features=30)
COMBINATIONS = {
    "word": {"use_char_features": False},
    "few_words": {"use_char_features": False, "word_max_features": 15, "use_extra_features": True},
    "both": {},
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    words = "good bad food place staff slow nice then here salty cold warm".split()
    listed = [(i, " ".join(rng.choice(words, 8)) + (" great" if i % 5 > 2 else " awful"), i % 5 + 1) for i in range(90)]
    return spark.createDataFrame(listed, "review_id long, text string, user_rating int").repartition(3)


def test_fold_vocabularies_are_those_of_the_training_rows(rows):
    folded = resample.kfold(rows, 3, 42)
    sizes = [folded.where(F.col("fold") == f).count() for f in range(3)]
    found = ablation.fold_vocabularies(vectorise.word_terms(folded, ablation.KEYS), sizes, 25)
    for fold in range(3):
        train = folded.where(F.col("fold") != fold)
        want = vectorise.fit_vocabulary(vectorise.word_terms(train), F.lit(train.count()), 25)
        want = [(r["term"], r["idf"]) for r in want.orderBy(F.col("ctf").desc(), "term").collect()]
        assert [t for t, _ in found[fold]] == [t for t, _ in want]
        assert [i for _, i in found[fold]] == pytest.approx([i for _, i in want])


def test_shared_tables_give_what_single_fits_give(rows):
    got = {r["combination"]: r for r in ablation.ablate_features(rows, COMBINATIONS, PARAMS).collect()}
    folded = resample.kfold(rows, 3, 42).cache()
    label = (F.col("user_rating") - 1).cast("double")
    for name, changes in COMBINATIONS.items():
        params = PARAMS.override(**changes)
        errors = []
        for fold in range(3):
            train, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
            vectoriser = FE.fit_features(train, params)
            ready = vectoriser.transform(train).select("features", label.alias("label"), F.lit(1.0).alias("weight"), F.lit(0).alias("part"))
            counts = {(0, r["l"]): r["count"] for r in train.groupBy(label.alias("l")).count().collect()}
            plan = stacked.Plan("logistic", frozenset({0}), iterations=60, class_weight=fold_weights(counts, frozenset({0}), params))
            at = stacked.fit(stacked.blocks(ready), [plan])[0]
            for r in vectoriser.transform(held).select("user_rating", vector_to_array("features").alias("f")).collect():
                expected = stacked.softmax((np.array(r["f"]) @ at[:-1] + at[-1])[None])[0] @ np.arange(1, 6)
                errors.append((fold, abs(r["user_rating"] - min(max(np.floor(expected + 0.5), 1), 5))))
        mae = np.mean([np.mean([e for f, e in errors if f == fold]) for fold in range(3)])
        assert got[name]["mae_mean"] == pytest.approx(mae, abs=0.05)


def test_a_signal_is_found(rows):
    found = ablation.ablate_features(rows, {"word": {"use_char_features": False}}, PARAMS).first()
    shuffled = rows.withColumn("user_rating", (F.hash(F.lit(7), "review_id") % 5 + 5) % 5 + 1)
    assert found["mae_mean"] < ablation.ablate_features(shuffled, {"word": {"use_char_features": False}}, PARAMS).first()["mae_mean"]
