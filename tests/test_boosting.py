"""Jointly boosted trees: falling losses, planted signals, sparse and dense features, stored trees."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from starlens.operators import boosting as B
from starlens.operators.stacked import blocks


def planted(n=600, seed=3, sparse=False):
    """Three classes by an interaction of two features; further features are noise."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * (rng.random((n, 6)) < (0.6 if sparse else 1))
    label = np.where((x[:, 0] > 0) ^ (x[:, 1] > 0), 0, np.where(x[:, 0] > 0, 1, 2))
    vectors = [Vectors.sparse(6, [(i, v) for i, v in enumerate(r) if v]) if sparse else Vectors.dense(r) for r in x]
    part = (np.arange(n) % 4 == 3).astype(int)
    return x, label, part, vectors


def table_of(spark, label, part, vectors):
    rows = [(v, float(a), 1.0, int(b)) for v, a, b in zip(vectors, label, part)]
    return blocks(spark.createDataFrame(rows, ["features", "label", "weight", "part"]).repartition(2))


def accuracy(fitted, x, label):
    scores = B._scores(fitted.trees, x, np.zeros((len(x), 3)))
    return (scores.argmax(1) == label).mean()


@pytest.mark.parametrize("sparse", [False, True])
def test_losses_fall_and_the_interaction_is_found(spark, sparse):
    x, label, part, vectors = planted(sparse=sparse)
    fitted = B.fit(table_of(spark, label, part, vectors), B.Settings(rounds=12, depth=3, rate=0.3, classes=3, rows_share=1.0))
    assert all(b < a for a, b in zip(fitted.train_loss, fitted.train_loss[1:]))
    assert len(fitted.train_loss) == 12  # more than ROUNDS_EACH: scores were written down once
    assert accuracy(fitted, x[part == 1], label[part == 1]) > 0.9
    # the reported loss is that of the trees
    probs = B.softmax(B._scores(fitted.trees, x[part == 1], np.zeros((int(part.sum()), 3))))
    assert fitted.validation_loss[-1] == pytest.approx(-np.log(probs[np.arange(len(probs)), label[part == 1]]).mean())


def test_models_that_share_passes_are_those_of_single_fits(spark):
    x, label, part, vectors = planted(300)
    table = table_of(spark, label, part + 2 * (np.arange(300) % 2), vectors)
    settings = B.Settings(rounds=4, depth=2, rate=0.3, classes=3)
    parts = [B.Part(frozenset({0, 2}), frozenset({1})), B.Part(frozenset({0, 1}), frozenset({3}), (1.0, 2.0, 0.5))]
    for part, model in zip(parts, B.fit_many(table, parts, settings)):
        alone = B.fit_many(table, [part], settings)[0]
        assert np.allclose(alone.train_loss, model.train_loss)
        assert np.allclose(B._scores(alone.trees, x, np.zeros((300, 3))), B._scores(model.trees, x, np.zeros((300, 3))))


def test_shuffled_labels_stop_early(spark):
    x, label, part, vectors = planted(400)
    shuffled = np.random.default_rng(1).permutation(label)
    fitted = B.fit(table_of(spark, shuffled, part, vectors), B.Settings(rounds=30, depth=4, rate=0.5, classes=3, patience=2))
    assert len(fitted.trees) < 30 and len(fitted.trees) == 1 + int(np.argmin(fitted.validation_loss))
    assert accuracy(fitted, x[part == 1], label[part == 1]) < 0.6


def test_each_split_is_the_best_one(spark):
    """The first tree of a class against a search over all cuts in numpy."""
    x, label, part, vectors = planted(300, 9, sparse=True)
    table = table_of(spark, label, np.zeros(300), vectors)
    settings = B.Settings(rounds=1, depth=1, rate=1.0, classes=3, rows_share=1.0)
    tree = B.fit(table, settings).trees[0][0]
    bins = B.Bins(B.find_cuts(table))
    gradient = 1 / 3 - (label == 0)
    bend = np.full(300, 2 / 3 * 2 / 3)
    best = -np.inf
    for f in range(6):
        for cut in bins.flat[f]:
            left = x[:, f] <= cut
            if np.isfinite(cut) and min(bend[left].sum(), bend[~left].sum()) >= 1:
                gain = sum(gradient[s].sum() ** 2 / (bend[s].sum() + 1) for s in (left, ~left))
                if gain > best + 1e-9:
                    best, feature, threshold, value = gain, f, cut, -gradient[left].sum() / (bend[left].sum() + 1)
    assert (tree.feature[0], tree.threshold[0]) == (feature, threshold)
    assert tree.value[1] == pytest.approx(value)


def test_stored_trees(spark, tmp_path):
    from pyspark.ml import PipelineModel

    x, label, part, vectors = planted(200)
    fitted = B.fit(table_of(spark, label, part, vectors), B.Settings(rounds=3, depth=2, classes=3))
    model = PipelineModel([B.SoftmaxTrees.of(fitted, 3)])
    frame = spark.createDataFrame([(v,) for v in vectors], ["features"])
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    want = [r["probability"].toArray() for r in model.transform(frame).collect()]
    assert np.allclose(want, [r["probability"].toArray() for r in again.transform(frame).collect()])
    assert np.allclose(want, B.softmax(B._scores(fitted.trees, x, np.zeros((200, 3)))))


def test_no_rows(spark):
    _, label, part, vectors = planted(20)
    table = blocks(spark.createDataFrame([(vectors[0], 1.0, 1.0, 0)], ["features", "label", "weight", "part"]).where("false"))
    assert B.fit(table, B.Settings(classes=3)).trees == []
