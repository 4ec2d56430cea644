"""Models trained together against plain numpy on the same rows."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from starlens.operators import stacked as S


def given_rows(sparse, n=240, width=9, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.4)
    label = (x @ rng.normal(size=(width, 5)) + rng.gumbel(size=(n, 5)) * 0.5).argmax(1)
    weight, part = rng.uniform(0.5, 2, n), rng.integers(0, 4, n)
    vectors = [Vectors.sparse(width, [(i, v) for i, v in enumerate(r) if v]) if sparse else Vectors.dense(r) for r in x]
    return x, label, weight, part, vectors


def table_of(spark, rows):
    x, label, weight, part, vectors = rows
    listed = [(v, float(a), float(b), int(c)) for v, a, b, c in zip(vectors, label, weight, part)]
    return spark.createDataFrame(listed, ["features", "label", "weight", "part"]).repartition(3)


def objective(plan, rows, at):
    x, label, weight, part, _ = rows
    keep = np.isin(part, list(plan.groups))
    x, label, weight = x[keep], label[keep], weight[keep]
    if plan.class_weight:
        weight = weight * np.array(plan.class_weight)[label]
    scores = x @ at[:-1] + at[-1]
    if plan.family == "logistic":
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return -(weight * np.log(p[np.arange(len(label)), label])).sum() / weight.sum() + (at[:-1] ** 2).sum() / (2 * plan.strength * weight.sum())
    sign = np.where(np.arange(5) == label[:, None], 1, -1)
    loss = (weight[:, None] * np.maximum(1 - sign * scores, 0) ** 2).sum()
    return loss / weight.sum() + (at[:-1] ** 2).sum() / (2 * plan.strength * weight.sum())


PLANS = [
    S.Plan("logistic", frozenset({0, 1, 2}), strength=2.0, iterations=300),
    S.Plan("logistic", frozenset({1, 2, 3}), strength=0.1, iterations=300, class_weight=(3.0, 2.0, 1.0, 1.0, 0.5)),
    S.Plan("svm", frozenset({0, 1, 3}), strength=1.0, iterations=300),
]


@pytest.mark.parametrize("sparse", [True, False])
def test_each_model_is_at_its_own_minimum(spark, sparse):
    rows = given_rows(sparse)
    fitted = S.fit(S.blocks(table_of(spark, rows)), PLANS)
    rng = np.random.default_rng(2)
    for plan, at in zip(PLANS, fitted):
        own = objective(plan, rows, at)
        slopes = []
        for _ in range(20):
            away = rng.normal(size=at.shape)
            away /= np.sqrt((away**2).sum())
            slopes.append((objective(plan, rows, at + 1e-4 * away) - objective(plan, rows, at - 1e-4 * away)) / 2e-4)
            assert objective(plan, rows, at + 0.05 * away) > own
        assert np.abs(slopes).max() < 1e-3


def test_a_stack_gives_what_single_fits_give(spark):
    table = S.blocks(table_of(spark, given_rows(True)))
    together = S.fit(table, PLANS)
    for plan, at in zip(PLANS, together):
        assert np.allclose(S.fit(table, [plan])[0], at, atol=1e-8)


def test_one_pass_serves_all_models(spark, monkeypatch):
    table = S.blocks(table_of(spark, given_rows(True)))
    passes = []
    real = S.over_blocks
    monkeypatch.setattr(S, "over_blocks", lambda *a: passes.append(1) or real(*a))
    short = [S.Plan("logistic", frozenset({0, 1, i % 4}), strength=0.1 * (i + 1), iterations=5) for i in range(12)]
    S.fit(table, short)
    assert len(passes) <= 12  # not 12 times 6


def test_blocks_hold_all_rows(spark, monkeypatch):
    def count(block, _, total):
        total[0] += block.rows
        total[1:] += block.transposed_times(np.ones((block.rows, 1)))[:, 0]

    rows = given_rows(True)
    found = S.over_blocks(S.blocks(table_of(spark, rows)), None, 10, count)
    assert found[0] == 240 and found[1:].sum() == pytest.approx(rows[0].sum())


def test_spark_models_give_the_same_scores(spark):
    rows = given_rows(True)
    df = table_of(spark, rows)
    table = S.blocks(df)
    logistic, _, machines = S.fit_families(table, PLANS, [frozenset({3}), frozenset({0}), frozenset({2})])
    fitted = S.fit(table, PLANS)
    curves = S.sigmoids(table, PLANS[2:], fitted[2:], [frozenset({2})])[0]
    x = rows[0]
    want = S.softmax(x @ fitted[0][:-1] + fitted[0][-1])
    got = logistic.transform(df).select(vector_to_array("features").alias("f"), vector_to_array("probability").alias("p")).collect()
    place = {tuple(r): i for i, r in enumerate(x)}
    for r in got:
        assert np.allclose(r["p"], want[place[tuple(r["f"])]], atol=1e-9)
    margins = x @ fitted[2][:-1] + fitted[2][-1]
    columns = F.array(*[vector_to_array(f"probability_{k}")[1] for k in range(5)])
    for r in machines.transform(df).select(vector_to_array("features").alias("f"), columns.alias("p")).collect():
        z = margins[place[tuple(r["f"])]] * curves[:, 0] + curves[:, 1]
        assert np.allclose(r["p"], 1 / (1 + np.exp(-z)), atol=1e-9)


def test_sigmoids_are_at_their_minimum(spark):
    rows = given_rows(True)
    table = S.blocks(table_of(spark, rows))
    fitted = S.fit(table, PLANS[2:])
    curves = S.sigmoids(table, PLANS[2:], fitted, [frozenset({2})])[0]
    x, label, _, part, _ = rows
    margins = (x @ fitted[0][:-1] + fitted[0][-1])[part == 2]

    def loss(k, slope, shift):
        z = slope * margins[:, k] + shift
        return (np.logaddexp(0, z) - (label[part == 2] == k) * z).sum() + 5e-4 * (slope**2 + shift**2)

    for k, (slope, shift) in enumerate(curves):
        for away in ((0.01, 0), (-0.01, 0), (0, 0.01), (0, -0.01)):
            assert loss(k, slope + away[0], shift + away[1]) > loss(k, slope, shift)


def test_no_rows(spark):
    empty = table_of(spark, given_rows(True)).where("false")
    assert S.fit(S.blocks(empty), PLANS[:1])[0].shape == (1, 5)


def test_blocks_hold_full_and_sparse_vectors_and_come_one_by_one(spark, monkeypatch):
    """A batch of vectors becomes blocks without lists of Python numbers; each is a row group's worth at most."""
    listed = [
        (Vectors.sparse(5, [(1, 2.0), (4, 3.0)]), 0.0, 1.0, 0), (Vectors.dense([1.0, 0.0, 2.0, 0.0, 5.0]), 1.0, 2.0, 1),
        (Vectors.sparse(5, []), 2.0, 1.0, 1), (Vectors.sparse(5, [(0, 7.0)]), 3.0, 0.5, 0),
    ]
    table = S.blocks(spark.createDataFrame(listed, ["features", "label", "weight", "part"]).coalesce(1))
    found = []
    for row in table.collect():
        b = S.block_of(row)
        dense = b.times(np.eye(5))
        found += [(dense[i].tolist(), b.label[i], b.weight[i], b.part[i]) for i in range(b.rows)]
    assert found == [(v.toArray().tolist(), a, w, p) for v, a, w, p in listed]


def test_a_view_is_a_table_of_its_own_columns(spark):
    """Models that look at a table through a view are those of a table with its columns."""
    rows = given_rows(True)
    x, label, weight, part, _ = rows
    view = S.View(np.array([2, -1, 0, -1, 1, 3, -1, -1, -1]), np.array([2.0, 0, 1, 0, 0.5, 1, 0, 0, 0]), 4)
    own = np.stack([x[:, 2], x[:, 4] * 0.5, x[:, 0] * 2, x[:, 5]], axis=1)
    vectors = [Vectors.sparse(4, [(i, v) for i, v in enumerate(r) if v]) for r in own]
    plan = S.Plan("logistic", frozenset({0, 1}), strength=2.0, iterations=300)
    alone = S.fit(S.blocks(table_of(spark, (own, label, weight, part, vectors))), [plan])[0]
    seen = S.Plan("logistic", frozenset({0, 1}), strength=2.0, iterations=300, view=0)
    table = S.blocks(table_of(spark, rows))
    fitted = S.fit(table, [seen], [view])
    assert fitted[0].shape == (5, 5) and np.allclose(fitted[0], alone, atol=1e-3)
    judged = S.judged(table, [seen], fitted, [frozenset({3})], [view])
    assert judged.count() == (part == 3).sum()
