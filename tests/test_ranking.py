"""Rank cuts and ordinals against sorting in plain Python, with a hot stratum."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starlens.functions.hashing import hash_key
from starlens.operators import pairs, ranking, resample


def md5(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def stars():
    draw = random.Random(1)
    # Star 5 holds most rows.
    return [(i, draw.choice([1, 2, 3, 4, 5, 5, 5, 5, 5])) for i in range(700)]


@pytest.fixture(scope="module")
def rows(spark, stars):
    return spark.createDataFrame(stars, "review_id long, user_rating int").repartition(5)


def test_cuts_match_sorting(rows, stars):
    out = ranking.cut_segments(
        rows, hash_key(42, F.col("review_id")), lambda n: [F.lit(0), F.floor(n / 3), n - 1, n + 5],
        stratum=F.col("user_rating"),
    )
    got = {r["review_id"]: r["segment"] for r in out.collect()}
    for star in range(1, 6):
        ordered = sorted((i for i, s in stars if s == star), key=md5)
        n = len(ordered)
        for rank, i in enumerate(ordered, 1):
            assert got[i] == sum(c < rank for c in (0, n // 3, n - 1, n + 5))


def test_ordinal_matches_sorting(rows, stars):
    out = ranking.ordinal(rows, hash_key(42, F.col("review_id")), stratum=F.col("user_rating"), total="n", prefix=2)
    for r in out.collect():
        ordered = sorted((i for i, s in stars if s == r["user_rating"]), key=md5)
        assert r["n"] == len(ordered) and ordered[r["ordinal"] - 1] == r["review_id"]


def test_ordinal_by_clustered_ids(spark):
    ids = [*range(50), *range(10**12, 10**12 + 50)]
    rows = spark.createDataFrame([(i,) for i in ids], "k long")
    out = ranking.ordinal(rows, F.col("k"), bucket=ranking.id_bucket(rows, "k", 16))
    assert sorted((r["k"], r["ordinal"]) for r in out.collect()) == [(k, n) for n, k in enumerate(ids, 1)]


def test_split_sizes_and_disjointness(rows, stars):
    out = resample.holdout_split(rows).collect()
    assert len({r["review_id"] for r in out}) == len(stars)
    for star, n in Counter(s for _, s in stars).items():
        sizes = Counter(r["split"] for r in out if r["user_rating"] == star)
        holdout = round(0.2 * n)
        assert sizes["holdout"] == holdout and sizes["validation"] == round(0.2 * (n - holdout))


def test_folds_are_balanced(rows):
    out = resample.kfold(rows, 4).collect()
    for star in range(1, 6):
        sizes = Counter(r["fold"] for r in out if r["user_rating"] == star)
        assert len(sizes) == 4 and max(sizes.values()) - min(sizes.values()) <= 1


def test_samples(rows, spark):
    assert resample.sample_rows(rows, 123).count() == 123
    assert resample.sample_rows(rows, 10**6).count() == 700
    assert resample.sample_rows(rows, 0).count() == 0
    first = {r["review_id"] for r in resample.sample_rows(rows, 50).collect()}
    assert first == {r["review_id"] for r in resample.sample_rows(rows.repartition(11), 50).collect()}
    assert resample.undersample_star(rows, 5, 1.0) is rows
    assert resample.stratified_reduce(rows, 10**6).count() == 700
    assert resample.stratified_reduce(rows, 70, star=None).count() == 70


def test_sample_does_not_shuffle_the_rows(rows):
    plan = resample.sample_rows(rows.withColumn("text", F.lit("x")), 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_first_rows_split(rows):
    out = resample.first_rows_split(rows, 0.2, 200).collect()
    assert sorted(r["review_id"] for r in out if r["split"] == "test") == list(range(200))


def test_oversample_and_mix(rows, spark, stars):
    low = sum(s <= 2 for _, s in stars)
    assert resample.oversample_low_stars(rows, 5).count() == 700 + 4 * low
    assert resample.oversample_low_stars(rows, 1).count() == 700
    mock = spark.createDataFrame([(-i, 3) for i in range(1, 21)], "review_id long, user_rating int")
    assert resample.mix_mock(rows, mock, 0.01).count() == 707
    assert resample.mix_mock(rows, mock, 0.5).count() == 720
    assert resample.mix_mock(rows, mock, 0.0) is rows and resample.mix_mock(rows, None, 0.5) is rows


def test_triplets(rows, stars, spark):
    star = dict(stars)
    got = pairs.triplet_ids(rows, pairs_per_row=2).collect()
    assert len(got) == 2 * len(stars)
    for r in got:
        assert star[r["anchor_id"]] == star[r["positive_id"]] != star[r["negative_id"]]
    assert pairs.triplet_ids(rows.filter("user_rating = 5")).count() == 0
