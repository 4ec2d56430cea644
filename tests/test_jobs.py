"""Augmentation, TF-IDF, aspects, venues, profiles, caches: small fixtures against plain Python."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlens.functions import text as T
from starlens.operators import aspects, augment, cache, experiments, hooks, profile, vectorise, venues
from starlens.params import Params
from starlens.plans.score import LinearModel, score_reviews
from starlens.plans.training_set import prepare_training_set


@pytest.fixture(scope="module")
def synonyms(spark):
    return spark.createDataFrame([("อร่อย", ["แซ่บ", "เลิศ"]), ("bad", ["awful"])], "token string, choices array<string>")


def test_round_robin(spark):
    rows = spark.createDataFrame([(i, "abc def", 1) for i in (10, 20, 30)] + [(i, "x", 4) for i in range(100, 120)], "review_id long, text string, user_rating int")
    got = augment.round_robin_copies(rows, target=8).collect()
    assert Counter(r["review_id"] for r in got) == {10: 2, 20: 2, 30: 1}
    assert augment.round_robin_copies(rows, target=3).count() == 0


def test_augmentation(spark, synonyms):
    rows = spark.createDataFrame([(1, 0, "bad bad day"), (2, 0, "bad")], "review_id long, copy int, text string")
    same = augment.replace_synonyms(rows, synonyms, 0.0)
    assert {r["text"] for r in same.collect()} == {"bad bad day", "bad"}
    swapped = {r["review_id"]: r["text"] for r in augment.replace_synonyms(rows, synonyms, 1.0).collect()}
    assert swapped == {1: "awful awful day", 2: "bad"}  # one token is too few
    mixed = {r["review_id"]: r["text"] for r in augment.shuffle_tokens(rows, synonyms, 1.0).collect()}
    assert sorted(mixed[1]) == sorted("bad bad day") and mixed[2] == "bad"
    again = {r["review_id"]: r["text"] for r in augment.shuffle_tokens(rows.repartition(3), synonyms, 1.0).collect()}
    assert mixed == again


def test_augment_errors(spark, synonyms):
    base = spark.createDataFrame([(1, "bad day today", 2)], "review_id long, text string, user_rating int")
    errors = spark.createDataFrame([(9, "bad food", 5)], "review_id long, text string, true_star int")
    out = augment.augment_errors(base, errors, synonyms, factor=3)
    assert Counter(r["user_rating"] for r in out.collect()) == {2: 1, 5: 3}
    assert augment.augment_errors(base, None, synonyms).count() == 1
    no_star = augment.augment_errors(base, errors.drop("true_star"), synonyms, factor=1)
    assert Counter(r["user_rating"] for r in no_star.collect()) == {2: 1, 3: 1}


def test_training_set(spark, synonyms):
    rows = spark.createDataFrame([(i, f"text number {i} " + "y" * 600, i % 5 + 1) for i in range(100)], "review_id long, text string, user_rating int")
    params = Params(mock_fraction=0.0, undersample_fraction=0.5, oversample_factor=2, augment_target=45)
    out = prepare_training_set(rows, None, synonyms, params)
    got = Counter(r["user_rating"] for r in out.collect())
    assert got == {1: 45, 2: 45, 3: 45, 4: 10, 5: 20}
    assert out.agg(F.max(F.length("text"))).first()[0] == 500


DOCS = ["good food good", "bad food", "good place", "the place the end"]


def test_tfidf(spark):
    rows = spark.createDataFrame(list(enumerate(DOCS)), "review_id long, text string")
    terms = vectorise.word_terms(vectorise.by_document(rows), ngrams=(1, 1), analyser=lambda t: T.blank_split(t))
    vocab = vectorise.fit_vocabulary(terms, F.lit(4), 10, 2, 0.9)
    got = {(r["review_id"], r["term"]): r["weight"] for r in vectorise.weigh(terms, vocab).collect()}
    counts = [Counter(d.split()) for d in DOCS]
    df = Counter(w for c in counts for w in c)
    kept = {w for w, n in df.items() if 2 <= n <= 3.6}
    want = {}
    for i, c in enumerate(counts):
        raw = {w: n * (math.log(5 / (1 + df[w])) + 1) for w, n in c.items() if w in kept}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want.update({(i, w): v / norm for w, v in raw.items()})
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_exploded_terms_are_not_shuffled(spark):
    rows = spark.createDataFrame(list(enumerate(DOCS)), "review_id long, text string")
    counts = vectorise.term_counts(vectorise.word_terms(vectorise.by_document(rows)))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_scoring_with_aspects(spark):
    rows = spark.createDataFrame(
        [(1, "อร่อยมาก บริการแย่", 1, "a"), (2, "nothing to see", 5, "a")],
        "review_id long, text string, user_rating int, place_name string",
    )
    vocab = spark.createDataFrame([("อร่อย", 1.0), ("แย่", 1.0)], "term string, idf double")
    coefs = spark.createDataFrame([("อร่อย", [0.0, 0.0, 0.0, 0.0, 9.0]), ("แย่", [9.0, 0.0, 0.0, 0.0, 0.0])], "term string, coef array<double>")
    out = {r["review_id"]: r for r in score_reviews(rows, LinearModel(vocab, coefs, [0.0] * 5)).collect()}
    assert out[1]["aspect_food"] > 4.9 and out[1]["aspect_service"] < 1.1
    assert out[1]["aspect_atmosphere"] == out[1]["ai_expected_rating"]
    assert out[2]["ai_expected_rating"] == pytest.approx(3.0) and out[2]["is_anomaly"]
    assert all(1 <= r["ai_expected_rating"] <= 5 and sum(r["probs"]) == pytest.approx(1) for r in out.values())


def test_aspect_sentences(spark):
    rows = spark.createDataFrame([(1, "ร้านบริการดี xyz อาหารสด")], "review_id long, text string")
    got = sorted((r["place"], r["aspect"]) for r in aspects.aspect_sentences(rows).collect())
    assert got == [(0, "atmosphere"), (0, "service"), (2, "food")]


def test_venues(spark):
    rows = spark.createDataFrame(
        [(i, "hot" if i % 3 else f"v{i}", 5, 2.5 if i % 2 else 4.0) for i in range(60)] + [(99, None, 1, 1.0)],
        "review_id long, place_name string, user_rating int, ai_expected_rating double",
    ).withColumn("is_anomaly", F.col("user_rating") - F.col("ai_expected_rating") >= 2)
    assert venues.first_per_venue(rows).filter("place_name = 'hot'").count() == 5
    ids = {r["place_name"]: r["restaurant_id"] for r in venues.venue_ids(rows).collect()}
    assert ids["v0"] == 1 and ids["hot"] == 2 and ids["v3"] == 3
    rolled = venues.rollup(rows)
    hot = rolled.filter("place_name = 'hot'").first()
    assert hot["review_count"] == 40 and hot["has_anomaly"] and hot["avg_ai_rating"] == 3.25
    nested = venues.nest_reviews(rolled, rows)
    assert nested.agg(F.max(F.size("reviews"))).first()[0] == 5
    assert venues.city_counters(rolled).first()["tracked_venues"] == 21
    dealt = venues.assign_venues(rows.select("review_id"))
    assert max(Counter(r["place_name"] for r in dealt.collect()).values()) == 8
    assert venues.search(rolled, "HO", ("place_name",)).count() == 1


def test_profile(spark):
    rows = spark.createDataFrame([(1, "สวย ab", 3), (2, "abc", 3), (3, "abcd", 3)], "review_id long, text string, user_rating int")
    assert profile.script_ratios(rows).first()["thai_ratio"] == round(3 / 13, 4)
    stats = {r["star"]: r for r in profile.length_stats(rows).collect()}
    assert stats[3]["median"] == 4.0 and stats[3]["p90"] == pytest.approx(5.6) and stats[1]["n"] == 0
    top = spark.createDataFrame([(3, w) for w in "abc"] + [(4, w) for w in "bcd"], "star int, token string")
    assert {r["pair"]: r["jaccard"] for r in profile.token_overlap(top).collect()} == {"3_4": 0.5, "3_5": 0.0, "4_5": 0.0}


def test_fingerprint_depends_on_order_and_text(spark):
    def of(pairs):
        return cache.corpus_fingerprint(spark.createDataFrame(pairs, "review_id long, text string"), fanout=4, least_levels=3).first()[0]

    base = of([(i, f"t{i}") for i in range(40)])
    assert base == of([(i, f"t{i}") for i in reversed(range(40))])
    assert base != of([(i, f"t{i}") for i in range(39)] + [(39, "other")])
    assert base != of([(39 - i, f"t{i}") for i in range(40)])


def test_cache_split(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "review_id long, text string")
    key = hashlib.sha256(b"m|s|a").hexdigest()
    stored = spark.createDataFrame([(key, [1.0])], "cache_key string, embedding array<float>")
    hits, missing = cache.split_hits(rows, stored, "m", "s")
    assert [r["review_id"] for r in hits.collect()] == [1]
    assert sorted(r["text"] for r in missing.collect()) == ["b", "c"]
    assert cache.split_hits(rows, stored, "m", "other")[0].count() == 0


def test_user_functions(spark):
    rows = spark.createDataFrame([(1, "Abc"), (2, None)], "review_id long, text string")
    shout = hooks.normaliser(lambda s: s.upper() + "!")
    assert [r[0] for r in rows.orderBy("review_id").select(shout("text")).collect()] == ["ABC!", "!"]
    letters = hooks.tokenizer(list)
    assert rows.filter("review_id = 1").select(letters("text")).first()[0] == ["A", "b", "c"]
    scored = hooks.score_with(rows.fillna(""), lambda: lambda texts: np.tile([0, 0, 0, 0, 1.0], (len(texts), 1)))
    assert [r["ai_expected_rating"] for r in scored.collect()] == [5.0, 5.0]
    vectors = hooks.encode_with(rows.fillna(""), lambda: lambda texts: np.array([[3.0, 4.0]] * len(texts)))
    assert vectors.first()["embedding"] == pytest.approx([0.6, 0.8])


def test_early_stopping(spark):
    maes = [0.9, 0.7, 0.8, 0.75, 0.71, 0.5]
    epochs = spark.createDataFrame([("r", i + 1, m) for i, m in enumerate(maes)], "run_id string, epoch int, val_mae double")
    out = experiments.early_stopping(epochs).orderBy("epoch").collect()
    assert [r["best_mae"] for r in out] == [0.9, 0.7, 0.7, 0.7, 0.7, 0.5]
    assert [r["stale_epochs"] for r in out] == [0, 0, 1, 2, 3, 0] and out[0]["stop_epoch"] == 5
    assert [r["was_run"] for r in out] == [True] * 5 + [False]


def test_unknown_tokens_are_not_digested(spark, synonyms):
    """The digest of a swap stands behind the test for a synonym, and shuffled tokens need no comparing lambda."""
    rows = spark.createDataFrame([(1, 0, "bad bad day"), (None, 0, "bad old day")], "review_id long, copy int, text string")
    plan = augment.augment_text(rows, synonyms)._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
    got = augment.shuffle_tokens(rows, synonyms, 1.0)

    def shuffled(i, text):
        seed = ":".join(["42:order", *([] if i is None else [str(i)]), "0"])
        words = [w for part in text.split(" ") for w in (part, " ")][:-1]
        return "".join(w for _, _, w in sorted((hashlib.md5(f"{seed}:{p}".encode()).hexdigest(), p, w) for p, w in enumerate(words)))

    assert {r["review_id"]: r["text"] for r in got.collect()} == {1: shuffled(1, "bad bad day"), None: shuffled(None, "bad old day")}
