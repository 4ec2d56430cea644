import math

import pytest
from pyspark.sql import functions as F

from starlens.functions import ratings as R
from starlens.operators import distribution, standard as S


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("x")).alias("y")).collect()]


def test_parse_and_round(spark):
    raw = ["4.5", "2.5", "3", "bad", None, " 5 ", "1d", "inf", "nan", "1e0"]
    assert column(spark, raw, "string", lambda x: R.round_star(R.parse_rating(x))) == [4, 2, 3, None, None, 5, None, None, None, 1]


def test_half_even_and_colors(spark):
    values = [0.5, 1.5, 2.5, 3.5, 4.5, 5.7]
    assert column(spark, values, "double", R.clip_star) == [1, 2, 2, 4, 4, 5]
    assert column(spark, [2.5, None], "double", R.star_color) == ["#ff9800", "#fbc02d"]
    assert column(spark, [2.5], "double", R.venue_color) == ["#fbc02d"]
    assert column(spark, [2.25, 2.7], "double", R.half_star) == [2.5, 2.5]


def test_probabilities(spark):
    assert column(spark, [[0.1, 0.1, 0.2, 0.3, 0.3]], "array<double>", R.expected_rating)[0] == pytest.approx(3.6)
    bell = column(spark, [3.0], "double", R.gaussian_probs)[0]
    assert sum(bell) == pytest.approx(1) and bell[0] == pytest.approx(bell[4]) and bell[1] == pytest.approx(bell[3])
    soft = column(spark, [[1.0, 2.0, 3.0]], "array<double>", R.softmax)[0]
    assert soft[2] == pytest.approx(math.exp(3) / (math.e + math.exp(2) + math.exp(3)))
    assert column(spark, [[0.2, 0.4, 0.4]], "array<double>", R.argmax_class) == [1]


def test_anomaly_boundary(spark):
    rows = spark.createDataFrame([(5, 3.0), (5, 3.01), (4, 2.45)], "u int, e double")
    got = rows.select(R.is_anomaly(F.col("u"), F.col("e")), R.is_severe(F.col("u"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, True), (False, True)]


def test_column_choice():
    assert S.pick_column(["id", "Review", "STARS"], ("review_body", "text", "review"), "text") == "Review"
    assert S.pick_column(["text", "review_body"], ("review_body", "text"), "text") == "text"
    with pytest.raises(ValueError):
        S.pick_column(["a", "b"], ("text",), "text")


def test_out_of_range_fails_or_is_set_aside(spark):
    rows = spark.createDataFrame([(1, "fine text", "3"), (2, "bad text", "6")], "review_id long, text string, rating string")
    with pytest.raises(Exception, match="user_rating must be 1..5"):
        S.standardise(rows).collect()
    assert [r["review_id"] for r in S.standardise(rows, on_invalid="drop").collect()] == [1]


def test_class_weights(spark):
    stars = [1] * 1 + [2] * 1 + [3] * 2 + [4] * 4 + [5] * 2
    rows = spark.createDataFrame([(s,) for s in stars], "user_rating int")
    got = {r["label"]: r["class_weight"] for r in distribution.class_weights(rows, low_star_boost=3.0).collect()}
    assert got == {0: 6.0, 1: 6.0, 2: 1.0, 3: 0.5, 4: 1.0}
    with pytest.raises(Exception, match="class without rows"):
        distribution.class_weights(rows.filter("user_rating <> 2")).collect()


def test_distribution_is_zero_filled(spark):
    rows = spark.createDataFrame([(3,), (3,), (5,)], "user_rating int")
    assert [r["reviews"] for r in distribution.rating_distribution(rows).orderBy("star").collect()] == [0, 0, 2, 0, 1]
    empty = distribution.rating_shares(rows.filter("user_rating = 9"))
    assert {r["share_pct"] for r in empty.collect()} == {0.0}
