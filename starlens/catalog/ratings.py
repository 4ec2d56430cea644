"""Queries on ratings, cleaning, distributions and probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens import lexicon
from starlens.catalog import sqltext as Q
from starlens.catalog.base import chats, part, query, rated, reviews, table
from starlens.catalog.text import cleaned, standard
from starlens.functions import ratings as R
from starlens.functions import text as T
from starlens.operators import clean, distribution, standard as S
from starlens.operators.once import compute_once
from starlens.session import spread

STAR_LIST = "(VALUES (1), (2), (3), (4), (5)) AS stars5(star)"


def raw_ratings(spark, folder):
    """Reviews whose rating is text, some of it malformed or out of range."""
    k = F.col("review_id") % 10
    raw = (
        F.when(k == 0, "bad").when(k == 1, "2.5").when(k == 2, " 4 ").when(k == 3, "3.5").when(k == 4, "1d")
        .when(k == 5, F.lit(None)).when(k == 6, "4.5").when(k == 7, "inf").when(k == 8, "6")
        .otherwise(F.col("stars").cast("string"))
    )
    return reviews(spark, folder).select("review_id", F.col("review_body").alias("Review"), raw.alias("STARS"), "place_name")


part(
    "raw_ratings",
    """
    SELECT review_id, review_body AS text, place_name,
           CASE review_id % 10 WHEN 0 THEN 'bad' WHEN 1 THEN '2.5' WHEN 2 THEN ' 4 ' WHEN 3 THEN '3.5' WHEN 4 THEN '1d'
                WHEN 5 THEN NULL WHEN 6 THEN '4.5' WHEN 7 THEN 'inf' WHEN 8 THEN '6' ELSE CAST(stars AS VARCHAR) END AS raw
    FROM reviews
    """,
)
part(
    "coerced",
    r"""
    SELECT review_id, text, place_name, CAST(round_even(CAST(trim(raw) AS DOUBLE), 0) AS INTEGER) AS user_rating
    FROM raw_ratings WHERE regexp_matches(raw, '^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$')
    """,
)


@query("p01_p02_coerce_ratings", "SELECT review_id, user_rating FROM coerced")
def p01(spark, folder):
    return S.coerce_ratings(S.resolve_columns(raw_ratings(spark, folder))).select("review_id", "user_rating")


@query(
    "p03_range_quarantine",
    "SELECT review_id, user_rating, user_rating BETWEEN 1 AND 5 AS accepted FROM coerced",
)
def p03(spark, folder):
    inside, outside = S.split_range(S.coerce_ratings(S.resolve_columns(raw_ratings(spark, folder))))
    return inside.select("review_id", "user_rating", F.lit(True).alias("accepted")).unionByName(
        outside.select("review_id", "user_rating", F.lit(False).alias("accepted"))
    )


@query(
    "s04_s05_standardise",
    f"SELECT review_id, {Q.extended('text')} AS text, user_rating, place_name FROM coerced WHERE user_rating BETWEEN 1 AND 5",
)
def s04(spark, folder):
    return S.standardise(raw_ratings(spark, folder), on_invalid="drop")


@query(
    "s03_p11_parquet_splits",
    "SELECT doc_id AS review_id, text AS review, quality + 1 AS rating FROM documents JOIN labels USING (doc_id)",
)
def s03(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stars = table(spark, folder, "labels").select("doc_id", "quality")
    joined = docs.join(stars, "doc_id")
    return joined.select(
        F.col("doc_id").alias("review_id"), F.col("text").alias("review"), (F.col("quality") + 1).alias("rating")
    )


@query("p04_p05_filter_short", "SELECT review_id, length(text) AS chars FROM standard WHERE length(text) > 0 AND length(text) >= 40")
def p04(spark, folder):
    kept = clean.drop_short(clean.drop_empty(standard(spark, folder)), 40)
    return kept.select("review_id", F.length("text").cast("long").alias("chars"))


part("plain_texts", f"SELECT doc_id AS review_id, {Q.normalize('text')} AS text FROM documents")


def plain_texts(spark, folder):
    docs = spread(table(spark, folder, "documents"), "doc_id").select(F.col("doc_id").alias("review_id"), "text")
    return compute_once(docs, "text", T.normalize(F.col("text")))


for _keep, _sql in {
    "first": "SELECT min(review_id) AS review_id, text FROM plain_texts GROUP BY text",
    "last": "SELECT max(review_id) AS review_id, text FROM plain_texts GROUP BY text",
    "none": "SELECT min(review_id) AS review_id, text FROM plain_texts GROUP BY text HAVING count(*) = 1",
}.items():

    @query(f"w01_dedup_{_keep}", _sql)
    def w01(spark, folder, keep=_keep):
        return clean.drop_duplicates(plain_texts(spark, folder), keep)


part(
    "clean_stats",
    """
    SELECT count(*) AS initial_rows,
           count(*) FILTER (length(text) = 0) AS removed_empty,
           count(*) FILTER (length(text) BETWEEN 1 AND 39) AS removed_short,
           count(*) FILTER (length(text) >= 40) - count(DISTINCT text) FILTER (length(text) >= 40) AS removed_duplicate,
           count(DISTINCT text) FILTER (length(text) >= 40) AS final_rows
    FROM plain_texts
    """,
)


@query("a01_cleaning_stats", "SELECT * FROM clean_stats")
def a01(spark, folder):
    return clean.cleaning_stats(plain_texts(spark, folder), min_length=40)


@query("q01_standardise_clean", "SELECT review_id, text, user_rating, place_name FROM clean")
def q01(spark, folder):
    return cleaned(spark, folder).drop("n_chars")


@query(
    "a02_rating_distribution",
    f"""SELECT star, count(review_id) AS reviews FROM {STAR_LIST}
        LEFT JOIN (SELECT review_id, stars FROM reviews) r ON r.stars = star GROUP BY star""",
)
def a02(spark, folder):
    return distribution.rating_distribution(reviews(spark, folder), "stars")


@query(
    "a03_rating_shares",
    """SELECT r.stars AS star, count(*) AS reviews, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct
       FROM reviews r GROUP BY r.stars""",
)
def a03(spark, folder):
    return distribution.rating_shares(reviews(spark, folder), "stars").withColumn("share_pct", F.round("share_pct", 6))


@query(
    "j13_a04_compare_distributions",
    f"""
    SELECT star, train_reviews, test_reviews, round(train_pct, 6) AS train_pct, round(test_pct, 6) AS test_pct,
           round(test_pct - train_pct, 6) AS delta_pp
    FROM (SELECT star, (SELECT count(*) FROM reviews WHERE stars = star) AS train_reviews,
                 (SELECT count(*) FROM chats WHERE stars = star) AS test_reviews,
                 100e0 * (SELECT count(*) FROM reviews WHERE stars = star) / (SELECT count(*) FROM reviews) AS train_pct,
                 100e0 * (SELECT count(*) FROM chats WHERE stars = star) / (SELECT count(*) FROM chats) AS test_pct
          FROM {STAR_LIST})
    """,
)
def j13(spark, folder):
    out = distribution.compare_distributions(reviews(spark, folder), chats(spark, folder), "stars")
    return out.withColumns({c: F.round(c, 6) for c in ("train_pct", "test_pct", "delta_pp")})


@query(
    "a05_class_weights",
    """SELECT stars - 1 AS label, count(*) AS reviews,
              round((SELECT count(*) FROM reviews) / (5e0 * count(*)) * CASE WHEN stars <= 2 THEN 3 ELSE 1 END, 6) AS class_weight
       FROM reviews GROUP BY stars""",
)
def a05(spark, folder):
    weights = distribution.class_weights(reviews(spark, folder), "stars", 5, 3.0)
    return weights.withColumn("class_weight", F.round("class_weight", 6))


@query(
    "a05_class_weights_three",
    """SELECT label, count(*) AS reviews,
              round((SELECT count(*) FROM reviews) / (3e0 * count(*)) * CASE WHEN label = 0 THEN 3 ELSE 1 END, 6) AS class_weight
       FROM (SELECT CASE WHEN stars <= 2 THEN 0 WHEN stars = 3 THEN 1 ELSE 2 END AS label FROM reviews) GROUP BY label""",
)
def a05b(spark, folder):
    weights = distribution.class_weights(reviews(spark, folder), "stars", 3, 3.0)
    return weights.withColumn("class_weight", F.round("class_weight", 6))


@query(
    "j01_sample_weights",
    """SELECT review_id, round((SELECT count(*) FROM reviews) / (5e0 * count(*) OVER (PARTITION BY stars)), 6) AS class_weight FROM reviews""",
)
def j01(spark, folder):
    df = reviews(spark, folder)
    weighted = distribution.sample_weights(df, distribution.class_weights(df, "stars"), F.col("stars") - 1)
    return weighted.select("review_id", F.round("class_weight", 6).alias("class_weight"))


_COLOR = "CASE {e} " + " ".join(f"WHEN {s} THEN '{c}'" for s, c in lexicon.STAR_COLORS.items()) + " END"
_EVEN = "greatest(1, least(5, CAST(round_even(ai_expected_rating, 0) AS INTEGER)))"
_UP = "greatest(1, least(5, CAST(floor(ai_expected_rating + 0.5e0) AS INTEGER)))"


@query(
    "p07_p08_delta_anomaly",
    """SELECT review_id, round(abs(user_rating - ai_expected_rating), 6) AS delta,
              abs(user_rating - ai_expected_rating) >= 2e0 AS is_anomaly FROM rated""",
)
def p07(spark, folder):
    user, expected = F.col("user_rating"), F.col("ai_expected_rating")
    return rated(spark, folder).select(
        "review_id",
        F.round(R.rating_delta(user, expected), 6).alias("delta"),
        R.is_anomaly(user, expected).alias("is_anomaly"),
    )


@query(
    "f23_f24_f27_rounding_colors",
    f"""SELECT review_id, {_EVEN} AS star, {_COLOR.format(e=_EVEN)} AS star_color, {_COLOR.format(e=_UP)} AS venue_color,
               floor(ai_expected_rating * 2 + 0.5e0) / 2 AS half_star FROM rated""",
)
def f23(spark, folder):
    e = F.col("ai_expected_rating")
    return rated(spark, folder).select(
        "review_id",
        R.clip_star(e).alias("star"),
        R.star_color(e).alias("star_color"),
        R.venue_color(e).alias("venue_color"),
        R.half_star(e).alias("half_star"),
    )


@query(
    "f22_f25_f26_j11_labels",
    """SELECT review_id, label3, CASE label3 WHEN 0 THEN 1.5e0 WHEN 1 THEN 3e0 ELSE 4.5e0 END AS centre,
              CAST(user_rating - 1 AS DOUBLE) AS label5, round(greatest(1e0, least(5e0, (ai_expected_rating - 1) * 1.5e0)), 6) AS regression_star
       FROM (SELECT *, CASE WHEN user_rating <= 2 THEN 0 WHEN user_rating = 3 THEN 1 ELSE 2 END AS label3 FROM rated)""",
)
def f22(spark, folder):
    star = F.col("user_rating")
    raw = (F.col("ai_expected_rating") - 1) * 1.5 - 1
    return rated(spark, folder).select(
        "review_id",
        R.three_class(star).alias("label3"),
        R.three_class_star(R.three_class(star)).alias("centre"),
        R.training_label(star, "five_class").alias("label5"),
        F.round(R.regression_star(raw), 6).alias("regression_star"),
    )


part(
    "bells",
    "SELECT *, " + ", ".join(f"exp(-(({k} - ai_expected_rating) * ({k} - ai_expected_rating)) / 0.5e0) AS b{k}" for k in lexicon.STARS) + " FROM rated",
)
part(
    "gaussian",
    "SELECT review_id, user_rating, ai_expected_rating, ["
    + ", ".join(f"b{k} / (b1 + b2 + b3 + b4 + b5)" for k in lexicon.STARS)
    + "] AS probs FROM bells",
)
_PROBS = ", ".join(f"round(probs[{k}], 6) AS p{k}" for k in lexicon.STARS)
_EXPECT = " + ".join(f"{k} * probs[{k}]" for k in lexicon.STARS)


def gaussian(spark, folder):
    return rated(spark, folder).withColumn("probs", R.gaussian_probs(F.col("ai_expected_rating")))


@query(
    "f19_f20_f28_gaussian",
    f"""SELECT review_id, {_PROBS}, round({_EXPECT}, 6) AS expected,
               CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS class_index FROM gaussian""",
)
def f19(spark, folder):
    p = F.col("probs")
    return gaussian(spark, folder).select(
        "review_id",
        *[F.round(p[k - 1], 6).alias(f"p{k}") for k in lexicon.STARS],
        F.round(R.expected_rating(p), 6).alias("expected"),
        R.argmax_class(p).alias("class_index"),
    )


@query(
    "f21_softmax",
    """SELECT review_id, round(exp(a - m) / s, 6) AS p1, round(exp(b - m) / s, 6) AS p2, round(exp(c - m) / s, 6) AS p3 FROM (
         SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS s FROM (
           SELECT *, greatest(a, b, c) AS m FROM (
             SELECT review_id, ai_expected_rating AS a, CAST(user_rating AS DOUBLE) AS b, ai_expected_rating - user_rating AS c FROM rated)))""",
)
def f21(spark, folder):
    e, u = F.col("ai_expected_rating"), F.col("user_rating").cast("double")
    p = R.softmax(F.array(e, u, e - u))
    return rated(spark, folder).select("review_id", *[F.round(p[i], 6).alias(f"p{i + 1}") for i in range(3)])
