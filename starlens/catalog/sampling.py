"""Queries on splits, folds, samples, replication and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.catalog import sqltext as Q
from starlens.catalog.base import chats, part, query, quote, reviews, table
from starlens.catalog.text import cleaned, standard
from starlens.functions import text as T
from starlens.operators import augment, clean, distribution, pairs, resample
from starlens.params import Params
from starlens.operators.once import compute_once
from starlens.plans.training_set import prepare_training_set
from starlens.session import stage


DEFAULTS = Params()


def ids(spark, folder):
    return reviews(spark, folder).select("review_id", F.col("stars").alias("user_rating"))


part("ids", "SELECT review_id, stars AS user_rating FROM reviews")
part(
    "ranked",
    """SELECT *, row_number() OVER (PARTITION BY user_rating ORDER BY md5('42:' || review_id)) AS rn,
              count(*) OVER (PARTITION BY user_rating) AS n FROM ids""",
)
part("holdout_sizes", "SELECT *, CAST(round_even(0.2e0 * n, 0) AS BIGINT) AS h FROM ranked")
part(
    "split_rows",
    """SELECT review_id, user_rating, CASE WHEN rn <= h THEN 'holdout'
              WHEN rn <= h + CAST(round_even(0.2e0 * (n - h), 0) AS BIGINT) THEN 'validation' ELSE 'train' END AS split FROM holdout_sizes""",
)


@query("w12_holdout_split", "SELECT * FROM split_rows")
def w12(spark, folder):
    return resample.holdout_split(ids(spark, folder))


@query(
    "w13_kfold",
    "SELECT review_id, user_rating, CAST(ntile(5) OVER (PARTITION BY user_rating ORDER BY md5('42:' || review_id)) - 1 AS INTEGER) AS fold FROM ids",
)
def w13(spark, folder):
    return resample.kfold(ids(spark, folder))


@query(
    "w14_undersample",
    "SELECT review_id, user_rating FROM ranked WHERE user_rating <> 4 OR rn <= round_even(0.65e0 * n, 0)",
)
def w14(spark, folder):
    return resample.undersample_star(ids(spark, folder), 4, 0.65)


@query("w15_sample_rows", "SELECT review_id, user_rating FROM ids ORDER BY md5('42:' || review_id) LIMIT 333")
def w15(spark, folder):
    return resample.sample_rows(ids(spark, folder), 333)


@query("w16_shuffle", "SELECT review_id, user_rating, row_number() OVER (ORDER BY md5('42:' || review_id)) AS position FROM ids")
def w16(spark, folder):
    return resample.shuffle_rows(ids(spark, folder))


@query(
    "w17_stratified_reduce",
    "SELECT review_id, user_rating FROM ranked WHERE rn <= round_even(500e0 / (SELECT count(*) FROM ids) * n, 0)",
)
def w17(spark, folder):
    return resample.stratified_reduce(ids(spark, folder), 500)


@query(
    "w20_first_rows_split",
    """SELECT review_id, CASE WHEN row_number() OVER (ORDER BY review_id) <= greatest(200, floor(0.2e0 * count(*) OVER ()))
              THEN 'test' ELSE 'train' END AS split FROM ids""",
)
def w20(spark, folder):
    return resample.first_rows_split(ids(spark, folder)).select("review_id", "split")


@query(
    "u04_oversample",
    "SELECT review_id, user_rating, CAST(unnest(range(0, CASE WHEN user_rating <= 2 THEN 5 ELSE 1 END)) AS INTEGER) AS copy FROM ids",
)
def u04(spark, folder):
    return resample.oversample_low_stars(ids(spark, folder), 5)


@query(
    "u01_u02_union",
    """SELECT CAST(review_id AS VARCHAR) AS review_id, review_body, stars, place_name FROM reviews
       UNION ALL SELECT review_id, review_body, stars, NULL FROM chats""",
)
def u01(spark, folder):
    first = reviews(spark, folder).drop("n_chars").withColumn("review_id", F.col("review_id").cast("string"))
    return resample.union_sources(first, chats(spark, folder))


def mock(spark, folder):
    """Cleaned mock reviews."""
    raw = table(spark, folder, "benchmark").select(
        (-1 - F.col("item_id")).alias("review_id"),
        "text",
        (F.col("item_id") % 5 + 1).cast("int").alias("user_rating"),
    )
    return clean.clean_reviews(compute_once(raw, "text", T.extended(F.col("text"))))


part(
    "mock",
    f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY review_id) AS rn FROM (
          SELECT -1 - item_id AS review_id, {Q.extended("text")} AS text, CAST(item_id % 5 + 1 AS INTEGER) AS user_rating FROM benchmark)
          WHERE length(text) >= 5) WHERE rn = 1""",
)
part(
    "mixed",
    f"""SELECT review_id, text, user_rating FROM clean UNION ALL
       SELECT review_id, text, user_rating FROM (SELECT *, row_number() OVER (ORDER BY md5('42:' || review_id)) AS rn FROM mock)
       WHERE rn <= greatest(1, CAST(floor({DEFAULTS.mock_fraction}e0 * (SELECT count(*) FROM clean)) AS BIGINT))""",
)


@query("u03_mix_mock", "SELECT * FROM mixed")
def u03(spark, folder):
    base = stage(cleaned(spark, folder).select("review_id", "text", "user_rating"))
    return resample.mix_mock(base, mock(spark, folder), DEFAULTS.mock_fraction)


@query(
    "q12_merge_reduce",
    """SELECT review_id, stars FROM (
         SELECT *, row_number() OVER (PARTITION BY stars ORDER BY md5('42:' || review_id)) AS rn, count(*) OVER (PARTITION BY stars) AS n,
                count(*) OVER () AS everything
         FROM (SELECT CAST(review_id AS VARCHAR) AS review_id, stars FROM reviews UNION ALL SELECT review_id, stars FROM chats))
       WHERE rn <= round_even(700e0 / everything * n, 0)""",
)
def q12(spark, folder):
    first = reviews(spark, folder).select(F.col("review_id").cast("string").alias("review_id"), "stars")
    merged = resample.union_sources(first, chats(spark, folder).select("review_id", "stars"))
    return resample.stratified_reduce(merged, 700, star="stars")


@query(
    "a31_reduction_shares",
    """SELECT stars AS star, round(100e0 * count(*) / sum(count(*)) OVER (), 6) AS before_pct,
              round(100e0 * count(*) FILTER (rn <= k) / sum(count(*) FILTER (rn <= k)) OVER (), 6) AS after_pct
       FROM (SELECT *, round_even(500e0 / (SELECT count(*) FROM reviews) * n, 0) AS k FROM (
               SELECT stars, row_number() OVER (PARTITION BY stars ORDER BY md5('42:' || review_id)) AS rn, count(*) OVER (PARTITION BY stars) AS n FROM reviews))
       GROUP BY stars""",
)
def a31(spark, folder):
    before = ids(spark, folder)
    shares = distribution.compare_distributions(before, resample.stratified_reduce(before, 500))
    return shares.select("star", F.round("train_pct", 6).alias("before_pct"), F.round("test_pct", 6).alias("after_pct"))


# --- augmentation -------------------------------------------------------------

# A small synonym table.
SYNONYMS = {
    "the": ("a", "this"), "and": ("plus",), "la": ("une", "cette"), "de": ("du",), "on": ("upon", "over"),
    "แย่มาก": ("เลวร้าย", "ห่วยแตก"), "บริการ": ("การดูแล",), "อาหาร": ("กับข้าว", "ของกิน", "มื้ออาหาร"),
}


def synonyms(spark):
    rows = [F.struct(F.lit(w).alias("token"), F.array(*[F.lit(s) for s in ss]).alias("choices")) for w, ss in SYNONYMS.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


part(
    "synonyms",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({quote(w)}, [{', '.join(quote(s) for s in ss)}])" for w, ss in SYNONYMS.items())
    + ") AS v(token, choices)",
)


def hash_int(seed: str, *parts: str) -> str:
    joined = " || ':' || ".join([quote(seed), *parts])
    return f"CAST('0x' || substr(md5({joined}), 1, 15) AS BIGINT)"


def augmented_parts(prefix: str, source: str, seed: int = 42) -> None:
    """Parts <prefix>_new (review_id, copy, text, user_rating): rewritten texts of a source of copies."""
    key = ("review_id", "copy")
    place = ("review_id", "copy", "pos")
    part(
        f"{prefix}_drawn",
        f"""SELECT *, {hash_int(f'{seed}:technique', *key)} % 3 AS technique, {Q.tokens('text')} AS words FROM {source}""",
    )
    part(
        f"{prefix}_tokens",
        f"""SELECT review_id, copy, technique, len(words) AS many, unnest(range(0, len(words))) AS pos, unnest(words) AS token FROM {prefix}_drawn""",
    )
    part(
        f"{prefix}_swapped",
        f"""SELECT review_id, copy, t.pos,
                   CASE WHEN technique IN (0, 2) AND many >= 2 AND length(t.token) > 1 AND len(choices) > 0
                         AND {hash_int(f'{seed}:swap', *place)} / 1152921504606846976e0 < {DEFAULTS.synonym_prob}e0
                        THEN choices[{hash_int(f'{seed}:pick', *place)} % len(choices) + 1] ELSE t.token END AS token,
                   CASE WHEN technique IN (1, 2) AND many >= 3 THEN md5('{seed}:order:' || review_id || ':' || copy || ':' || pos) ELSE '' END AS ord
            FROM {prefix}_tokens t LEFT JOIN synonyms s ON s.token = t.token""",
    )
    part(
        f"{prefix}_new",
        f"""SELECT d.review_id, d.copy, coalesce(x.new_text, d.text) AS text, d.user_rating FROM {prefix}_drawn d LEFT JOIN (
              SELECT review_id, copy, string_agg(token, '' ORDER BY ord, pos) AS new_text FROM {prefix}_swapped GROUP BY review_id, copy) x
            ON x.review_id = d.review_id AND x.copy = d.copy""",
    )


def robin_part(name: str, source: str, target: int) -> None:
    part(
        name,
        f"""SELECT review_id, CAST(unnest(range(1, CAST(uses AS BIGINT) + 1)) AS INTEGER) AS copy, text, user_rating FROM (
              SELECT *, ({target} - n) // n + CASE WHEN place < ({target} - n) % n THEN 1 ELSE 0 END AS uses FROM (
                SELECT *, row_number() OVER (PARTITION BY user_rating ORDER BY review_id) - 1 AS place,
                       count(*) OVER (PARTITION BY user_rating) AS n FROM {source}) WHERE user_rating <= 3 AND n < {target})""",
    )


robin_part("robin_copies", "clean", DEFAULTS.augment_target)
augmented_parts("aug", "robin_copies")


@query("j06_round_robin", "SELECT review_id, copy, user_rating FROM robin_copies")
def j06(spark, folder):
    base = cleaned(spark, folder).select("review_id", "text", "user_rating")
    return augment.round_robin_copies(base, target=DEFAULTS.augment_target).select("review_id", "copy", "user_rating")


@query(
    "q03_q04_augment_minority",
    "SELECT review_id, 0 AS copy, text, user_rating FROM clean UNION ALL SELECT * FROM aug_new",
)
def q03(spark, folder):
    base = cleaned(spark, folder).select("review_id", "text", "user_rating")
    return augment.augment_minority(base, synonyms(spark), target=DEFAULTS.augment_target)


part("every_text", "SELECT review_id, 0 AS copy, text, user_rating FROM standard")
augmented_parts("every", "every_text")


@query("j07_q04_augment_text", "SELECT review_id, copy, text FROM every_new")
def q04(spark, folder):
    rows = standard(spark, folder).select("review_id", F.lit(0).alias("copy"), "text", "user_rating")
    return augment.augment_text(rows, synonyms(spark)).select("review_id", "copy", "text")


part(
    "error_copies",
    """SELECT s.review_id, CAST(unnest([1, 2]) AS INTEGER) AS copy, s.text, s.user_rating FROM standard s JOIN rated r USING (review_id)
       WHERE abs(greatest(1, least(5, CAST(round_even(r.ai_expected_rating, 0) AS INTEGER))) - s.user_rating) >= 2""",
)
augmented_parts("err", "error_copies")


@query(
    "s07_q05_augment_errors",
    "SELECT review_id, 0 AS copy, text, user_rating FROM standard UNION ALL SELECT * FROM err_new",
)
def q05(spark, folder):
    from starlens.catalog.base import MODELS, expectation
    from starlens.operators import errors

    _, a, b = MODELS[0]
    scored = standard(spark, folder).withColumn("ai_expected_rating", expectation(a, b, "review_id"))
    base = scored.select("review_id", "text", "user_rating")
    return augment.augment_errors(base, errors.severe_errors(scored), synonyms(spark))


part(
    "under",
    """SELECT review_id, text, user_rating FROM (
         SELECT *, row_number() OVER (PARTITION BY user_rating ORDER BY md5('42:' || review_id)) AS rn, count(*) OVER (PARTITION BY user_rating) AS n FROM mixed)
       WHERE user_rating <> 4 OR rn <= round_even(0.65e0 * n, 0)""",
)
part(
    "over",
    f"SELECT review_id, text, user_rating, CAST(unnest(range(0, CASE WHEN user_rating <= 2 THEN {DEFAULTS.oversample_factor} ELSE 1 END)) AS INTEGER) AS copy FROM under",
)
part("over_keys", "SELECT review_id * 10 + copy AS review_id, text, user_rating FROM over")


robin_part("train_copies", "over_keys", DEFAULTS.augment_target)
augmented_parts("train", "train_copies")


@query(
    "q02_training_set",
    "SELECT review_id, copy, substring(text, 1, 500) AS text, user_rating FROM (SELECT review_id, 0 AS copy, text, user_rating FROM over_keys UNION ALL SELECT * FROM train_new)",
)
def q02(spark, folder):
    base = cleaned(spark, folder).select("review_id", "text", "user_rating")
    return prepare_training_set(base, mock(spark, folder), synonyms(spark), DEFAULTS)


# --- pairs --------------------------------------------------------------------

part(
    "star_numbers",
    """SELECT review_id, user_rating, row_number() OVER (PARTITION BY user_rating ORDER BY md5('42:' || review_id)) AS number FROM ids""",
)
part("star_sizes", "SELECT user_rating AS star, count(*) AS n FROM ids GROUP BY user_rating")
part(
    "other_stars",
    "SELECT a.star, list(struct_pack(star := b.star, n := b.n) ORDER BY b.star) AS others FROM star_sizes a JOIN star_sizes b ON a.star <> b.star GROUP BY a.star",
)
part(
    "draws",
    f"""SELECT i.review_id, i.user_rating, {hash_int('42:positive', 'i.review_id', '0')} % s.n + 1 AS positive_number,
               o.others[{hash_int('42:star', 'i.review_id', '0')} % len(o.others) + 1] AS other,
               {hash_int('42:negative', 'i.review_id', '0')} AS negative_draw
        FROM ids i JOIN star_sizes s ON s.star = i.user_rating JOIN other_stars o ON o.star = i.user_rating""",
)


@query(
    "j08_triplets",
    """SELECT d.review_id AS anchor_id, 0 AS pair, p.review_id AS positive_id, n.review_id AS negative_id FROM draws d
       JOIN star_numbers p ON p.user_rating = d.user_rating AND p.number = d.positive_number
       JOIN star_numbers n ON n.user_rating = d.other.star AND n.number = d.negative_draw % d.other.n + 1""",
)
def j08(spark, folder):
    return pairs.triplet_ids(ids(spark, folder))


@query("m18_supervised_examples", "SELECT review_id, text, user_rating - 1 AS label FROM standard")
def m18(spark, folder):
    return pairs.supervised_examples(standard(spark, folder))
