"""Queries on dataset profiles and experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens.catalog import sqltext as Q
from starlens.catalog.base import MODELS, chats, expectation, part, query, reviews, table
from starlens.catalog.evaluation import rounded
from starlens.catalog.text import cleaned, standard
from starlens.functions import text as T
from starlens.operators import clean, experiments as E, metrics as M, profile as P, resample
from starlens.operators.once import compute_once
from starlens.plans.profile import profile_dataset
from starlens.session import stage


@query(
    "a22_script_ratios",
    """SELECT round(sum(len(regexp_extract_all(text, '[\\x{0E00}-\\x{0E7F}]'))) / sum(length(text)), 4) AS thai_ratio,
              round(sum(len(regexp_extract_all(text, '[A-Za-z]'))) / sum(length(text)), 4) AS latin_ratio FROM standard""",
)
def a22(spark, folder):
    return P.script_ratios(standard(spark, folder))


@query(
    "a23_length_stats",
    """SELECT user_rating AS star, count(*) AS n, quantile_cont(length(text), 0.5) AS median, round(quantile_cont(length(text), 0.9), 6) AS p90
       FROM standard GROUP BY user_rating""",
)
def a23(spark, folder):
    return rounded(P.length_stats(standard(spark, folder)), "p90")


part("clean_tokens", f"SELECT review_id, user_rating, unnest({Q.tokens(Q.extended('text'))}) AS token FROM standard")
part("token_uses", "SELECT user_rating AS star, token, count(*) AS uses FROM clean_tokens WHERE length(token) > 1 GROUP BY ALL")
part(
    "token_ranks",
    "SELECT *, CAST(row_number() OVER (PARTITION BY star ORDER BY uses DESC, encode(token)) AS INTEGER) AS rank FROM token_uses",
)


@query("a24_star_tokens", "SELECT * FROM token_uses")
def a24(spark, folder):
    return P.star_tokens(standard(spark, folder))


@query("w05_top_tokens", "SELECT star, token, uses, rank FROM token_ranks WHERE rank <= 15")
def w05(spark, folder):
    return P.top_tokens(P.star_tokens(standard(spark, folder)))


@query(
    "u07_token_overlap",
    """SELECT a.star || '_' || b.star AS pair, round(count(*) FILTER (a.token = b.token) / (30 - count(*) FILTER (a.token = b.token)), 4) AS jaccard
       FROM token_ranks a JOIN token_ranks b ON a.star < b.star AND a.star >= 3 AND a.rank <= 15 AND b.rank <= 15 GROUP BY a.star, b.star""",
)
def u07(spark, folder):
    return P.token_overlap(P.top_tokens(P.star_tokens(standard(spark, folder))))


def chat_texts(spark, folder):
    return compute_once(chats(spark, folder), "text", T.extended(F.col("review_body")))


part("chat_vocab", f"SELECT DISTINCT unnest({Q.tokens(Q.extended(Q.extended('review_body')))}) AS token FROM chats")
part("review_vocab", "SELECT DISTINCT token FROM clean_tokens")


@query(
    "u05_vocabulary_coverage",
    """SELECT (SELECT count(*) FROM chat_vocab) AS left_vocabulary, (SELECT count(*) FROM review_vocab) AS right_vocabulary, count(*) AS shared,
              round(count(*) / greatest((SELECT count(*) FROM chat_vocab), 1), 4) AS coverage FROM chat_vocab SEMI JOIN review_vocab USING (token)""",
)
def u05(spark, folder):
    return P.vocabulary_coverage(P.vocabulary(chat_texts(spark, folder)), P.vocabulary(standard(spark, folder)))


@query("u06_vocabulary_only", "SELECT token FROM chat_vocab ANTI JOIN review_vocab USING (token) ORDER BY encode(token) LIMIT 30")
def u06(spark, folder):
    return P.vocabulary_only(P.vocabulary(chat_texts(spark, folder)), P.vocabulary(standard(spark, folder)))


@query(
    "w03_sample_reviews",
    """SELECT review_id, user_rating, substring(text, 1, 200) AS text FROM (
         SELECT *, row_number() OVER (PARTITION BY user_rating ORDER BY review_id) AS rn FROM standard) WHERE rn <= 2""",
)
def w03(spark, folder):
    return P.sample_reviews(standard(spark, folder))


@query(
    "w04_first_per_star",
    """SELECT review_id, user_rating FROM (SELECT *, row_number() OVER (PARTITION BY stars ORDER BY review_id) AS rn, stars AS user_rating FROM reviews)
       WHERE rn <= 100""",
)
def w04(spark, folder):
    df = reviews(spark, folder).select("review_id", F.col("stars").alias("user_rating"))
    return P.first_per_star(df, 100)


part(
    "profile_rows",
    """
    SELECT 'initial_rows' AS item, '' AS star, CAST(count(*) AS DOUBLE) AS value FROM standard
    UNION ALL SELECT 'final_rows', '', count(*) FROM clean
    UNION ALL SELECT 'star_count', CAST(user_rating AS VARCHAR), count(*) FROM clean GROUP BY user_rating
    UNION ALL SELECT 'star_pct', CAST(user_rating AS VARCHAR), round(100e0 * count(*) / sum(count(*)) OVER (), 2) FROM clean GROUP BY user_rating
    UNION ALL SELECT 'length_median', CAST(user_rating AS VARCHAR), quantile_cont(length(text), 0.5) FROM clean GROUP BY user_rating
    UNION ALL SELECT 'length_p90', CAST(user_rating AS VARCHAR), round(quantile_cont(length(text), 0.9), 4) FROM clean GROUP BY user_rating
    UNION ALL SELECT 'thai_ratio', '', round(sum(len(regexp_extract_all(text, '[\\x{0E00}-\\x{0E7F}]'))) / sum(length(text)), 4) FROM clean
    UNION ALL SELECT 'latin_ratio', '', round(sum(len(regexp_extract_all(text, '[A-Za-z]'))) / sum(length(text)), 4) FROM clean
    """,
)


@query("q09_s20_profile", "SELECT * FROM profile_rows")
def q09(spark, folder):
    return profile_dataset(standard(spark, folder)).summary


# --- strategies side by side ------------------------------------------------------

_NAMES = ("extended", "default", "minimal", "aggressive", "keep_digits", "emoji_tag", "segment")
part(
    "strategy_rows",
    " UNION ALL ".join(f"""SELECT '{n}' AS strategy, review_id, "{n}" AS text FROM strategy_texts""" for n in _NAMES),
)


@query(
    "q13_strategy_comparison",
    """SELECT strategy, count(*) AS initial_rows, count(*) FILTER (length(text) = 0) AS removed_empty,
              count(*) FILTER (length(text) BETWEEN 1 AND 39) AS removed_short,
              count(*) FILTER (length(text) >= 40) - count(DISTINCT text) FILTER (length(text) >= 40) AS removed_duplicate,
              count(DISTINCT text) FILTER (length(text) >= 40) AS final_rows FROM strategy_rows GROUP BY strategy""",
)
def q13(spark, folder):
    from starlens.plans.strategies import compare_strategies

    return compare_strategies(reviews(spark, folder), "review_body", _NAMES, min_length=40)


# --- experiment tables, derived from the evaluated reviews -------------------------

# variants = multipliers of the stand-in expectation; two of them fail.
VARIANTS = [(f"v{i:02d}", 3 + 4 * i, 5 + 6 * i) for i in range(12)]
FAILED = ("v04", "v09")


def variant_predictions(spark, folder):
    """(run_id, model, variant, eval_set, user_rating, ai_expected_rating) for every review and variant."""
    options = [
        F.struct(
            F.lit(f"run{i % 2}").alias("run_id"),
            F.lit(MODELS[i % 3][0]).alias("model"),
            F.lit(v).alias("variant"),
            expectation(a, b, "review_id").alias("ai_expected_rating"),
        )
        for i, (v, a, b) in enumerate(VARIANTS)
    ]
    df = reviews(spark, folder).select(
        F.coalesce("place_name", F.lit("none")).alias("eval_set"), F.col("stars").alias("user_rating"), F.explode(F.array(*options)).alias("v")
    )
    return df.select("v.*", "eval_set", "user_rating")


part(
    "variant_rows",
    " UNION ALL ".join(
        f"""SELECT 'run{i % 2}' AS run_id, '{MODELS[i % 3][0]}' AS model, '{v}' AS variant, coalesce(place_name, 'none') AS eval_set, stars AS user_rating,
            1 + ((review_id * {a} + n_chars * {b}) % 401) / 100e0 AS e FROM reviews"""
        for i, (v, a, b) in enumerate(VARIANTS)
    ),
)
part(
    "variant_scores",
    f"""
    SELECT run_id, model, variant, CASE WHEN variant IN {FAILED} THEN 'error' ELSE 'ok' END AS status,
           CASE WHEN variant NOT IN {FAILED} THEN avg(abs(user_rating - e)) END AS mae,
           CASE WHEN variant NOT IN {FAILED} THEN count(*) FILTER (user_rating = greatest(1, least(5, CAST(round_even(e, 0) AS INTEGER)))) / count(*) END AS accuracy,
           CAST(count(*) AS DOUBLE) AS duration_sec
    FROM variant_rows GROUP BY run_id, model, variant
    """,
)


def experiment_results(spark, folder):
    """One row per variant; the failed ones carry no metrics."""
    metrics = M.bundle(variant_predictions(spark, folder), ("run_id", "model", "variant"))
    failed = F.col("variant").isin(*FAILED)
    names = ("mae", "accuracy", "f1_macro", "f1_weighted", "rmse", "off_by_one_accuracy")
    out = metrics.withColumns({n: F.when(~failed, F.col(n)) for n in names})
    return out.select(
        "run_id", "model", "variant", F.lit("vary the expectation").alias("hypothesis"), *names,
        F.col("n_samples").cast("double").alias("duration_sec"),
        F.when(failed, "error").otherwise("ok").alias("status"),
    )


@query(
    "p13_p14_select_results",
    "SELECT variant, status, round(mae, 6) AS mae FROM variant_scores WHERE run_id = 'run1' AND model IN ('baseline', 'embedding')",
)
def p13(spark, folder):
    chosen = E.select_results(experiment_results(spark, folder), ["run1"], ["baseline", "embedding"])
    good, bad = E.split_results(chosen)
    return rounded(good.unionByName(bad).select("variant", "status", "mae"), "mae")


@query(
    "w07_rank_variants",
    """SELECT variant, round(mae, 6) AS mae, CAST(row_number() OVER (ORDER BY mae ASC NULLS LAST, run_id, model, variant) AS INTEGER) AS rank FROM variant_scores""",
)
def w07(spark, folder):
    return rounded(E.rank_by_mae(experiment_results(spark, folder)).select("variant", "mae", "rank"), "mae")


@query(
    "w08_rank_accuracy",
    "SELECT variant, round(accuracy, 6) AS accuracy, CAST(rank() OVER (ORDER BY accuracy DESC) AS INTEGER) AS rank FROM variant_scores WHERE status = 'ok'",
)
def w08(spark, folder):
    good, _ = E.split_results(experiment_results(spark, folder))
    return rounded(E.rank_by_accuracy(good, "variant").select("variant", "accuracy", "rank"), "accuracy")


@query(
    "q11_s16_comparison_export",
    """SELECT CAST(row_number() OVER (ORDER BY mae, run_id, model, variant) AS INTEGER) AS rank, run_id, model, variant, round(mae, 6) AS mae,
              round(accuracy, 6) AS accuracy, duration_sec, status FROM variant_scores WHERE status = 'ok'""",
)
def q11(spark, folder):
    out = E.comparison_export(experiment_results(spark, folder))
    return rounded(out.select("rank", "run_id", "model", "variant", "mae", "accuracy", "duration_sec", "status"), "mae", "accuracy")


@query(
    "a28_sweep_spread",
    """SELECT arg_min(variant, mae) AS best_variant, round(min(mae), 6) AS best_mae, arg_max(variant, mae) AS worst_variant,
              round(max(mae) - min(mae), 6) AS spread, count(mae) AS ok_variants,
              string_agg(variant, ',' ORDER BY variant) FILTER (status <> 'ok') AS failed_variants FROM variant_scores""",
)
def a28(spark, folder):
    return rounded(E.spread(experiment_results(spark, folder)), "best_mae", "spread")


@query(
    "a29_s15_run_index",
    """SELECT run_id, model, count(*) AS variants, count(*) FILTER (status = 'ok') AS ok_variants, count(*) FILTER (status <> 'ok') AS failed_variants,
              sum(duration_sec) AS total_time_sec FROM variant_scores GROUP BY run_id, model""",
)
def a29(spark, folder):
    return E.run_index(experiment_results(spark, folder))


part(
    "set_scores",
    """
    SELECT variant AS candidate, eval_set, count(*) FILTER (user_rating = p) / count(*) AS accuracy,
           least(r1, r2, r3, r4, r5) AS min_recall, f1 FROM (
      SELECT *, {recalls}, ({f1s}) / ({present}) AS f1 FROM (
        SELECT *, greatest(1, least(5, CAST(round_even(e, 0) AS INTEGER))) AS p FROM variant_rows)
      WINDOW w AS (PARTITION BY variant, eval_set))
    GROUP BY ALL
    """.format(
        recalls=", ".join(
            f"coalesce(count(*) FILTER (user_rating = {s} AND p = {s}) OVER w / nullif(count(*) FILTER (user_rating = {s}) OVER w, 0), 0) AS r{s}"
            for s in range(1, 6)
        ),
        f1s=" + ".join(
            f"coalesce(2e0 * count(*) FILTER (user_rating = {s} AND p = {s}) OVER w / nullif(count(*) FILTER (user_rating = {s}) OVER w + count(*) FILTER (p = {s}) OVER w, 0), 0)"
            for s in range(1, 6)
        ),
        present=" + ".join(f"CAST(count(*) FILTER (user_rating = {s} OR p = {s}) OVER w > 0 AS INTEGER)" for s in range(1, 6)),
    ),
)


def candidate_scores(spark, folder):
    per_set = M.bundle(variant_predictions(spark, folder), ("variant", "eval_set")).withColumnRenamed("variant", "candidate")
    return E.candidate_scores(per_set, 0.1)


part(
    "candidates",
    """SELECT candidate, min(accuracy) AS min_accuracy, avg(f1) AS avg_f1, min(min_recall) AS min_class_recall, count(*) AS eval_sets
       FROM set_scores GROUP BY candidate""",
)


@query(
    "a27_p15_candidate_scores",
    """SELECT candidate, round(min_accuracy, 6) AS min_accuracy, round(avg_f1, 6) AS avg_f1, round(min_class_recall, 6) AS min_class_recall,
              eval_sets, min_accuracy > 0.1e0 AS passed_target FROM candidates""",
)
def a27(spark, folder):
    return rounded(candidate_scores(spark, folder), "min_accuracy", "avg_f1", "min_class_recall")


@query(
    "w09_q14_top_candidates",
    "SELECT candidate, round(min_accuracy, 6) AS min_accuracy FROM candidates ORDER BY candidates.min_accuracy DESC, candidate LIMIT 8",
)
def w09(spark, folder):
    return rounded(E.top_candidates(candidate_scores(spark, folder)).select("candidate", "min_accuracy"), "min_accuracy")


@query(
    "a26_fold_summary",
    """SELECT variant AS combination, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std FROM (
         SELECT variant, eval_set, avg(abs(user_rating - e)) AS mae FROM variant_rows GROUP BY ALL) GROUP BY variant""",
)
def a26(spark, folder):
    folds = M.bundle(variant_predictions(spark, folder), ("variant", "eval_set")).withColumnRenamed("variant", "combination")
    return rounded(E.fold_summary(folds, ["mae"]), "mae_mean", "mae_std")


part(
    "epochs",
    """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY variant) AS epoch, val_mae FROM (
         SELECT eval_set AS run_id, variant, avg(abs(user_rating - e)) AS val_mae FROM variant_rows GROUP BY ALL)""",
)
part(
    "epoch_marks",
    """SELECT *, min(val_mae) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM epochs""",
)
part(
    "epoch_best",
    """SELECT *, max(CASE WHEN before IS NULL OR val_mae < before THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS best_epoch FROM epoch_marks""",
)


@query(
    "w22_early_stopping",
    """SELECT run_id, epoch, round(least(val_mae, coalesce(before, val_mae)), 6) AS best_mae, best_epoch, epoch - best_epoch AS stale_epochs,
              min(epoch) FILTER (epoch - best_epoch >= 3) OVER (PARTITION BY run_id) AS stop_epoch FROM epoch_best""",
)
def w22(spark, folder):
    from pyspark.sql import Window as W

    logged = M.bundle(variant_predictions(spark, folder), ("variant", "eval_set"))
    # Every evaluation set stands for a run, its variants in order for the epochs.
    epochs = logged.select(
        F.col("eval_set").alias("run_id"),
        F.row_number().over(W.partitionBy("eval_set").orderBy("variant")).cast("long").alias("epoch"),
        F.col("mae").alias("val_mae"),
    )
    out = E.early_stopping(epochs)
    return rounded(out.select("run_id", "epoch", "best_mae", "best_epoch", "stale_epochs", "stop_epoch"), "best_mae")
