"""Queries on model evaluation: metrics, reports, champions, error analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from starlens import lexicon
from starlens.catalog.base import MODEL_NAMES, part, predictions, query, rated, reviews, table
from starlens.catalog.ratings import gaussian
from starlens.functions import ratings as R
from starlens.operators import errors, metrics as M
from starlens.sources import results, sinks


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


part("star_dim", "SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS v(star)")
part(
    "class_numbers",
    """
    SELECT model, model_order, star, count(*) FILTER (user_rating = star AND pred = star) AS hit,
           count(*) FILTER (pred = star) AS predicted, count(*) FILTER (user_rating = star) AS support
    FROM rounded CROSS JOIN star_dim GROUP BY model, model_order, star
    """,
)
part(
    "class_scores",
    """
    SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0e0 END AS prec,
           CASE WHEN support > 0 THEN hit / support ELSE 0e0 END AS rec,
           CASE WHEN predicted + support > 0 THEN 2e0 * hit / (predicted + support) ELSE 0e0 END AS f1
    FROM class_numbers
    """,
)
part(
    "class_means",
    """
    SELECT model, sum(f1) / count(*) FILTER (predicted + support > 0) AS f1_macro,
           sum(f1 * support) / sum(support) AS f1_weighted,
           max(rec) FILTER (star = 1) AS recall_star_1, max(rec) FILTER (star = 2) AS recall_star_2
    FROM class_scores GROUP BY model
    """,
)
part(
    "model_sums",
    """
    SELECT model, model_order, count(*) AS n_samples, sum(d) / count(*) AS mae, sqrt(sum(d * d) / count(*)) AS rmse,
           count(*) FILTER (user_rating = pred) / count(*) AS accuracy,
           count(*) FILTER (abs(user_rating - pred) <= 1) / count(*) AS off_by_one_accuracy,
           count(*) FILTER (d >= 2) AS flags, count(*) FILTER (abs(user_rating - pred) >= 2) AS severes,
           count(*) FILTER (d >= 2 AND abs(user_rating - pred) >= 2) AS joint
    FROM (SELECT *, abs(user_rating - ai_expected_rating) AS d FROM rounded) GROUP BY model, model_order
    """,
)
part(
    "bundle",
    """
    SELECT s.model, s.model_order, n_samples, mae, rmse, accuracy, f1_macro, f1_weighted, off_by_one_accuracy,
           recall_star_1, recall_star_2, flags / n_samples AS anomaly_rate,
           CASE WHEN flags > 0 THEN joint / flags ELSE 0e0 END AS anomaly_precision,
           CASE WHEN severes > 0 THEN joint / severes ELSE 0e0 END AS anomaly_recall,
           CASE WHEN flags + severes > 0 THEN 2e0 * joint / (flags + severes) ELSE 0e0 END AS anomaly_f1,
           severes / n_samples AS severe_error_rate
    FROM model_sums s JOIN class_means c ON s.model = c.model
    """,
)
BUNDLE = (
    "mae", "rmse", "accuracy", "f1_macro", "f1_weighted", "off_by_one_accuracy", "recall_star_1", "recall_star_2",
    "anomaly_rate", "anomaly_precision", "anomaly_recall", "anomaly_f1", "severe_error_rate",
)
_BUNDLE_SQL = ", ".join(f"round({m}, 6) AS {m}" for m in BUNDLE)


def bundle(spark, folder):
    return M.bundle(predictions(spark, folder), ("model", "model_order"))


@query("a08_a17_metric_bundle", f"SELECT model, n_samples, {_BUNDLE_SQL} FROM bundle")
def a17(spark, folder):
    return rounded(bundle(spark, folder).select("model", "n_samples", *BUNDLE), *BUNDLE)


@query(
    "a06_confusion_matrix",
    """SELECT m.model, t.star AS true_star, p.star AS pred_star, count(r.review_id) AS reviews
       FROM (SELECT DISTINCT model FROM rounded) m CROSS JOIN star_dim t CROSS JOIN star_dim p
       LEFT JOIN rounded r ON r.model = m.model AND r.user_rating = t.star AND r.pred = p.star GROUP BY ALL""",
)
def a06(spark, folder):
    return M.confusion_matrix(predictions(spark, folder))


part("cells", "SELECT model, user_rating AS true_star, pred AS pred_star, count(*) AS reviews FROM rounded GROUP BY ALL")


@query(
    "a36_scaled_confusion",
    """SELECT g.model, t.star AS true_star, p.star AS pred_star, coalesce(c.reviews, 0) AS reviews,
              round(coalesce(c.reviews, 0) / greatest(g.top, 1), 6) AS intensity, t.star = p.star AS is_diagonal
       FROM (SELECT model, max(reviews) AS top FROM cells GROUP BY model) g CROSS JOIN star_dim t CROSS JOIN star_dim p
       LEFT JOIN cells c ON c.model = g.model AND c.true_star = t.star AND c.pred_star = p.star""",
)
def a36(spark, folder):
    return rounded(M.confusion_matrix(predictions(spark, folder), scaled=True), "intensity")


@query(
    "a11_a12_class_report",
    """
    SELECT model, CAST(star AS VARCHAR) AS label, round(prec, 6) AS "precision", round(rec, 6) AS recall, round(f1, 6) AS f1, support FROM class_scores
    UNION ALL SELECT model, 'macro avg', round(sum(prec) / 5, 6), round(sum(rec) / 5, 6), round(sum(f1) / 5, 6), CAST(sum(support) AS BIGINT) FROM class_scores GROUP BY model
    UNION ALL SELECT model, 'weighted avg', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6),
              round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM class_scores GROUP BY model
    """,
)
def a11(spark, folder):
    return rounded(M.class_report(predictions(spark, folder)), "precision", "recall", "f1")


@query(
    "a32_f1_by_star",
    "SELECT CAST(star AS VARCHAR) AS star, "
    + ", ".join(f"round(max(f1) FILTER (model = '{m}'), 6) AS {m}" for m in MODEL_NAMES)
    + " FROM class_scores GROUP BY star",
)
def a32(spark, folder):
    return rounded(M.f1_by_star(predictions(spark, folder), MODEL_NAMES), *MODEL_NAMES)


@query(
    "a18_majority_reference",
    """SELECT count(*) AS n_samples, 4 AS predicted_star, round(avg(abs(user_rating - 4e0)), 6) AS mae,
              round(sqrt(avg((user_rating - 4e0) * (user_rating - 4e0))), 6) AS rmse,
              round(count(*) FILTER (user_rating = 4) / count(*), 6) AS accuracy FROM rated""",
)
def a18(spark, folder):
    out = M.majority_metrics(rated(spark, folder), 4)
    return rounded(out.select("n_samples", "predicted_star", "mae", "rmse", "accuracy"), "mae", "rmse", "accuracy")


part(
    "pairs",
    """SELECT user_rating, pred, count(*) AS reviews FROM rounded
       WHERE model_order = 0 AND abs(user_rating - pred) >= 2 GROUP BY ALL""",
)


@query(
    "a07_confusion_pairs",
    """SELECT user_rating || '->' || pred AS pair, reviews, CAST((SELECT sum(reviews) FROM pairs) AS BIGINT) AS severe_count,
              2 AS min_delta FROM pairs""",
)
def a07(spark, folder):
    return errors.confusion_pairs(rated(spark, folder))


@query(
    "p09_s17_severe_errors",
    """SELECT r.review_id, b.review_body AS text, user_rating, pred AS pred_star_rounded, round(ai_expected_rating, 6) AS ai_expected_rating,
              abs(user_rating - pred) AS abs_error
       FROM rounded r JOIN reviews b USING (review_id) WHERE model_order = 0 AND abs(user_rating - pred) >= 2""",
)
def p09(spark, folder):
    severe = errors.severe_errors(scored_texts(spark, folder))
    out = severe.select("review_id", "text", "user_rating", "pred_star_rounded", "ai_expected_rating", "abs_error")
    return rounded(out, "ai_expected_rating")


def scored_texts(spark, folder):
    from starlens.catalog.base import MODELS, expectation

    _, a, b = MODELS[0]
    return reviews(spark, folder).select(
        "review_id",
        F.col("review_body").alias("text"),
        F.col("stars").alias("user_rating"),
        expectation(a, b, "review_id").alias("ai_expected_rating"),
    )


@query(
    "p10_s17_low_confidence",
    """SELECT g.review_id, user_rating, round(list_max(probs), 6) AS max_prob FROM gaussian g
       WHERE user_rating = greatest(1, least(5, CAST(round_even(ai_expected_rating, 0) AS INTEGER))) AND list_max(probs) < 0.6e0""",
)
def p10(spark, folder):
    shaky = errors.low_confidence_hits(gaussian(spark, folder), 0.6)
    return rounded(shaky.select("review_id", "user_rating", "max_prob"), "max_prob")


@query(
    "s11_predictions",
    """SELECT p.model, p.review_id, b.review_body AS text, user_rating, round(ai_expected_rating, 6) AS ai_expected_rating, pred AS pred_star_rounded
       FROM rounded p JOIN reviews b USING (review_id)""",
)
def s11(spark, folder):
    from starlens.catalog.base import MODELS, expectation

    options = [
        F.struct(F.lit(m).alias("model"), expectation(a, b, "review_id").alias("ai_expected_rating")) for m, a, b in MODELS
    ]
    scored = reviews(spark, folder).select(
        "review_id", F.col("review_body").alias("text"), F.col("stars").alias("user_rating"), F.explode(F.array(*options)).alias("m")
    )
    return rounded(sinks.predictions(scored.select("*", "m.*").drop("m")), "ai_expected_rating")


_LONG = " UNION ALL ".join(
    f"SELECT model, model_order, '{m}' AS metric, '{d}' AS direction, {m} AS value FROM bundle" for m, d in M.SUMMARY_METRICS
)
part("metric_values", _LONG)


@query(
    "j12_metric_winners",
    """
    SELECT metric, direction, CASE WHEN min(value) = max(value) THEN 'tie'
           ELSE arg_min(model, (CASE WHEN direction = 'lower' THEN value ELSE -value END, model_order)) END AS winner
    FROM metric_values GROUP BY metric, direction
    """,
)
def j12(spark, folder):
    return M.winners(bundle(spark, folder))


@query(
    "q15_report_table",
    "SELECT model, metric, round(value, 6) AS value FROM metric_values",
)
def q15(spark, folder):
    return rounded(M.metric_table(bundle(spark, folder), [m for m, _ in M.SUMMARY_METRICS]), "value")


@query(
    "w10_champion",
    "SELECT model AS best_model, round(mae, 6) AS best_value FROM bundle ORDER BY mae, model_order LIMIT 1",
)
def w10(spark, folder):
    return rounded(M.champion(bundle(spark, folder), "mae"), "best_value")


@query(
    "w11_resolve_champion",
    "SELECT model AS best_model FROM bundle ORDER BY mae, model_order LIMIT 1",
)
def w11(spark, folder):
    # The stored name is no known model, so the computed champion counts.
    stored = table(spark, folder, "documents").agg(F.max("source").alias("best_model"))
    return M.resolve_champion(stored, bundle(spark, folder), MODEL_NAMES)


@query(
    "w21_leaderboard",
    "SELECT model, round(accuracy, 6) AS accuracy, CAST(row_number() OVER (ORDER BY accuracy DESC, model_order) AS INTEGER) AS rank FROM bundle",
)
def w21(spark, folder):
    return rounded(M.leaderboard(bundle(spark, folder)).select("model", "accuracy", "rank"), "accuracy")


part(
    "heat_values",
    """SELECT v.*, row_number() OVER (PARTITION BY metric ORDER BY b.accuracy DESC, b.model_order) AS place
       FROM metric_values v JOIN bundle b USING (model)
       WHERE metric IN ('mae', 'rmse', 'accuracy', 'f1_macro', 'f1_weighted')""",
)


@query(
    "a35_heat_table",
    """
    SELECT model, metric, round(value, 6) AS value, round(CASE WHEN direction = 'lower' THEN 1 - f ELSE f END, 6) AS heat,
           row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN direction = 'lower' THEN value ELSE -value END, place) = 1 AS is_winner
    FROM (SELECT *, (value - min(value) OVER w) / CASE WHEN max(value) OVER w > min(value) OVER w
                 THEN max(value) OVER w - min(value) OVER w ELSE 1e0 END AS f
          FROM heat_values WINDOW w AS (PARTITION BY metric))
    """,
)
def a35(spark, folder):
    return rounded(M.heat_table(M.leaderboard(bundle(spark, folder))), "value", "heat")


@query(
    "a33_focal_loss",
    """SELECT round(avg(l), 6) AS loss_mean, round(sum(l), 4) AS loss_sum FROM (
         SELECT -((1 - p) * (1 - p)) * ln(p) AS l FROM (SELECT probs[user_rating] AS p FROM gaussian))""",
)
def a33(spark, folder):
    out = M.focal_loss(gaussian(spark, folder))
    return out.select(F.round("loss_mean", 6).alias("loss_mean"), F.round("loss_sum", 4).alias("loss_sum"))


@query(
    "a34_squared_loss",
    """SELECT round(avg(w * (ai_expected_rating - user_rating) * (ai_expected_rating - user_rating)), 6) AS loss_mean
       FROM (SELECT *, (SELECT count(*) FROM rated) / (5e0 * count(*) OVER (PARTITION BY user_rating)) AS w FROM rated)""",
)
def a34(spark, folder):
    from starlens.operators import distribution

    df = rated(spark, folder)
    weighted = distribution.sample_weights(df, distribution.class_weights(df), F.col("user_rating") - 1)
    return rounded(M.squared_loss(weighted, "class_weight"), "loss_mean")


@query(
    "a08_hard_mae",
    "SELECT model, round(avg(abs(user_rating - pred)), 6) AS mae FROM rounded GROUP BY model",
)
def a08_hard(spark, folder):
    return rounded(M.bundle(predictions(spark, folder), hard=True).select("model", "mae"), "mae")


@query(
    "q07_s14_evaluate",
    f"""
    SELECT model, n_samples, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(accuracy, 6) AS accuracy,
           round(f1_macro, 6) AS f1_macro, (SELECT model FROM bundle ORDER BY mae, model_order LIMIT 1) AS best_model,
           (SELECT CAST(reviews AS VARCHAR) FROM cells c WHERE c.model = b.model AND true_star = 4 AND pred_star = 4) AS cell_44
    FROM bundle b
    UNION ALL
    SELECT 'majority', count(*), round(avg(abs(user_rating - 4e0)), 6), round(sqrt(avg((user_rating - 4e0) * (user_rating - 4e0))), 6),
           round(count(*) FILTER (user_rating = 4) / count(*), 6),
           round((2e0 * count(*) FILTER (user_rating = 4) / (count(*) + count(*) FILTER (user_rating = 4))) / count(DISTINCT user_rating), 6),
           (SELECT model FROM bundle ORDER BY mae, model_order LIMIT 1), CAST(count(*) FILTER (user_rating = 4) AS VARCHAR)
    FROM rated
    """,
)
def q07(spark, folder):
    from starlens.plans.evaluate import evaluate

    document = evaluate(predictions(spark, folder)).report
    models = document.select("best_model", F.explode("models").alias("model", "m"))
    out = models.select(
        "model", "m.n_samples", "m.mae", "m.rmse", "m.accuracy", "m.f1_macro", "best_model",
        F.col("m.confusion_matrix")[3][3].cast("string").alias("cell_44"),
    )
    return rounded(out, "mae", "rmse", "accuracy", "f1_macro")
