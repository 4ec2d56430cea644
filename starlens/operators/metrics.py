"""Evaluation metrics of star predictions, computed in one pass over all models.

The aggregation holds 25 confusion cells and a handful of sums per model, so
the shuffle carries one row per model and task.  Everything else is derived
from those numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from starlens import lexicon
from starlens.functions import ratings

STARS = lexicon.STARS
LOWER_IS_BETTER = ("mae", "rmse")
CHAMPION_METRICS = ("mae", "rmse", "accuracy", "f1_macro")

# Report metrics in display order and the direction that wins.
SUMMARY_METRICS = (
    ("mae", "lower"),
    ("rmse", "lower"),
    ("off_by_one_accuracy", "higher"),
    ("accuracy", "higher"),
    ("f1_macro", "higher"),
    ("f1_weighted", "higher"),
    ("recall_star_1", "higher"),
    ("recall_star_2", "higher"),
    ("anomaly_f1", "higher"),
    ("anomaly_rate", "lower"),
)


def _ratio(part: Column, whole: Column) -> Column:
    """Zero where the denominator is zero."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _total(values: list[Column]) -> Column:
    out = values[0]
    for value in values[1:]:
        out = out + value
    return out


def counts(
    df: DataFrame,
    by: Sequence[str] = ("model",),
    truth: str = "user_rating",
    expected: str = "ai_expected_rating",
    threshold: float = 2.0,
    min_delta: int = 2,
    hard: bool = False,
) -> DataFrame:
    """One row per model: n, error sums, flag counts, confusion cells c11..c55.

    Also the rows per true star (t1..t5) and per predicted star (p1..p5).
    """
    y = F.col(truth).cast("int")
    pred = ratings.clip_star(F.col(expected))
    value = pred.cast("double") if hard else F.col(expected).cast("double")
    rows = df.select(*by, y.alias("y"), pred.alias("p"), F.abs(y - value).alias("d"))
    flag, severe = F.col("d") >= threshold, F.abs(F.col("y") - F.col("p")) >= min_delta
    cells = [
        F.count_if((F.col("y") == t) & (F.col("p") == p)).alias(f"c{t}{p}") for t in STARS for p in STARS
    ]
    cells += [F.count_if(F.col("y") == s).alias(f"t{s}") for s in STARS]
    cells += [F.count_if(F.col("p") == s).alias(f"p{s}") for s in STARS]
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum("d").alias("abs_sum"),
        F.sum(F.col("d") * F.col("d")).alias("square_sum"),
        F.count_if(flag).alias("flags"),
        F.count_if(severe).alias("severes"),
        F.count_if(flag & severe).alias("both"),
        *cells,
    )


def _cell(t: int, p: int) -> Column:
    return F.col(f"c{t}{p}")


def _class_scores(wide: DataFrame) -> DataFrame:
    """Add precision, recall and F1 of every star (pr1.., re1.., f1..)."""
    scores = {}
    for s in STARS:
        hit, predicted, support = _cell(s, s), F.col(f"p{s}"), F.col(f"t{s}")
        scores[f"pr{s}"] = _ratio(hit, predicted)
        scores[f"re{s}"] = _ratio(hit, support)
        scores[f"f{s}"] = _ratio(2 * hit, predicted + support)
    return wide.withColumns(scores)


def bundle(df: DataFrame, by: Sequence[str] = ("model",), **options) -> DataFrame:
    """The extended metrics, one row per model."""
    return bundle_of(counts(df, by, **options), by)


def bundle_of(wide: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The extended metrics from ``counts``."""
    n = F.col("n_samples")
    hits = _total([_cell(s, s) for s in STARS])
    near = _total([_cell(t, p) for t in STARS for p in STARS if abs(t - p) <= 1])
    present = _total([F.when(F.col(f"p{s}") + F.col(f"t{s}") > 0, 1).otherwise(0) for s in STARS])
    return _class_scores(wide).select(
        *by,
        "n_samples",
        (F.col("abs_sum") / n).alias("mae"),
        F.sqrt(F.col("square_sum") / n).alias("rmse"),
        (hits / n).alias("accuracy"),
        (_total([F.col(f"f{s}") for s in STARS]) / present).alias("f1_macro"),
        (_total([F.col(f"f{s}") * F.col(f"t{s}") for s in STARS]) / n).alias("f1_weighted"),
        (near / n).alias("off_by_one_accuracy"),
        F.col("re1").alias("recall_star_1"),
        F.col("re2").alias("recall_star_2"),
        (F.col("flags") / n).alias("anomaly_rate"),
        _ratio(F.col("both"), F.col("flags")).alias("anomaly_precision"),
        _ratio(F.col("both"), F.col("severes")).alias("anomaly_recall"),
        _ratio(2 * F.col("both"), F.col("flags") + F.col("severes")).alias("anomaly_f1"),
        (F.col("severes") / n).alias("severe_error_rate"),
        F.array(*[f"re{s}" for s in STARS]).alias("per_class_recall"),
    )


def confusion_matrix(df: DataFrame, by: Sequence[str] = ("model",), scaled: bool = False, **options) -> DataFrame:
    """25 rows per model; ``scaled`` adds the share of the largest cell and the diagonal mark."""
    return confusion_of(counts(df, by, **options), by, scaled)


def confusion_of(wide: DataFrame, by: Sequence[str] = ("model",), scaled: bool = False) -> DataFrame:
    """The confusion matrix from ``counts``."""
    cells = [
        F.struct(F.lit(t).alias("true_star"), F.lit(p).alias("pred_star"), _cell(t, p).alias("reviews"))
        for t in STARS
        for p in STARS
    ]
    top = F.greatest(F.lit(1), *[_cell(t, p) for t in STARS for p in STARS]).alias("top")
    out = wide.select(*by, top, F.explode(F.array(*cells)).alias("cell")).select(*by, "top", "cell.*")
    if scaled:
        out = out.withColumn("intensity", F.col("reviews") / F.col("top")).withColumn(
            "is_diagonal", F.col("true_star") == F.col("pred_star")
        )
    return out.drop("top")


def class_report(df: DataFrame, by: Sequence[str] = ("model",), **options) -> DataFrame:
    """Precision, recall, F1 and support per star, then the macro and weighted averages over all five."""

    def row(label: str, values: list[Column]) -> Column:
        names = ("precision", "recall", "f1", "support")
        return F.struct(F.lit(label).alias("label"), *[v.alias(k) for k, v in zip(names, values, strict=True)])

    per_star = [[F.col(f"pr{s}"), F.col(f"re{s}"), F.col(f"f{s}")] for s in STARS]
    supports = [F.col(f"t{s}") for s in STARS]
    everything = F.col("n_samples")
    macro = [_total([v[i] for v in per_star]) / F.lit(float(len(STARS))) for i in range(3)]
    weighted = [
        _ratio(_total([v[i] * n for v, n in zip(per_star, supports, strict=True)]), everything) for i in range(3)
    ]
    rows = [row(str(s), [*v, n]) for s, v, n in zip(STARS, per_star, supports, strict=True)]
    rows += [row("macro avg", [*macro, everything]), row("weighted avg", [*weighted, everything])]
    wide = _class_scores(counts(df, by, **options))
    return wide.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def f1_by_star(df: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per star, one F1 column per model; a model without the star has zero."""
    report = class_report(df).filter(F.col("label").isin(*[str(s) for s in STARS]))
    values = [
        F.coalesce(F.max(F.when(F.col("model") == m, F.col("f1"))), F.lit(0.0)).alias(m) for m in models
    ]
    return report.groupBy(F.col("label").alias("star")).agg(*values)


def constant_counts(wide: DataFrame, star: int = 4, threshold: float = 2.0, min_delta: int = 2) -> DataFrame:
    """``counts`` of predicting one star for every row, from the counts of any model on these rows."""
    def over(value) -> Column:
        return _total([F.col(f"t{t}") * F.lit(value(abs(t - star))) for t in STARS])

    cells = {f"c{t}{p}": F.col(f"t{t}") if p == star else F.lit(0).cast("long") for t in STARS for p in STARS}
    cells |= {f"p{s}": F.col("n_samples") if s == star else F.lit(0).cast("long") for s in STARS}
    return wide.withColumns(
        {
            "abs_sum": over(float),
            "square_sum": over(lambda d: float(d * d)),
            "flags": over(lambda d: int(d >= threshold)),
            "severes": over(lambda d: int(d >= min_delta)),
            "both": over(lambda d: int(d >= threshold and d >= min_delta)),
            **cells,
        }
    )


def majority_metrics(df: DataFrame, star: int = 4) -> DataFrame:
    """Metrics of predicting the same star for every row."""
    constant = df.withColumns({"model": F.lit("majority"), "ai_expected_rating": F.lit(float(star))})
    return bundle(constant).withColumn("predicted_star", F.lit(star))


def metric_table(metrics: DataFrame, names: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Wide metrics to (by, metric, value)."""
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]
    return metrics.select(*by, F.explode(F.array(*pairs)).alias("m")).select(*by, "m.*")


def winners(metrics: DataFrame, order: str = "model_order") -> DataFrame:
    """Winning model per report metric: nulls ignored, ``tie`` if all values are equal."""
    directions = [
        F.struct(F.lit(m).alias("metric"), F.lit(d).alias("direction"), F.col(m).cast("double").alias("value"))
        for m, d in SUMMARY_METRICS
    ]
    long = metrics.select("model", order, F.explode(F.array(*directions)).alias("m")).select("model", order, "m.*")
    key = F.struct(F.when(F.col("direction") == "lower", F.col("value")).otherwise(-F.col("value")), F.col(order))
    best = F.min_by("model", F.when(F.col("value").isNotNull(), key))
    same = F.coalesce(F.min("value") == F.max("value"), F.lit(True))
    return long.groupBy("metric", "direction").agg(F.when(same, "tie").otherwise(best).alias("winner"))


def champion(metrics: DataFrame, metric: str = "mae", order: str = "model_order") -> DataFrame:
    """Best model on one metric; the first model wins a tie."""
    if metric not in CHAMPION_METRICS:
        raise ValueError(f"unsupported metric: {metric}")
    value = F.col(metric) if metric in LOWER_IS_BETTER else -F.col(metric)
    key = F.struct(value, F.col(order))
    return metrics.agg(F.min_by("model", key).alias("best_model"), F.min_by(metric, key).alias("best_value"))


def resolve_champion(
    stored: DataFrame | None,
    metrics: DataFrame | None,
    known_models: Sequence[str],
    metric: str = "mae",
    fallback: str = "baseline",
) -> DataFrame:
    """Stored best model if it is a known one, else the computed one, else the fallback."""
    options: list[Column] = []
    if stored is not None:
        name = stored.agg(F.first("best_model", ignorenulls=True)).scalar()
        options.append(F.when(name.isin(*known_models), name))
    if metrics is not None:
        options.append(champion(metrics, metric).select("best_model").scalar())
    spark = (stored if stored is not None else metrics).sparkSession
    return spark.range(1).select(F.coalesce(*options, F.lit(fallback)).alias("best_model"))


def leaderboard(metrics: DataFrame, order: str = "model_order") -> DataFrame:
    """Models by accuracy, best first (one row per model)."""
    ranked = W.orderBy(F.col("accuracy").desc(), F.col(order))
    return metrics.withColumn("rank", F.row_number().over(ranked))


def heat_table(board: DataFrame, names: Sequence[str] = ("mae", "rmse", "accuracy", "f1_macro", "f1_weighted")) -> DataFrame:
    """Each metric scaled to 0..1 across models (1 is best) with the winner of the column.

    Missing values count as zero, a column without range is divided by one,
    and the first row in leaderboard order wins ties.
    """
    long = metric_table(board, names, ("model", "rank")).withColumn("value", F.coalesce("value", F.lit(0.0)))
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    column = W.partitionBy("metric")
    low, high = F.min("value").over(column), F.max("value").over(column)
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    scaled = (F.col("value") - low) / span
    best_first = column.orderBy(F.when(lower, F.col("value")).otherwise(-F.col("value")), "rank")
    return long.select(
        "model",
        "metric",
        "value",
        F.when(lower, 1 - scaled).otherwise(scaled).alias("heat"),
        (F.row_number().over(best_first) == 1).alias("is_winner"),
    )


def focal_loss(df: DataFrame, probs: str = "probs", truth: str = "user_rating", gamma: float = 2.0, alpha=None) -> DataFrame:
    """Mean and sum of the focal loss of stored probabilities."""
    loss = ratings.focal_loss(F.col(probs), F.col(truth) - 1, gamma, alpha)
    return df.agg(F.avg(loss).alias("loss_mean"), F.sum(loss).alias("loss_sum"))


def squared_loss(df: DataFrame, weight: str | None = None, truth: str = "user_rating", expected: str = "ai_expected_rating") -> DataFrame:
    """Mean squared error, optionally weighted per row before the mean."""
    error = F.pow(F.col(expected) - F.col(truth), F.lit(2.0))
    return df.agg(F.avg(error if weight is None else error * F.col(weight)).alias("loss_mean"))
