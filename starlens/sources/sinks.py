"""Writers for scored reviews, predictions, splits, reports and error exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.operators import errors

PREDICTION_COLUMNS = ("text", "user_rating", "ai_expected_rating", "pred_star_rounded")


def _write_csv(df: DataFrame, path: str) -> None:
    """With a header; texts keep their outer blanks."""
    df.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_scored(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Scored reviews; CSV and JSON need flat columns."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        flat = df.select(*[c for c, kind in df.dtypes if not kind.startswith(("array", "struct", "map"))])
        _write_csv(flat, path)
    elif fmt == "json":
        writer.json(path)
    else:
        writer.format(fmt).save(path)


def predictions(df: DataFrame) -> DataFrame:
    """The prediction table; with several models the model column is kept."""
    extra = [c for c in ("model", "review_id") if c in df.columns]
    return errors.with_rounded(df).select(*extra, *PREDICTION_COLUMNS)


def write_predictions(df: DataFrame, path: str) -> None:
    predictions(df).write.mode("overwrite").partitionBy("model").parquet(path)


def write_holdout(df: DataFrame, path: str) -> None:
    """Keep the raw text, so that evaluation normalises it once."""
    df.filter(F.col("split") == "holdout").drop("split").write.mode("overwrite").parquet(path)


def write_report(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_comparison(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_error_analysis(df: DataFrame, path: str, min_delta: int = 2, limit: float = 0.4, prefix: str = "errors") -> dict[str, str]:
    """Severe errors, shaky hits and the confusion summary below ``path``."""
    out = {
        "severe_errors": f"{path}/{prefix}_severe_delta_ge_{min_delta}",
        "low_confidence_correct": f"{path}/{prefix}_low_conf_correct_lt_{limit}",
        "confusion_summary": f"{path}/{prefix}_confusion_summary",
    }
    columns = ["review_id", "text", "user_rating", "pred_star_rounded", "ai_expected_rating"]
    severe = errors.severe_errors(df, min_delta).select(*columns, "abs_error")
    _write_csv(severe, out["severe_errors"])
    shaky = errors.low_confidence_hits(df, limit).select(*columns, "max_prob")
    _write_csv(shaky, out["low_confidence_correct"])
    write_summary(errors.confusion_pairs(df, min_delta), out["confusion_summary"])
    return out
