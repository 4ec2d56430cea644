"""All text strategies over one corpus, compared by what cleaning leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions import text as T
from starlens.operators import clean


def strategy_texts(df: DataFrame, text: str, names: Sequence[str], id_col: str = "review_id") -> DataFrame:
    """(id, strategy, text): one row per review and strategy."""
    rows = [F.struct(F.lit(n).alias("strategy"), T.strategy(n)(F.col(text)).alias("text")) for n in names]
    return df.select(id_col, F.explode(F.array(*rows)).alias("r")).select(id_col, "r.strategy", "r.text")


def compare_strategies(df: DataFrame, text: str, names: Sequence[str], min_length: int = 5) -> DataFrame:
    """Cleaning counters per strategy."""
    return clean.cleaning_stats(strategy_texts(df, text, names), min_length, by=("strategy",))
