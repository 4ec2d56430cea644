"""Compute an expensive column exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add or replace a column behind a one-element generator.

    The optimiser copies a plain projection into every filter above it and
    even below shuffles, so a chain of regular expressions would run once per
    filter.  It does not look through a generator.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*[F.col(f"`{c}`") for c in others], F.explode(F.array(value)).alias(name)).select(
        *[F.col(f"`{c}`") for c in (df.columns if name in df.columns else [*others, name])]
    )
