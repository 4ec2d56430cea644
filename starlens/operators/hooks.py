"""Plug-in points for user models: the only operators that start Python workers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t


def normaliser(function: Callable[[str], str]):
    """A user's text function as a Column function (Arrow batches)."""

    @F.pandas_udf(t.StringType())
    def apply(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(function)

    return apply


def tokenizer(function: Callable[[str], list[str]]):
    """A user's tokenizer as a Column function (Arrow batches)."""

    @F.pandas_udf(t.ArrayType(t.StringType()))
    def apply(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(function)

    return apply


def score_with(
    df: DataFrame,
    load: Callable[[], Callable[[pd.Series], np.ndarray]],
    text: str = "text",
) -> DataFrame:
    """Score texts with a user model that returns an (n, 5) probability array.

    ``load`` runs once per task; batches are the Arrow batches of the session
    (``spark.sql.execution.arrow.maxRecordsPerBatch``).
    """
    schema = t.StructType(
        [*df.schema.fields, t.StructField("probs", t.ArrayType(t.DoubleType())), t.StructField("ai_expected_rating", t.DoubleType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        stars = np.arange(1, 6)
        for batch in batches:
            probs = np.asarray(model(batch[text]), dtype=float).reshape(len(batch), 5)
            yield batch.assign(probs=list(probs), ai_expected_rating=probs @ stars)

    return df.mapInPandas(run, schema)


def encode_with(df: DataFrame, load: Callable[[], Callable[[pd.Series], np.ndarray]], text: str = "text") -> DataFrame:
    """Encode texts with a user encoder; vectors are scaled to unit length."""
    schema = t.StructType([*df.schema.fields, t.StructField("embedding", t.ArrayType(t.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for batch in batches:
            vectors = np.asarray(encoder(batch[text]), dtype=np.float32).reshape(len(batch), -1)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            yield batch.assign(embedding=list(vectors / np.where(norms > 0, norms, 1)))

    return df.mapInPandas(run, schema)
