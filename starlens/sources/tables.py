"""Review tables from CSV, UTF-16 TSV and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

BROKEN = "_broken_record"


def _string_schema(names: Sequence[str]) -> t.StructType:
    return t.StructType([t.StructField(n, t.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header; every column is a string, ratings are parsed later.

    Without ``columns`` only the header line is read to learn the names.  Where
    no quoted text holds a line break, ``multi_line=False`` lets Spark split
    large files; otherwise each file is one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if columns:
        reader = reader.schema(_string_schema(columns))
    return reader.csv(path)


def read_utf16_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """UTF-16 tab-separated file; lines with too many fields are skipped, short ones kept.

    A line with more fields than columns is told apart from a short one by the
    extra field that the reader is asked for.
    """
    wide = _string_schema([*columns, "_surplus"])
    raw = (
        spark.read.schema(wide)
        .option("sep", "\t")
        .option("encoding", "UTF-16")
        .option("header", True)
        .option("enforceSchema", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    return raw.filter(F.col("_surplus").isNull()).drop("_surplus")


def read_reviews(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Pick the reader by the file name."""
    if path.endswith(".tsv"):
        if not columns:
            raise ValueError("a TSV table needs its column names")
        return read_utf16_tsv(spark, path, columns)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, columns)


def read_splits(spark: SparkSession, paths: dict[str, str], text: str, rating: str) -> DataFrame:
    """Several Parquet splits as one table of text, rating and split name."""
    parts = [
        spark.read.parquet(path).select(F.col(text).alias("review_body"), F.col(rating).alias("stars"), F.lit(name).alias("split"))
        for name, path in paths.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_error_export(spark: SparkSession, path: str) -> DataFrame | None:
    """Severe-error export; None if it does not exist or has no text column."""
    java_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = java_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not path or not files.exists(java_path):
        return None
    table = read_csv(spark, path)
    return table if "text" in table.columns else None


def add_review_id(df: DataFrame, name: str = "review_id") -> DataFrame:
    """Number rows that have no id: increasing in file order, unique, not dense."""
    return df.withColumn(name, F.monotonically_increasing_id())

