"""Where rows lie after a table is spread."""

import pytest
from pyspark.sql import functions as F

from starlens.session import PART_BYTES, parts_of, spread, stage


def largest_share(df):
    parts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(parts) / sum(parts)


@pytest.fixture
def one_file(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text")).coalesce(1).write.parquet(path)
    return path


def test_one_row_group_is_spread(spark, one_file):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # several splits, one of which holds all rows
    try:
        table = spark.read.parquet(one_file)
        assert table.rdd.getNumPartitions() > 2
        assert largest_share(table) == 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
        assert largest_share(spread(spark.read.parquet(one_file))) < 1 / 3
        assert largest_share(spread(spark.read.parquet(one_file), "id")) < 1 / 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_big_and_even_tables_are_not_shuffled(spark, one_file):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # the table is larger than a split per core
    try:
        table = spark.read.parquet(one_file)
        assert spread(table) is table
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    even = stage(spark.range(4000).repartition(4))
    assert spread(even) is even


def test_tables_without_files(spark):
    assert spread(spark.range(10)).count() == 10
    assert spread(spark.createDataFrame([], "a int")).count() == 0


def test_parts_follow_the_texts_and_not_their_packed_bytes(spark, tmp_path):
    """A table of equal texts is small on disk; its texts are not."""
    folder = f"{tmp_path}/odd [name] {{1}}"
    rows = spark.range(3000).select("id", F.expr("repeat('abcdefgh ', 2000)").alias("text"))
    rows.coalesce(1).write.parquet(folder)
    stored = spark.read.schema(rows.schema).parquet(folder.replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}"))
    assert parts_of(stored) == -(-3000 * 18000 // PART_BYTES)
    listed = stored.select(F.split("text", " ").alias("words"))
    listed.write.parquet(f"{tmp_path}/lists")
    assert parts_of(spark.read.parquet(f"{tmp_path}/lists")) == -(-3000 * 16000 // PART_BYTES)
    assert parts_of(spark.createDataFrame([(1, "a")], "id int, text string")) == spark.sparkContext.defaultParallelism
