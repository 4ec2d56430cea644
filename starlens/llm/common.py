"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.session import stage

#: Stands for a null id in joins and orders; it sorts before every other id.
NO_ID = -(2**63)

#: Rows that a bucket of ``running_total`` holds on average.
BUCKET_ROWS = 200

#: Buckets in one block of the two-level prefix sums.
BLOCK = 4096


def key_of(name: str = "doc_id") -> Column:
    """The id as a non-null long."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def hash_fraction(*columns: Column | str) -> Column:
    """A number from 0 up to 1 (not 1 itself) that depends on the values only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(2**53))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are ordered by ``bucket`` (long, ascending, not null), then by
    ``order``.  No task sees a whole group: sums of buckets are added up in
    blocks of ``BLOCK`` buckets, blocks among themselves, and rows only within
    their bucket.  ``df`` is read twice and should be a stored table; group
    columns must not be null.
    """
    past = (Window.unboundedPreceding, -1)
    sums = (
        df.groupBy(*group, F.col(bucket).alias("_bucket"))
        .agg(F.sum(value).alias("_sum"))
        .withColumn("_block", F.floor(F.col("_bucket") / BLOCK))
    )
    blocks = sums.groupBy(*group, "_block").agg(F.sum("_sum").alias("_all"))
    block_starts = blocks.select(
        *group,
        "_block",
        F.coalesce(F.sum("_all").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(*past)), F.lit(0)).alias(
            "_block_start"
        ),
    )
    inner = Window.partitionBy(*group, "_block").orderBy("_bucket").rowsBetween(*past)
    starts = (
        sums.withColumn("_inner", F.coalesce(F.sum("_sum").over(inner), F.lit(0)))
        .join(block_starts, [*group, "_block"])
        .select(*group, F.col("_bucket").alias(bucket), (F.col("_inner") + F.col("_block_start")).alias("_start"))
    )
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(*past)
    return (
        df.join(starts, [*group, bucket])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(within), F.lit(0)))
        .drop("_start")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of ``links`` (a, b: long, not null), without the nodes that name their component.

    A component's name is its smallest node.  In each round every node hooks
    to its smallest neighbour if that is smaller, hooks are followed to their
    roots by doubling, and the links between roots go to the next round
    without repeats, so a hub loses its links as its neighbours merge.  The
    tables of each round are written to the shared folder.  Without links the
    result is empty.
    """
    links = stage(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    )
    labels: DataFrame | None = None
    empty = links.select(F.col("a").alias("node"), F.col("a").alias("component")).where("false")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).where("root < node"))
        while True:
            further = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = stage(
                hooks.join(further, "root", "left").select(
                    "node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
                )
            )
            hooks = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        links = stage(relabel(relabel(links, "a", hooks), "b", hooks).where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        ).distinct())
        found = hooks.select("node", F.col("root").alias("component"))
        labels = found if labels is None else stage(relabel(labels, "component", hooks).unionByName(found))
    return empty if labels is None else labels


def relabel(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """Replace ``column`` by its root where it has one."""
    to = hooks.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return (
        df.join(to, F.col(column) == F.col("_node"), "left")
        .withColumn(column, F.coalesce("_root", column))
        .drop("_node", "_root")
    )


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
