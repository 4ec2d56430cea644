"""Shards as runs along a Hilbert curve through quantised metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import BUCKET_ROWS, NO_ID, hash_fraction, key_of, running_total, stage, text_of

#: Bits that each dimension is quantised to.
BITS = 4

#: Bytes that a row costs besides its text.
ROW_BYTES = 16


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the curve of points (rows) with ``bits``-bit coordinates.

    Going down from the highest bit, a coordinate whose bit is set flips the
    lower bits of the first one, and one whose bit is not set swaps them with
    the first's; Gray coding across the coordinates then gives the digits of
    the place (the transpose form published by Skilling, 2004).
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    high = np.int64(1) << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(n):
            is_set = (x[i] & q) != 0
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = high
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def number_cells(rows: DataFrame, columns: list[str], bits: int = BITS) -> list[Column]:
    """For each number column the cell between its quantiles that a value falls into; null and NaN come first."""
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    values = {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(-1.0e300)) for c in columns}
    found = rows.agg(*[F.percentile_approx(v, steps, 1000).alias(c) for c, v in values.items()]).first() if columns else {}
    out = []
    for c, value in values.items():
        cell = F.lit(0)
        for cut in found[c] or []:
            cell = cell + (value > F.lit(cut)).cast("int")
        out.append(cell)
    return out


def value_cells(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(value, cell) of each distinct string: its share of the rows with smaller values, by whole values; null first.

    Distinct values are sorted and counted up in parts, so their number is not bounded.
    """
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = stage(counts.orderBy(F.col("value").asc_nulls_first()).withColumn("at", F.monotonically_increasing_id()))
    total = max(1, ordered.agg(F.sum("n")).first()[0] or 0)
    numbered = ordered.withColumn("bucket", F.floor(F.col("at") / BUCKET_ROWS))
    ranked = running_total(numbered, [], "bucket", ["at"], F.col("n"), "before")
    return ranked.select("value", F.floor(F.col("before") / total * (1 << bits)).cast("int").alias("cell"))


def curve_places(rows: DataFrame, dimensions: list[str], bits: int = BITS) -> DataFrame:
    """Add ``curve``: the place of the columns ``dimensions`` (strings or doubles), cut at their quantiles."""
    types = dict(rows.dtypes)
    numbers = [d for d in dimensions if types[d] != "string"]
    cells = dict(zip(numbers, number_cells(rows, numbers, bits)))
    for d in dimensions:
        if d not in cells:
            found = value_cells(rows, d, bits).select(F.col("value").alias(f"_{d}"), F.col("cell").alias(f"_{d}_cell"))
            rows = rows.join(found, F.col(d).eqNullSafe(F.col(f"_{d}"))).drop(f"_{d}")
            cells[d] = F.col(f"_{d}_cell")
    celled = rows.select(
        *[c for c in rows.columns if c not in dimensions and not c.endswith("_cell")],
        F.array(*[cells[d].cast("int") for d in dimensions]).alias("cells"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(dimensions))
            kept = [n for n in batch.schema.names if n != "cells"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], pa.array(hilbert_index(points, bits))], [*kept, "curve"]
            )

    kept = ", ".join(f"`{n}` {t}" for n, t in celled.dtypes if n != "cells")
    return celled.mapInArrow(run, f"{kept}, curve long")


def curve_order(placed: DataFrame) -> DataFrame:
    """(key, row, size, text_crc32, rank) of rows (key, row, size, text_crc32, t1, t2, curve): the rows in one order.

    All rows of one text (t1, t2) stand together, at the curve place of their
    first row by (curve, key, row); at one place texts come by digest.  Texts
    are ranked with their number of rows, then the rows of repeated texts among
    themselves, both in buckets, so neither a full place nor a text that a
    third of all rows share is one task's work.
    """
    texts = placed.groupBy("t1", "t2").agg(F.min("curve").alias("curve"), F.count("*").alias("n"))
    texts = stage(texts.withColumn("spot", hash_fraction("t1", "t2", F.lit("shard"))))
    # at most 2 ** (bits * dimensions) places
    places = texts.groupBy("curve").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("buckets"))
    bucket = F.col("curve") * F.lit(1 << 32) + F.floor(F.col("spot") * F.col("buckets"))
    spread = stage(texts.join(F.broadcast(places), "curve").withColumn("bucket", bucket).drop("curve", "buckets"))
    starts = running_total(spread, [], "bucket", ["spot", "t1", "t2"], F.col("n"), "start").select("t1", "t2", "n", "start")
    met = stage(placed.drop("curve").join(starts, ["t1", "t2"]))
    alone = met.where("n = 1").withColumn("within", F.lit(0).cast("long"))
    within = F.floor(hash_fraction("key", F.lit("shard")) * F.ceil(F.col("n") / BUCKET_ROWS))
    copies = running_total(
        stage(met.where("n > 1").withColumn("bucket", within)), ["t1", "t2"], "bucket", ["key", "row"], F.lit(1), "within"
    ).drop("bucket")
    return alone.unionByName(copies).select("key", "row", "size", "text_crc32", (F.col("start") + F.col("within")).alias("rank"))


def assign(
    docs: DataFrame, shards: int = 40, dimensions: tuple = ("source", "lang", "doc_id"), bits: int = BITS
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    Rows are ordered along the curve of their quantised ``dimensions`` and the
    order is cut into ``shards`` runs whose row counts differ by one at most
    (law ``rows``).  ``slot`` is a row's place in its shard.  Equal texts stand
    together at the place of the smallest, so only those that one of the cuts
    falls into lie in more than one shard.  ``size`` is the text's bytes plus
    16; null text counts as empty, and null metadata as smallest.  A long text
    counts by its bytes like any other.  Rows that repeat, or have no id, are
    sharded as often as given; an empty table gives an empty result.
    ``grown_shard`` is null under this law.
    """
    metadata = [f"d{i}" for i in range(len(dimensions))]
    types = dict(docs.dtypes)
    text = text_of()
    rows = stage(
        docs.select(
            key_of().alias("key"),
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("t1"),
            F.xxhash64(F.lit(1), text).alias("t2"),
            *[F.col(d).cast("string" if types[d] == "string" else "double").alias(m) for d, m in zip(dimensions, metadata)],
        )
    )
    ranked = curve_order(stage(curve_places(rows, metadata, bits)))
    total = max(1, rows.count())
    return (
        ranked.withColumn("shard", F.expr(f"cast((rank * {shards}) div {total} as int)"))
        .select(
            F.when(F.col("key") != F.lit(NO_ID), F.col("key")).alias("doc_id"), "size", "text_crc32",
            F.lit("rows").alias("law"), "shard",
            F.expr(f"rank - ((cast(shard as long) * {total} + {shards - 1}) div {shards})").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def shard_ranges(docs: DataFrame, assigned: DataFrame, dimensions: tuple = ("source", "lang", "doc_id")) -> DataFrame:
    """(shard, rows, and least and most value of each dimension): what a reader prunes files by."""
    ids = assigned.select(key_of().alias("_key"), "shard").distinct()
    found = docs.select(key_of().alias("_key"), *[F.col(d).alias(f"_{i}") for i, d in enumerate(dimensions)]).join(ids, "_key")
    return found.groupBy("shard").agg(
        F.count("*").alias("rows"),
        *[f(f"_{i}").alias(f"{n}_{d}") for i, d in enumerate(dimensions) for n, f in (("least", F.min), ("most", F.max))],
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """Write ``docs`` by shard, rows of a shard in slot order; tasks get stretches of the order, not whole shards.

    Rows find their shard by doc_id, which must not repeat.
    """
    ids = assigned.select(key_of().alias("_key"), "shard", "slot")
    ordered = docs.withColumn("_key", key_of()).join(ids, "_key").drop("_key")
    ordered.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
