"""Codes of integer vectors by nearest codebook entries, found with an integer Walsh-Hadamard transform."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2

#: Components become floor(SCALE * x).
SCALE = 256

#: Below this size of component, scaled sums of squares over WIDE padded components fit 63 bits.
SAFE = 1 << 20
WIDE = 1 << 10


def sequency_order(width: int) -> np.ndarray:
    """Rows of the Hadamard matrix of a power of two by their number of sign changes."""
    rows = transformed(np.eye(width, dtype=np.int64))
    return np.argsort((np.diff(np.sign(rows), axis=1) != 0).sum(1), kind="stable")


def transformed(vectors: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform (n, width) by additions; squared lengths grow by the factor width."""
    out, width, step = vectors.copy(), vectors.shape[1], 1
    while step < width:
        pairs = out.reshape(len(out), width // (2 * step), 2, step)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
        step *= 2
    return out


def padded(vectors: np.ndarray) -> np.ndarray:
    """Zeros behind the components up to a power of two."""
    width = 1
    while width < vectors.shape[1]:
        width *= 2
    return np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry to each vector; the lower index wins ties.

    Differences are summed up in sequency order of the transformed vectors.  A
    partial sum never exceeds the whole one, so entries whose sum is already
    above an upper bound of the best are dropped before the next term.  The
    bound is the whole distance to the entry that leads after the first term.
    All numbers are integers; the sums are the width times the distances.
    """
    width = padded(vectors[:1]).shape[1]
    order = sequency_order(width)
    left, right = (transformed(padded(x))[:, order] for x in (vectors, entries))
    sums = (left[:, :1] - right[None, :, 0]) ** 2
    leader = sums.argmin(1)
    bound = ((left - right[leader]) ** 2).sum(1)
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for term in range(1, width):
        sums = sums + (left[row, term] - right[entry, term]) ** 2
        kept = sums <= bound[row]
        row, entry, sums = row[kept], entry[kept], sums[kept]
    # rows ascend and entries ascend within a row; each row's leader is among them
    starts = np.searchsorted(row, np.arange(len(vectors)))
    least = np.minimum.reduceat(sums, starts) if len(vectors) else sums
    hits = np.flatnonzero(sums == least[row])
    found = entry[hits[np.searchsorted(row[hits], np.arange(len(vectors)))]] if len(vectors) else entry
    return found, least // width


def integers(columns: pa.Array, width: int) -> np.ndarray:
    """(n, width) of floor(SCALE * x); shorter vectors end in zeros.

    Where a number is too large for sums of 63 bits, all are Python integers of any size.
    """
    lengths = np.diff(columns.offsets.to_numpy())
    values = columns.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(values * SCALE) if not len(values) or np.abs(values).max() < SAFE / SCALE else None
    if scaled is None or width > PARTS * WIDE:
        whole = np.empty(len(values), object)
        for i, x in enumerate(values.tolist()):
            top, bottom = x.as_integer_ratio()
            whole[i] = top * SCALE // bottom
    else:
        whole = scaled.astype(np.int64)
    out = np.zeros((len(columns), width), whole.dtype)
    out[np.arange(width) < lengths[:, None]] = whole
    return out


def sound(column: str = "embedding"):
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False))


def _wide(books: np.ndarray) -> np.ndarray:
    """Codebooks of Python integers if any component is too large for sums of 63 bits."""
    return books if all(abs(int(x)) < SAFE for x in books.flat) else books.astype(object)


def _assigned(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, PARTS) nearest entries and their squared distances."""
    if vectors.dtype == object:
        books = books.astype(object)
    elif books.dtype == object:
        vectors = vectors.astype(object)
    cut = vectors.reshape(len(vectors), PARTS, -1)
    found = [nearest(cut[:, p], books[p]) for p in range(PARTS)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


_SUMS = "part int, entry int, n long, sums array<string>"


def _sums(kept: DataFrame, books: np.ndarray, width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and componentwise sums per (part, entry): added up in each task, then across tasks.

    The result has PARTS * ENTRIES rows at most, whatever the table's size.
    Sums travel as decimal strings, as they may have any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, books.shape[1]), np.int64)
        total = np.zeros(books.shape, object)
        for batch in batches:
            vectors = integers(batch.column("embedding"), width)
            index, _ = _assigned(vectors, books)
            cut = vectors.reshape(len(vectors), PARTS, -1)
            for p in range(PARTS):
                count[p] += np.bincount(index[:, p], minlength=books.shape[1])
                part = np.zeros(books.shape[1:], cut.dtype)
                np.add.at(part, index[:, p], cut[:, p])
                total[p] += part
        used = np.argwhere(count)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(count[count > 0]),
                pa.array([[str(x) for x in total[p, e]] for p, e in used], pa.list_(pa.string())),
            ],
            ["part", "entry", "n", "sums"],
        )

    def add(key: tuple, table: pa.Table) -> pa.Table:
        sums = [str(sum(map(int, column))) for column in zip(*table.column("sums").to_pylist())]
        n = sum(table.column("n").to_pylist())
        return pa.table(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([n]), pa.array([sums])],
            names=["part", "entry", "n", "sums"],
        )

    each = kept.mapInArrow(run, _SUMS).groupBy("part", "entry").applyInArrow(add, _SUMS)
    return {(r["part"], r["entry"]): (r["n"], [int(x) for x in r["sums"]]) for r in each.collect()}


def first_books(kept: DataFrame, width: int) -> np.ndarray:
    """(PARTS, entries, width / PARTS): the parts of the vectors with the smallest ids; ties by the vectors, null ids last."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(ENTRIES).select("embedding").collect()
    lists = pa.array([r["embedding"] for r in rows], pa.list_(pa.float64()))
    vectors = integers(lists, width)
    return _wide(vectors.reshape(len(rows), PARTS, -1).transpose(1, 0, 2))


def fit(kept: DataFrame, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after some rounds of assigning all vectors and moving each used entry to its parts' mean, rounded down."""
    books = first_books(kept, width)
    for _ in range(rounds):
        moved = books.astype(object)
        for (part, entry), (n, sums) in _sums(kept, books, width).items():
            moved[part, entry] = [s // n for s in sums]
        books = _wide(moved.astype(np.int64) if all(abs(x) < SAFE for x in moved.flat) else moved)
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in books.flat).encode()).hexdigest()


def coded(kept: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, code, error): two hex digits per part; null errors do not fit a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, apart = _assigned(integers(batch.column("embedding"), width), books)
            errors = [e if e < 1 << 63 else None for e in map(int, apart.sum(1))]
            codes = [bytes(row).hex() for row in index.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    return kept.mapInArrow(run, "vec_id long, label string, code string, error long")


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every sound row of (vec_id, embedding, label).

    Rows without a vector, or with a null or non-finite component, are left
    out.  A vector is as wide as the longest one, rounded up to PARTS parts of
    the same size; shorter vectors end in zeros, and empty ones are all zeros.
    Rows that repeat come back as often; null ids are larger than all others.
    With fewer than ENTRIES rows the codebooks are smaller.  Numbers of any
    size are counted exactly; an error or sum that does not fit a long is null.
    An empty table gives an empty result; other columns are not read.
    """
    kept = stage(
        vectors.where(sound()).select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"),
            F.col("label").cast("string").alias("label"),
        )
    )
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    width = max(PARTS, -(-longest // PARTS) * PARTS)
    if kept.isEmpty():
        none = coded(kept, np.zeros((PARTS, 1, 1), np.int64), PARTS)
        return none.select("vec_id", "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = fit(kept, width)
    rows = stage(coded(kept, books, width))
    # null labels are one group; the sums have one row per label, each task adds its own rows up first
    name = F.coalesce(F.concat(F.lit("l"), F.col("label")), F.lit(""))
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = stage(
        rows.groupBy(name.alias("_name")).agg(
            F.when(F.count("*") == F.count("error"), total).cast("decimal(38,0)").alias("_sum")
        )
    )
    fits = F.when(F.abs("_sum") < F.lit(2**63 - 1).cast("decimal(38,0)"), F.col("_sum").cast("long"))
    return rows.join(sums, name == F.col("_name")).select(
        "vec_id", "code", "error", fits.alias("label_error"), F.lit(books_sha256(books)).alias("codebooks_sha256")
    )
