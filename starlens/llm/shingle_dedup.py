"""Near copies by the Jaccard similarity of their word shingles, with MinHash buckets as candidate filter."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import components, free_names, key_of, stage, text_of

SHINGLE = 5

#: Similarity from which on documents link, as a fraction.
SIMILAR = (4, 5)

#: MinHash values in one bucket's key, and buckets of each document.  A pair of similarity s shares a bucket
#: with probability 1 - (1 - s ** DEPTH) ** BUCKETS: 0.9999 at 0.8, 0.02 at 0.3.
DEPTH = 6
BUCKETS = 30

SEED = 42

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=(DEPTH * BUCKETS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Shingles that are drawn at once, which bounds the memory for a long text.
_PART = 1 << 12

#: Rows whose words and sets a worker holds at once.
_SLICE_ROWS = 128


def _scrambled(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """Runs of characters other than the six ASCII blanks, with A-Z in lower case."""
    return text.translate(_LOWER).split()


def shingles_of(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of runs of ``shingle`` words, ascending; fewer words are one shingle, no words none."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    width = min(shingle, len(words))
    places = len(words) - width + 1 if words else 0
    rolled = np.full(places, width, np.uint64)
    for i in range(width):
        rolled = rolled * _ODD + hashes[i : i + places]
    return np.unique(_scrambled(rolled))


def buckets_of(shingles: np.ndarray) -> np.ndarray:
    """One key per bucket; none without shingles."""
    if not len(shingles):
        return np.empty(0, np.uint64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _PART):
        np.minimum(least, (shingles[i : i + _PART] * _FACTORS).min(1), out=least)
    keys = np.arange(BUCKETS, dtype=np.uint64)
    for values in least.reshape(BUCKETS, DEPTH).T:
        keys = _scrambled(keys * _ODD + values)
    return keys


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    values = np.concatenate([*arrays, np.empty(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in parts that keep few word lists and sets in memory at once."""
    for batch in batches:
        for start in range(0, len(batch), _SLICE_ROWS):
            yield batch.slice(start, _SLICE_ROWS)


def signatures(rows: DataFrame, row: str) -> DataFrame:
    """(row, key, h1, h2, size, buckets): 128 bits of the words, number of shingles, keys of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            words = [words_of(t.as_py()) for t in batch.column("text")]
            whole = np.frombuffer(b"".join(xxhash.xxh128_digest(b" ".join(w), SEED) for w in words), np.int64).reshape(-1, 2)
            sets = [shingles_of(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("key"), pa.array(whole[:, 0].copy()), pa.array(whole[:, 1].copy()),
                    pa.array([len(s) for s in sets], pa.int64()), _lists([buckets_of(s) for s in sets]),
                ],
                ["row", "key", "h1", "h2", "size", "buckets"],
            )

    texts = rows.select(F.col(row).alias("row"), key_of().alias("key"), text_of().cast("binary").alias("text"))
    return texts.mapInArrow(run, "row long, key long, h1 long, h2 long, size long, buckets array<long>")


def shingle_sets(rows: DataFrame, row: str) -> DataFrame:
    """(node, shingles) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingles_of(words_of(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(sets)], ["node", "shingles"])

    texts = rows.select(F.col(row).alias("node"), text_of().cast("binary").alias("text"))
    return texts.mapInArrow(run, "node long, shingles array<long>")


def _sizes_allow(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    part, whole = SIMILAR
    return F.least(a, b) * whole >= F.greatest(a, b) * part


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingles are similar enough, counted exactly."""
    part, whole = SIMILAR
    shared = F.size(F.array_intersect("left", "right"))
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")).hint("merge"), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")).hint("merge"), "b")
        .where(shared * (part + whole) >= (F.size("left") + F.size("right")) * part)
        .select("a", "b")
    )


def similar_links(rows: DataFrame, row: str, filed: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs that share a bucket of (node, size, bucket).

    First each document of a bucket is compared with the bucket's hub, the one
    that meets most others in all its buckets, so a large group of near copies
    costs one pair per document and hub.  Documents of buckets that still hold
    several components are then compared across components, if they agree in
    one of their rarest shingles (``across``).
    """
    counts = filed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(filed.join(counts, "bucket"))
    meetings = met.groupBy("node").agg(F.sum("n").alias("meetings"))
    hubs = met.join(meetings, "node").groupBy("bucket").agg(
        F.max(F.struct("meetings", (-F.col("node")).alias("order"), "node", "size")).alias("hub")
    )
    spokes = stage(met.join(hubs, "bucket").where(F.col("node") != F.col("hub.node")).select("bucket", "node", "size", "hub"))
    pairs = stage(
        spokes.where(_sizes_allow(F.col("size"), F.col("hub.size")))
        .select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
        .distinct()
    )
    sets = stage(shingle_sets(_rows_of(rows, row, pairs.select("a").union(pairs.select("b"))), row))
    links = stage(_similar(pairs, sets))
    # each has been compared with the hub, so only the others of a bucket may still have unseen links
    labelled = stage(
        spokes.join(components(links), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    )
    mixed = (
        labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high").select("bucket")
    )
    open_nodes = stage(labelled.join(mixed, "bucket", "left_semi").select("node", "component").distinct())
    if open_nodes.isEmpty():
        return links
    sets = stage(shingle_sets(_rows_of(rows, row, open_nodes.select("node")), row))
    return links.unionByName(_similar(across(open_nodes, sets), sets))


def _rows_of(rows: DataFrame, row: str, nodes: DataFrame) -> DataFrame:
    (node,) = nodes.columns
    return rows.join(nodes.select(F.col(node).alias(row)).distinct(), row, "left_semi")


#: Sizes of one class differ by less than this factor.
CLASS = 1.06

#: Classes that sizes of similar sets lie apart at most.
CLASSES_APART = 4


def least_shared(a: int, b: int) -> int:
    """Elements that similar sets of these sizes have in common at least."""
    part, whole = SIMILAR
    return -(-(a + b) * part // (part + whole))


def rarest_keys(shingles: list[int]) -> Iterator[tuple[int, int, int, bool, int]]:
    """(shingle, class, apart, larger, rest) under which a set, its rarest shingles first, meets every similar one.

    Similar sets share all but a few elements, so they share one of the first
    of both, in any order that is the same for all.  How many are needed
    depends on both sizes; sets meet under the class of the smaller one and the
    number of classes between them.  ``rest`` counts this shingle and those
    behind it: if fewer are left than must be shared, the sets are not similar
    or meet at an earlier one.
    """
    n, (part, whole) = len(shingles), SIMILAR
    own = int(math.log(n) / math.log(CLASS)) if n else 0
    for apart in range(-CLASSES_APART, CLASSES_APART + 1):
        # the smallest size of the other class gives the longest prefix; one less for rounding
        other = max(int(CLASS ** (own + apart)) - 1, -(-n * part // whole))
        for i, shingle in enumerate(shingles[: max(n - least_shared(n, other) + 1, 0)]):
            yield shingle, min(own, own + apart), abs(apart), apart < 0, n - i


def across(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, component) in different components that share one of their rarest shingles.

    No similar pair of different components is left out.  Near copies of one
    text that are not similar enough differ in many shingles of their own, and
    those come first, so the shingles that all of them share lead few together.
    """
    each = sets.select("node", F.explode("shingles").alias("shingle"))
    rarity = each.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = (
        each.join(rarity.where("n > 1"), "shingle", "left").groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "shingle"))).alias("ranked"))
        .select("node", F.col("ranked.n").alias("n"), F.col("ranked.shingle").alias("shingles"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for node, numbers, shingles in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "shingles"))):
                # a shingle of one text alone takes a place but leads nowhere
                alone = {s for s, n in zip(shingles, numbers) if n == 1}
                for key in rarest_keys(shingles):
                    if key[0] not in alone:
                        for column, value in zip(out, (node, len(shingles), *key)):
                            column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["node", "size", "shingle", "class", "apart", "larger", "rest"]
            )

    keys = ranked.mapInArrow(run, "node long, size int, shingle long, class int, apart int, larger boolean, rest int")
    side = F.when(F.col("apart") != 0, F.col("larger")).alias("side")
    keyed = stage(keys.select("node", "size", "rest", F.xxhash64("shingle", "class", "apart").alias("place"), side).join(nodes, "node"))
    # only places with several components lead on; of two there at least one is not the place's smallest
    mixed = keyed.groupBy("place").agg(F.min("component").alias("main"), F.max("component").alias("high")).where("main <> high")
    mixed = stage(keyed.join(mixed.drop("high"), "place"))
    others = mixed.where("component <> main").select(
        "place", *[F.col(c).alias(f"other_{c}") for c in ("component", "side", "size", "rest")], F.col("node").alias("other")
    )
    facing = F.col("side").isNull() | (F.col("side") != F.col("other_side"))
    part, whole = SIMILAR
    enough = F.least("rest", "other_rest") * (part + whole) >= (F.col("size") + F.col("other_size")) * part
    return (
        mixed.join(others, "place").where(facing & enough & (F.col("component") != F.col("other_component")))
        .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    )


def _links_of(named: DataFrame, owners: DataFrame) -> DataFrame:
    """Links (a, b) of the rows (node) that ``named`` (doc_id, component_id) puts into one component."""
    own = stage(owners.select(F.col("node").alias("doc_id")).join(named.select("doc_id", "component_id"), "doc_id"))
    first = own.groupBy("component_id").agg(F.min("doc_id").alias("a"))
    return own.join(first, "component_id").where(F.col("a") != F.col("doc_id")).select("a", F.col("doc_id").alias("b"))


def one_per_group(docs: DataFrame, near: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The first row by (doc_id, place) of each group of near copies, all columns kept.

    Rows link when the sets of their five-word shingles have a Jaccard
    similarity of 0.8 or more (on 64-bit hashes), or when their words are the
    same; a group is what links connect.  Rows are told apart by their place
    in a stored copy, so null and repeated ids link nothing.  Null text counts
    as empty, and texts without words are copies of each other.  With ``near``,
    such as ``simhash_dedup.near_duplicates``, rows link as well if it puts
    them into one component (it gets doc_id, the row's place, and text).
    """
    (row,) = free_names(docs, "row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), compression="zstd")
    prints = stage(signatures(rows, row))
    owners = stage(
        prints.groupBy("h1", "h2").agg(F.min(F.struct("key", "row")).alias("o"))
        .select(F.col("o.key").alias("key"), F.col("o.row").alias("node"))
    )
    filed = stage(
        prints.join(owners.select("node"), F.col("row") == F.col("node"))
        .select("node", "size", F.explode("buckets").alias("bucket"))
    )
    links = similar_links(rows, row, filed)
    if near is not None:
        links = links.unionByName(_links_of(near(rows.select(F.col(row).alias("doc_id"), "text")), owners))
    found = components(links)
    kept = (
        owners.join(found, "node", "left")
        .groupBy(F.coalesce("component", "node"))
        .agg(F.min(F.struct("key", "node")).alias("k"))
        .select(F.col("k.node").alias(row))
    )
    return rows.join(kept, row, "left_semi").select(*docs.columns)
