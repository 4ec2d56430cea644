"""Near duplicates by SimHash fingerprints with a pigeonring candidate filter."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import components, stage

BITS = 64
SEED = 42
SHINGLE = 3

#: Differing bits at which fingerprints still link.
RADIUS = 2

#: Segments of the ring, and how many of them the join key spans.
SEGMENTS = 3
CHAIN = 2

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words give 0."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest = xxhash.xxh64_intdigest
    join = b" ".join
    shifted = [words[i:] for i in range(shingle)]
    hashes = np.fromiter((digest(join(w), seed) for w in zip(*shifted)), np.uint64, len(words) - shingle + 1)
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * votes > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp holds the 64 bits as a signed long.

    Words are runs of characters other than the six ASCII blanks, with A-Z in
    lower case; ``bytes.split`` cuts at exactly these.  Null text counts as
    empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            prints = np.fromiter((fingerprint_of(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"]
            )

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    return texts.mapInArrow(run, "doc_id long, fp long")


def segment_bounds(segments: int = SEGMENTS) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    cuts = [round(BITS * i / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def viable_masks(start: int, chain: int, radius: int = RADIUS, segments: int = SEGMENTS) -> list[int]:
    """Differences that a chain of ``chain`` segments from ``start`` on may have.

    With at most ``radius`` differences on the whole ring, some start exists
    from which every run of n segments has at most n * radius / segments of
    them.  Other differences need not be looked for at this start.
    """
    bounds = segment_bounds(segments)
    ring = [bounds[(start + i) % segments] for i in range(chain)]
    places = [(i, bit) for i, (first, width) in enumerate(ring) for bit in range(first, first + width)]
    masks = []
    for n in range(chain * radius // segments + 1):
        for chosen in combinations(places, n):
            used = [i for i, _ in chosen]
            if all(sum(u <= i for u in used) <= (i + 1) * radius // segments for i in range(chain)):
                masks.append(sum(1 << bit for _, bit in chosen))
    return masks


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _chain_mask(start: int, chain: int, segments: int) -> int:
    bounds = segment_bounds(segments)
    total = 0
    for i in range(chain):
        first, width = bounds[(start + i) % segments]
        total |= ((1 << width) - 1) << first
    return _signed(total)


def distance(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two fingerprints."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def _first_start(difference: Column, radius: int, segments: int) -> Column:
    """The first start of the ring from which all chains keep their budgets."""
    bounds = segment_bounds(segments)
    counts = [F.bit_count(difference.bitwiseAND(F.lit(_signed(((1 << w) - 1) << first)))) for first, w in bounds]
    found = F.lit(None).cast("int")
    for start in reversed(range(segments)):
        fits = F.lit(True)
        total = F.lit(0)
        for n in range(segments):
            total = total + counts[(start + n) % segments]
            fits = fits & (total <= F.lit((n + 1) * radius // segments))
        found = F.when(fits, F.lit(start)).otherwise(found)
    return found


def similar_pairs(
    prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, chain: int = CHAIN
) -> DataFrame:
    """(a, b) of distinct fingerprints (owner, fp) with at most ``radius`` differing bits, a < b.

    Each fingerprint is filed once per start under the bits of ``chain``
    consecutive segments, and looked up under all values that differ from them
    within the proportional budgets.  Pairs that meet must keep the budgets of
    the longer chains as well and count only at their first such start, so
    every pair comes once; the last chain is the whole ring and is the full
    check.
    """
    starts = range(segments)
    filed = prints.select(
        "owner", "fp",
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("start"), F.col("fp").bitwiseAND(F.lit(_chain_mask(s, chain, segments))).alias("bits"))
            for s in starts
        ])).alias("k"),
    ).select("owner", "fp", "k.start", "k.bits")
    variants = F.array(*[
        F.array(*[F.lit(_signed(m)).cast("long") for m in viable_masks(s, chain, radius, segments)]) for s in starts
    ])
    looked = (
        filed.select("owner", "fp", "start", F.explode(F.element_at(variants, F.col("start") + 1)).alias("mask"), "bits")
        .select(
            F.col("owner").alias("other"), F.col("fp").alias("other_fp"), F.col("start").alias("other_start"),
            F.col("bits").bitwiseXOR(F.col("mask")).alias("other_bits"),
        )
    )
    # the planner's sizes do not know how many rows the variants multiply, so it must not broadcast them
    met = filed.join(
        looked.hint("merge"), (F.col("bits") == F.col("other_bits")) & (F.col("start") == F.col("other_start")) & (F.col("owner") < F.col("other"))
    )
    apart = F.col("fp").bitwiseXOR(F.col("other_fp"))
    return met.where((F.bit_count(apart) <= radius) & (_first_start(apart, radius, segments) == F.col("start"))).select(
        F.col("owner").alias("a"), F.col("other").alias("b")
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Documents link when their fingerprints differ in at most ``radius`` bits,
    and by nothing else: rows that share an id, or have none, stay apart.  The
    component's name is the smallest doc_id that can be reached; it is null
    where no row that can be reached has an id.  Each distinct fingerprint
    takes part in the search once, so copies cost one row each.  Null text
    counts as empty; empty texts have fingerprint zero and link like any other.
    Very long texts are hashed in parts and vote with all their shingles; a bit
    that is set in exactly half of them is 0.  Repeated rows come back as often
    as given.  Empty tables give empty results; other columns are not read.
    """
    prints = stage(fingerprints(docs))
    owners = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(similar_pairs(owners.select(F.col("fp").alias("owner"), "fp"), radius))
    named = stage(
        owners.join(found, F.col("fp") == F.col("node"), "left").select(
            "fp", "least", F.coalesce("component", "fp").alias("component")
        )
    )
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.select("fp", "component").join(names, "component").drop("component"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
