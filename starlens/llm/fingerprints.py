"""SimHash fingerprints and Hamming search in permuted block tables, all in built-in functions."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.llm.common import NO_ID, key_of, stage, text_of

BITS = 64
WORD = r"[^\x20\x09-\x0D]+"

#: A term weighs 1, and one more for each LETTERS characters of its first word, MOST at most.
LETTERS = 4
MOST = 4

# Votes are added in lanes of LANE bits, several to a long; a chunk of terms must not overflow a lane.
LANE = 16
LANES = BITS // LANE
CHUNK = (1 << (LANE - 2)) // MOST
ONES = sum(1 << (LANE * i) for i in range(LANES))

RADIUS = 2

#: Blocks of a fingerprint, and how many of them a table sorts to the front.
BLOCKS = 6
FRONT = BLOCKS - RADIUS


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def fingerprint_texts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fp): one row per distinct ``keys`` of (keys, text), fp 0 for a text without words.

    A term is a word with the one after it, A-Z and other letters in lower
    case; its hash's bits vote with the term's weight, and a bit is 1 if more
    than half of the weight is for it.  Rows of equal keys vote together, so
    equal rows leave the fingerprint as it is.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))
    weight = lambda w: F.least(F.lit(MOST), F.lit(1) + F.floor(F.length(w) / LETTERS).cast("int"))
    terms = F.transform(
        "words",
        lambda w, i: F.struct(
            F.xxhash64(w, F.get("words", i + 1)).alias("hash"), weight(w).alias("weight")
        ),
    )
    cast = texts.select(*keys, words.alias("words")).select(*keys, F.posexplode_outer(terms).alias("place", "term"))
    cast = cast.select(
        *keys, F.floor(F.coalesce("place", F.lit(0)) / CHUNK).alias("chunk"), "term.hash",
        F.coalesce("term.weight", F.lit(0)).cast("long").alias("weight"),
    )
    votes = cast.groupBy(*keys, "chunk").agg(
        *[
            F.coalesce(F.sum(F.shiftrightunsigned("hash", j).bitwiseAND(F.lit(ONES)) * F.col("weight")), F.lit(0)).alias(f"v{j}")
            for j in range(LANE)
        ],
        F.sum("weight").alias("weight"),
    )
    lane = lambda j, i: F.shiftrightunsigned(f"v{j}", LANE * i).bitwiseAND(F.lit((1 << LANE) - 1))
    sums = votes.groupBy(*keys).agg(
        *[F.sum(lane(j, i)).alias(f"b{LANE * i + j}") for i in range(LANES) for j in range(LANE)],
        F.sum("weight").alias("weight"),
    )
    bits = [F.when(2 * F.col(f"b{b}") > F.col("weight"), F.lit(_signed(1 << b))).otherwise(F.lit(0)) for b in range(BITS)]
    return sums.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def hex_of(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal bits."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_masks(blocks: int = BLOCKS) -> list[int]:
    cuts = [round(BITS * i / blocks) for i in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, found) of distinct fingerprints (fp) with at most ``radius`` differing bits, each pair once.

    With at most ``radius`` differences, ``blocks - radius`` blocks agree.
    There is a table for each choice of so many blocks; fingerprints that agree
    in a table's blocks are compared.  A pair counts in the first table in
    which it agrees.
    """
    masks = block_masks(blocks)
    tables = [_signed(sum(masks[i] for i in c)) for c in combinations(range(blocks), blocks - radius)]

    def filed(df: DataFrame, name: str) -> DataFrame:
        entries = F.array(*[
            F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("front")) for t, m in enumerate(tables)
        ])
        return df.select(F.col("fp").alias(name), F.explode(entries).alias("e")).select(name, "e.table", "e.front")

    # the planner's sizes do not know how many rows the tables multiply, so it must not broadcast one
    met = filed(queries, "query").join(filed(index, "found").hint("merge"), ["table", "front"])
    apart = F.col("query").bitwiseXOR(F.col("found"))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(tables)])
    return met.where((F.bit_count(apart) <= radius) & (first == F.col("table"))).select("query", "found")


def next_ids(ids: DataFrame) -> DataFrame:
    """(key, most, next): each key of (key, most) with the one below it; after the smallest comes the largest.

    Keys are distinct and are ordered in ranges, one per partition; the first
    keys of the ranges, one row per partition, link them to each other.
    """
    ranged = stage(
        ids.repartitionByRange(F.desc("key")).sortWithinPartitions(F.desc("key"))
        .withColumn("part", F.spark_partition_id())
    )
    firsts = ranged.groupBy("part").agg(F.max("key").alias("first"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    links = firsts.select("part", F.coalesce(F.lead("first").over(order), F.max("first").over(whole)).alias("after"))
    inside = F.lead("key").over(Window.partitionBy("part").orderBy(F.desc("key")))
    return (
        ranged.withColumn("inside", inside).join(F.broadcast(links), "part")
        .select("key", "most", F.coalesce("inside", "after").alias("next"))
    )


def fingerprint_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_docs).

    One row per row of ``docs``.  The edited text is the text with its last
    third (n_chars / 3, rounded down) replaced by as many first characters of
    the next document in descending order of doc_id, or all it has; the last
    document is followed by the first.  ``near_edited`` and ``near_next`` are
    the likeness of the fingerprint to the edited text's and to the next
    document's; ``near_docs`` counts the other rows whose fingerprints are
    within ``radius`` bits.

    Null text counts as empty; a text without words has fingerprint 0.  A null
    doc_id sorts last and stays null.  Where rows repeat a doc_id, the next
    document is the one of the next different id, with the smallest text (and
    fingerprint) if it has several.  An empty table gives an empty result;
    other columns are not read.
    """
    marks = ["key", "h1", "h2"]
    base = docs.select(key_of().alias("key"), text_of().alias("text"))
    hashed = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2")]
    ids = stage(base.select("key", *hashed, F.char_length("text").cast("long").alias("n_chars")))
    following = stage(next_ids(ids.groupBy("key").agg(F.max("n_chars").alias("most"))))
    asked = following.select(F.col("next").alias("key"), F.col("key").alias("asks"), "most")
    heads = (
        base.join(asked, "key")
        .select(F.col("asks").alias("key"), F.expr("substring(text, 1, cast(most div 3 as int))").alias("head"))
        .groupBy("key").agg(F.min("head").alias("head"))
    )
    edited = base.join(heads, "key").select(
        "key", "text",
        F.expr(
            "concat(substring(text, 1, char_length(text) - char_length(text) div 3),"
            " substring(head, 1, cast(char_length(text) div 3 as int)))"
        ).alias("edited"),
    )
    both = edited.select(
        "key", *hashed, F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.explode(F.expr("array(named_struct('kind', 0, 'text', text), named_struct('kind', 1, 'text', edited))")).alias("t"),
    ).select(*marks, "sha", "t.kind", "t.text")
    prints = fingerprint_texts(both, [*marks, "sha", "kind"])
    prints = stage(
        prints.groupBy(*marks, "sha").agg(
            F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"),
            F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"),
        )
    )
    rows = stage(ids.join(prints, marks))
    sizes = stage(rows.groupBy("fp").agg(F.count("*").alias("n")))
    near = within_radius(sizes, sizes, radius)
    # stored, so that the join below can split the rows of a common fingerprint
    counts = stage(
        near.join(sizes.select(F.col("fp").alias("found"), "n"), "found")
        .groupBy(F.col("query").alias("fp")).agg((F.sum("n") - 1).alias("near_docs"))
    )
    nexts = following.join(
        prints.groupBy("key").agg(F.min("fp").alias("next_fp")).withColumnRenamed("key", "next"), "next"
    ).select("key", "next_fp")
    return (
        rows.join(nexts, "key").join(counts, "fp")
        .select(
            F.when(F.col("key") != F.lit(NO_ID), F.col("key")).alias("doc_id"), "n_chars",
            F.lower(F.hex("sha")).alias("edited_sha256"), hex_of("fp").alias("fingerprint"),
            hex_of("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"),
            likeness("fp", "next_fp").alias("near_next"), "near_docs",
        )
    )
