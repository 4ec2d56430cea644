"""Mixing sources to target weights by a low-discrepancy schedule of token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.llm.common import BUCKET_ROWS, NO_ID, free_names, hash_fraction, key_of, running_total, stage

WEIGHTS = (5, 2, 1)

#: Words of the mix per word given.
SHARE = 1.5

#: A source may be taken so many times at most.
MOST = 2

#: Words in a block, about.
BLOCK_WORDS = 1024

#: Sources are a list that someone has set weights for; more than this many is an error.
MAX_SOURCES = 100_000

#: Slots in one bucket when ranks are given out.
SLOT_BUCKET = 4096

# Golden-ratio points as whole numbers of POINT_BITS bits: multiples of an odd number near 2^31 / 1.618...
POINT_BITS = 31
GOLDEN = 1327217885

#: Equal cells of the points, in which sources are looked up.
CELLS = 1 << 12

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Share ``total`` by weight; what a source has over ``most`` times its size goes to the others by weight."""
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    left, weight = float(total), float(sum(weights))
    out = [0.0] * len(sizes)
    for n, i in enumerate(order):
        cap = float(most * sizes[i])
        if weight > 0 and left * weights[i] / weight >= cap:
            out[i] = cap
            left -= cap
            weight -= weights[i]
            continue
        for j in order[n:]:
            out[j] = left * weights[j] / weight
        break
    return out


def plan(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[dict]:
    """One entry per source: source, rows, size, target (rounded to millionths of a word), words to take."""
    found = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    found = found.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    # Python compares strings by code point
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in found]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    return [
        {
            "no": i, "source": r["source"], "rows": r["rows"], "size": r["size"], "target": round(t, 6),
            "words": min(round(t), most * r["size"]),
        }
        for i, (r, t) in enumerate(zip(found, wanted))
    ]


def schedule(spark: SparkSession, entries: list[dict], block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(slot, no, block, first, last) and (no, words, blocks): which block of which source each slot takes.

    Slot k has the point k * golden ratio modulo 1, and the source is the one
    whose stretch of the cumulative weights the point falls into.  A source's
    slots are ranked; the slot of rank b takes block b of its circular stream,
    [first, last), and all its blocks have equal size up to one word, so its
    words come to the planned number.  A source with words to give but without
    a point gets one slot behind the others.
    """
    giving = [e for e in entries if e["words"] > 0]
    total = sum(e["words"] for e in giving)
    slots = -(-total // block_words)
    size = 1 << POINT_BITS
    ends, passed = [], 0
    for e in giving:
        passed += e["words"]
        ends.append(passed * size // total)
    # both tables have a bounded number of rows: cells and sources
    stretches = spark.createDataFrame(_cells(giving, ends, size), "cell int, no int, low long, high long")
    wanted = spark.createDataFrame([(e["no"], e["words"]) for e in giving], "no int, words long")
    drawn = spark.range(slots).select(
        F.col("id").alias("slot"), (F.col("id") % size * GOLDEN % size).alias("point")
    )
    placed = (
        drawn.withColumn("cell", F.floor(F.col("point") / (size // CELLS)).cast("int"))
        .join(F.broadcast(stretches), "cell")
        .where("point >= low and point < high")
        .select("slot", "no")
    )
    missing = wanted.join(placed.select("no").distinct(), "no", "left_anti").select(
        (F.lit(slots) + F.col("no")).cast("long").alias("slot"), "no"
    )
    placed = stage(placed.unionByName(missing).withColumn("bucket", F.floor(F.col("slot") / SLOT_BUCKET)))
    counts = wanted.join(placed.groupBy("no").agg(F.count("*").alias("blocks")), "no")
    ranked = running_total(placed, ["no"], "bucket", ["slot"], F.lit(1), "block")
    start = "cast(((cast({} as decimal(38,0)) * words) div blocks) as long)"
    return (
        ranked.join(F.broadcast(counts), "no")
        .select("slot", "no", "block", F.expr(start.format("block")).alias("first"),
                F.expr(start.format("block + 1")).alias("last"))
        .where("last > first"),
        counts,
    )


def _cells(giving: list[dict], ends: list[int], size: int) -> list[tuple[int, int, int, int]]:
    """The stretches of the sources, cut at the borders of equal cells, for a join by equality."""
    width, low, out = size // CELLS, 0, []
    for e, high in zip(giving, ends):
        while low < high:
            cell = low // width
            stop = min(high, (cell + 1) * width)
            out.append((cell, e["no"], low, stop))
            low = stop
    return out


def shuffled_streams(sized: DataFrame, entries: list[dict], seed: int) -> DataFrame:
    """(row columns, no, offset): each source's documents in hash order, with the words before them."""
    spark = sized.sparkSession
    known = spark.createDataFrame(
        [(e["no"], e["source"], max(1, -(-e["rows"] // BUCKET_ROWS)), e["size"]) for e in entries],
        "no int, source string, buckets long, source_size long",
    )
    numbered = sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["source"])).drop(known["source"])
    spot = hash_fraction("key", F.lit(seed))
    rows = stage(
        numbered.withColumn("spot", spot).withColumn("bucket", F.floor(F.col("spot") * F.col("buckets"))).drop("buckets")
    )
    return running_total(rows, ["no"], "bucket", ["spot", "key", "row"], F.col("size"), "offset")


def mix(sized: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS,
        share: float = SHARE, most: float = MOST) -> tuple[DataFrame, list[dict]]:
    """Pieces of the mix and the plan of the sources.

    ``sized`` has key, row (sets rows of one key apart), source and size, all
    but the source not null; it is a stored table.  A piece (slot, key, row,
    start, words, pass) says that the slot takes ``words`` words of the
    document from word ``start`` on, in the given pass through its source.
    """
    spark = sized.sparkSession
    entries = plan(sized, weights, share, most)
    if not any(e["words"] for e in entries):
        return spark.createDataFrame([], "slot long, key long, row long, start long, words long, pass int"), entries
    slots, counts = schedule(spark, entries, block_words)
    stream = shuffled_streams(sized, entries, seed).where("size > 0").join(F.broadcast(counts), "no")
    turns = stream.select(
        "key", "row", "no", "size", "words", "blocks",
        F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1))).alias("pass"), "offset", "source_size",
    ).withColumn("begin", F.col("offset") + F.col("pass") * F.col("source_size")).where("begin < words")
    # the block of word w is the largest b with (b * words) div blocks <= w
    of = "cast((((cast({} as decimal(38,0)) + 1) * blocks - 1) div words) as long)"
    reached = turns.select(
        "key", "row", "no", "size", "pass", "begin",
        F.explode(
            F.sequence(F.expr(of.format("begin")), F.expr(of.format("(least(begin + size, words) - 1)")))
        ).alias("block"),
    )
    met = reached.join(slots, ["no", "block"])
    low, high = F.greatest("begin", "first"), F.least(F.col("begin") + F.col("size"), F.col("last"))
    return (
        met.where(high > low).select(
            "slot", "key", "row", (low - F.col("begin")).alias("start"), (high - low).alias("words"), "pass"
        ),
        entries,
    )


def sizes_of(docs: DataFrame) -> DataFrame:
    """(key, row, source, size) of every row of ``docs``, stored; row is the place in the table's splits."""
    return stage(
        docs.select(
            key_of().alias("key"), F.monotonically_increasing_id().alias("row"),
            F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"),
        )
    )


def taken(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    Sources by code point (null last) have the weights in turn.  They share
    ``share`` times all words; no target is over ``most`` times its source.
    Documents without words take nothing.  A null doc_id stays null, repeated
    rows are documents of their own, an empty table gives an empty result, and
    other columns are not read.
    """
    sized = sizes_of(docs)
    pieces, entries = mix(sized, **settings)
    sums = pieces.groupBy("key", "row").agg(F.sum("words").alias("taken"))
    spark = sized.sparkSession
    known = spark.createDataFrame(
        [(e["source"], e["size"], e["target"]) for e in entries], "source string, source_size long, target double"
    )
    return (
        sized.join(sums, ["key", "row"], "left")
        .join(F.broadcast(known), sized["source"].eqNullSafe(known["source"]))
        .select(
            F.when(F.col("key") != F.lit(NO_ID), F.col("key")).alias("doc_id"), "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mix: one row per document and pass, all columns of ``docs``.

    The pass that the target ends in takes only part of one document per
    source; its text is cut to the words taken.  Documents without words stay
    as they are, once.  Rows are in no order; ``mix`` has the order of the
    slots.
    """
    key, row, size, words = free_names(docs, "key", "row", "size", "words")
    sized = sizes_of(docs)
    pieces, _ = mix(sized, **settings)
    wholes = pieces.groupBy("key", "row", "pass").agg(F.sum("words").alias("words"))
    drawn = stage(
        sized.join(wholes, ["key", "row"], "left").where("size = 0 or words is not null").select(
            F.col("key").alias(key), F.col("row").alias(row), F.col("size").alias(size), F.col("words").alias(words)
        )
    )
    on = [key]
    if not sized.groupBy("key").count().where("count > 1").isEmpty():
        on = [key, row]  # rows of one id are told apart by their place in the table's files
    marked = docs.withColumn(key, key_of()).withColumn(row, F.monotonically_increasing_id())
    if row not in on:
        marked, drawn = marked.drop(row), drawn.drop(row)
    every_word = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    part = F.array_join(F.slice(every_word, F.lit(1), F.col(words).cast("int")), " ")
    return (
        marked.join(drawn, on)
        .withColumn("text", F.when(F.col(words) < F.col(size), part).otherwise(F.col("text")))
        .select(*docs.columns)
    )
