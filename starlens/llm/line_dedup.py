"""Removal of boilerplate lines that stand on many sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import free_names, key_of, stage

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 10

#: Registers of the sketches as a power of two; their standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 10

#: Standard errors around the threshold within which sites are counted exactly.
DEVIATIONS = 5

BREAK = "\n"


#: The six ASCII blanks.
BLANKS = " \t\n\v\f\r"


def line_key(line: Column) -> Column:
    """What makes lines equal: all characters except blanks around them; empty for a blank line."""
    return F.btrim(line, F.lit(BLANKS))


def text_digest() -> Column:
    """128 bits of the whole text; null counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def each_row() -> Column:
    """Tells rows without an id, or with one that repeats, apart by their texts; orders by id first."""
    return F.struct(key_of(), text_digest())


def site_of(column: str = "source") -> Column:
    """The site as a non-null string; all rows without one are one site."""
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit(""))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(h1, h2, first_key) of the lines of (key, site, h1, h2) that stand on ``min_sites`` sites or more.

    Sketches of each line's sites are merged map-side and then by line.  Lines
    whose estimate is within ``DEVIATIONS`` standard errors (and one site) of
    the threshold are counted exactly; only their rows are read for that.
    """
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"), F.min("key").alias("first_key")
    )
    margin = 1 + DEVIATIONS * 1.04 / 2 ** (lg_k / 2) * min_sites
    near = stage(sketched.where(F.col("sites") >= min_sites - margin))
    doubtful = near.where(F.col("sites") <= min_sites + margin).select("h1", "h2")
    exact = (
        lines.join(doubtful, ["h1", "h2"], "left_semi")
        .select("h1", "h2", "site").distinct()
        .groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    )
    return (
        near.join(exact, ["h1", "h2"], "left")
        .where(F.coalesce("exact", "sites") >= min_sites)
        .select("h1", "h2", "first_key")
    )


def remove_spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, identity: Column | None = None
) -> DataFrame:
    """``docs`` with cleaned text, and n_lines and n_removed in ``line_dedup``.

    A line is what stands between line feeds; blanks around it do not matter.
    One that stands on ``min_sites`` distinct values of ``source`` or more is
    boilerplate and is removed wherever it stands; with ``keep_first`` the
    document with the smallest doc_id keeps it.  Null sources are one site.
    Null texts stay null; empty texts and blank lines stay as they are; a
    document of nothing but boilerplate is left with an empty text.  Rows that
    repeat a doc_id are treated as one document, a null doc_id as the smallest.
    With ``identity`` (such as ``each_row()``) its value, not null, tells
    documents apart and orders them instead of the id.  A long text is one row
    of work: its lines are struck by their places, in time that grows with
    their number.  All columns of ``docs`` are kept, and ``text``
    alone changes.
    """
    identity = key_of() if identity is None else identity
    split = F.split(F.col("text"), BREAK)
    # what stands beside a generator is computed for each of its rows, so a text is digested before, and lines are trimmed in it
    texts = docs.select(identity.alias("key"), text_digest().alias("row"), site_of().alias("site"), F.col("text").alias("text"))
    lines = stage(
        texts.select("key", "row", "site", F.posexplode(F.transform(split, line_key)).alias("at", "line"))
        .where("line <> ''")
        .select("key", "row", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )
    spread = stage(spread_lines(lines, min_sites))
    key, row, gone, left, told = free_names(docs, "key", "row", "struck", "kept", "line_dedup")
    # rows of one identity whose texts differ, such as all without an id, have places of their own
    struck = (
        lines.select("key", "row", "at", "h1", "h2")
        .join(spread, ["h1", "h2"])
        .where((F.col("key") != F.col("first_key")) if keep_first else F.lit(True))
        .groupBy(F.col("key").alias(key), F.col("row").alias(row)).agg(F.collect_set("at").alias(gone))
    )
    touched = F.col(gone).isNotNull() & F.col("text").isNotNull()
    places = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    return (
        docs.withColumn(key, identity).withColumn(row, text_digest())
        .join(struck, [key, row], "left")
        .withColumn(left, F.when(touched, places))
        .withColumn(
            told,
            F.struct(
                F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                F.when(touched, F.size(split) - F.size(left)).otherwise(0).cast("long").alias("n_removed"),
            ),
        )
        .withColumn("text", F.when(touched, F.array_join(F.transform(left, lambda i: F.get(split, i)), BREAK)).otherwise(F.col("text")))
        .select(*docs.columns, told)
    )
