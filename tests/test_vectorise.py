"""Totals of terms against plain counting, with repeated and missing keys."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from starlens.functions import text as T
from starlens.operators import vectorise
from starlens.session import PART_BYTES, parts_of

ROWS = [
    (1, "good food good"), (2, "bad food"), (2, "food again good"), (None, "good place"), (None, "place good place"),
    (3, ""), (4, None), (5, "a ab abc abcd"), (6, "the the the"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "review_id long, text string").repartition(3)


def plain(grams) -> dict:
    uses, holders = Counter(), defaultdict(set)
    for key, text in ROWS:
        for term in grams(text or ""):
            uses[term] += 1
            holders[term].add(key)
    return {t: (len(holders[t]), n) for t, n in uses.items()}


def words(text):
    parts = [p for i, w in enumerate(text.split(" ")) for p in ([" ", w] if i else [w]) if p]
    return parts + [f"{a} {b}" for a, b in zip(parts, parts[1:])]


def pieces(text):
    out = []
    for padded in (f" {w} " for w in text.split()):
        out += [padded[i : i + n] for n in range(3, 6) if n == 3 or n <= len(padded) for i in range(max(len(padded) - n + 1, 1))]
    return out


def listed(totals) -> dict:
    return {r["term"]: (r["df"], r["ctf"]) for r in totals.collect()}


def test_totals_need_no_grouping_by_document(rows):
    docs = vectorise.by_document(rows)
    assert listed(vectorise.word_totals(docs)) == plain(words) == listed(vectorise.term_totals(vectorise.term_counts(vectorise.word_terms(docs))))
    assert listed(vectorise.char_totals(docs)) == plain(pieces) == listed(vectorise.term_totals(vectorise.term_counts(vectorise.char_terms(docs))))
    lists = vectorise.by_document(vectorise.word_lists(rows))
    assert listed(vectorise.totals_of_lists(lists)) == plain(words)


def test_parts_grow_with_the_files(spark, tmp_path):
    few = spark.range(10).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    few.write.parquet(str(tmp_path / "few"))
    many = spark.range(130_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text"))
    many.coalesce(1).write.option("compression", "none").parquet(str(tmp_path / "many"))
    cores = spark.sparkContext.defaultParallelism
    assert parts_of(spark.read.parquet(str(tmp_path / "few"))) == cores
    stored = spark.read.parquet(str(tmp_path / "many"))
    size = sum(f.stat().st_size for f in (tmp_path / "many").glob("*.parquet"))
    assert parts_of(stored) == max(cores, -(-size // PART_BYTES)) > cores or size <= cores * PART_BYTES
    # adaptive execution does not merge them again
    assert vectorise.by_document(stored, "id").rdd.getNumPartitions() == parts_of(stored)


def test_ngrams_of_lists_without_words(spark):
    made = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],), (None,)], "w array<string>")
    got = [r[0] for r in made.select(T.word_ngrams(F.col("w"), 2, 3)).collect()]
    assert got == [[], [], ["a b", "b c", "a b c"], []]
