from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from starlens.llm import line_dedup
from starlens.llm.line_dedup import each_row, remove_spread_lines, spread_lines

BLANKS = " \t\n\v\f\r"


def brute(rows, least, keep_first=True):
    sites, first = defaultdict(set), {}
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            if k := line.strip(BLANKS):
                sites[k].add(s)
                first[k] = min(first.get(k, 1 << 60), -(2**63) if d is None else d)
    out = Counter()
    for d, t, s in rows:
        if t is None:
            out[(d, None)] += 1
            continue
        me = -(2**63) if d is None else d
        gone = lambda x: x in sites and len(sites[x]) >= least and not (keep_first and first[x] == me)
        out[(d, "\n".join(x for x in t.split("\n") if not gone(x.strip(BLANKS))))] += 1
    return out


@pytest.mark.parametrize("keep_first", [True, False])
def test_equals_brute_force(docs, keep_first):
    extra = docs.withColumn("text", F.concat("text", F.lit("\n  shared line \n\nown "), F.col("source"), F.lit("\nlast")))
    for least in (2, 4, 5):
        got = Counter((r.doc_id, r.text) for r in remove_spread_lines(extra, least, keep_first).collect())
        rows = [(r.doc_id, r.text, r.source) for r in extra.collect()]
        assert got == brute(rows, least, keep_first)


def test_counts_and_columns(docs, given):
    out = remove_spread_lines(given, 3)
    assert out.columns == given.columns + ["line_dedup"]
    for r in out.join(given.select("doc_id", F.col("text").alias("before")), "doc_id").collect():
        assert r.line_dedup.n_lines == r.before.count("\n") + 1
        if r.line_dedup.n_lines > r.line_dedup.n_removed:
            assert r.line_dedup.n_removed == r.before.count("\n") - r.text.count("\n")
    assert remove_spread_lines(docs).columns == docs.columns + ["line_dedup"]


def test_near_threshold_is_exact(spark):
    rows = [(i, 0, j, f"s{j % (i + 1)}") for i in range(60) for j in range(60)]
    lines = spark.createDataFrame(rows, "h1 long, h2 long, key long, site string")
    got = {r.h1 for r in spread_lines(lines, 30, lg_k=4).collect()}
    assert got == set(range(29, 60))


def test_rows_without_ids_are_told_apart(docs, given):
    for df in (docs, given):
        few = df.withColumn("doc_id", F.when(F.xxhash64("text") % 3 > 0, F.col("doc_id") % 7))
        rows = [(r.doc_id, r.text, r.source) for r in few.collect()]
        for least in (2, 3):
            assert Counter((r.doc_id, r.text) for r in remove_spread_lines(few, least).collect()) == brute(rows, least)
            # by id and text, the first row alone keeps a line
            names = {x: i for i, x in enumerate(sorted((r["k"], r["text"] or "") for r in few.select(each_row().alias("k"), "text").collect()))}
            told = few.select("doc_id", "text", "source", each_row().alias("k")).collect()
            want = Counter(t for _, t in brute([(names[(r["k"], r["text"] or "")], r["text"], r["source"]) for r in told], least).elements())
            assert Counter(r.text for r in remove_spread_lines(few, least, identity=each_row()).collect()) == want


def test_long_text_of_boilerplate(spark):
    text = "\n".join(f"line {i % 5000}" for i in range(60000))
    df = spark.createDataFrame([(i, f"{text}\nown {i}", f"s{i}") for i in range(3)], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in remove_spread_lines(df, 3).collect()}
    assert got == {0: f"{text}\nown 0", 1: "own 1", 2: "own 2"}


def test_blanks_before_other_line_ends_count(spark):
    """Only blanks around the whole line are left out, not those in front of another character that ends lines."""
    rows = [(i, f"own {i}\nseen {end}", f"s{i}") for i, end in enumerate(["\u2028", "\u0085", " \u2028", "  \u0085", "\u2028\t", "\r"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (2, 3):
        got = Counter((r.doc_id, r.text) for r in remove_spread_lines(df, least).collect())
        assert got == brute(rows, least)


def test_texts_are_digested_once_and_not_for_each_line(docs, monkeypatch):
    plans = []
    monkeypatch.setattr(line_dedup, "stage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    remove_spread_lines(docs)
    above, generated, below = plans[0].partition("Generate posexplode")
    assert generated and "coalesce(text" not in above and "coalesce(text" in below


def test_empty_table(nothing):
    assert remove_spread_lines(nothing).count() == 0
