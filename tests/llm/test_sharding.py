import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from starlens.llm.sharding import assign, hilbert_index, shard_ranges, write_shards


@pytest.mark.parametrize("bits,dims", [(1, 2), (3, 2), (4, 2), (2, 3), (3, 3), (2, 4)])
def test_curve_is_a_walk_through_all_cells(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    place = hilbert_index(cells, bits)
    assert sorted(place) == list(range(len(cells)))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("table,shards", [("docs", 40), ("docs", 7), ("given", 40)])
def test_runs(request, table, shards):
    df = request.getfixturevalue(table)
    rows = assign(df, shards).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) <= set(range(shards))
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_ranges_prune(given):
    ranges = shard_ranges(given, assign(given, 8)).collect()
    assert len(ranges) == 8
    total = given.count()
    wanted = [sum(r.rows for r in ranges if r.least_source <= s <= r.most_source) for s in ("src0", "src5")]
    assert min(wanted) < total
    assert sum(r.rows for r in ranges) == total


def test_written(given, tmp_path, spark):
    where = assign(given, 5)
    write_shards(given, where, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: r.shard for r in back.collect()} == {r.doc_id: r.shard for r in where.collect()}


@pytest.mark.parametrize("table", ["docs", "given"])
def test_equal_texts_stand_together(request, table):
    df = request.getfixturevalue(table)
    # ids that are null or repeat must not part or join anything
    for rows in (df, df.withColumn("doc_id", F.when(F.xxhash64("text") % 3 > 0, F.col("doc_id") % 5))):
        found = assign(rows, 6).collect()
        assert len(found) == df.count()
        runs = defaultdict(list)
        for at, r in enumerate(sorted(found, key=lambda r: (r.shard, r.slot))):
            runs[(r.size, r.text_crc32)].append(at)
        assert all(x == list(range(x[0], x[0] + len(x))) for x in runs.values())


@pytest.mark.parametrize("table", ["docs", "given"])
def test_order_is_that_of_the_curve(request, table):
    """Cells by brute force: strings by rows with smaller whole values, numbers by the quantiles they exceed."""
    df = request.getfixturevalue(table).withColumn("source", F.concat(F.lit("https://www.site/"), "source"))
    rows = df.select("doc_id", "text", "source", "lang").collect()
    key = lambda v: (v is not None, (v or "").encode())
    cells = []
    for column in ("source", "lang"):
        values = sorted((r[column] for r in rows), key=key)
        cells.append({v: values.index(v) * 16 // len(values) for v in set(values)})
    low = -(1 << 70)
    ids = sorted(low if r.doc_id is None else r.doc_id for r in rows)
    cuts = [ids[max(0, -(-i * len(ids) // 16) - 1)] for i in range(1, 16)]
    points = [
        [cells[0][r.source], cells[1][r.lang], sum((low if r.doc_id is None else r.doc_id) > c for c in cuts)] for r in rows
    ]
    place = dict()
    for r, p in zip(rows, hilbert_index(np.array(points))):
        text = zlib.crc32((r.text or "").encode())
        place[text] = min(place.get(text, p), p)
    found = [place[r.text_crc32] for r in sorted(assign(df, 6).collect(), key=lambda r: (r.shard, r.slot))]
    assert len(set(place.values())) > 10 and found == sorted(found)


def test_empty_table(nothing):
    assert assign(nothing).count() == 0
