import re
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from starlens.llm.common import components
from starlens.llm.simhash_dedup import fingerprint_of, near_duplicates, similar_pairs, viable_masks


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("table", ["docs", "given"])
def test_equals_brute_force(request, table):
    df = request.getfixturevalue(table)
    assert_as_brute(df)


def assert_as_brute(df):
    rows = [(r.doc_id, brute_print(r.text)) for r in df.select("doc_id", "text").collect()]
    root = brute_components(sorted({f for _, f in rows}), lambda a, b: (a ^ b).bit_count() <= 2)
    smallest = {}
    for d, f in rows:
        if d is not None:
            smallest[root[f]] = min(smallest.get(root[f], d), d)
    want = Counter((d, f"{f:016x}", smallest.get(root[f])) for d, f in rows)
    assert Counter(tuple(r) for r in near_duplicates(df).collect()) == want


def test_missing_and_repeated_ids_link_nothing(docs, given):
    for df in (docs, given):
        third = F.when(F.xxhash64("text") % 3 == 0, F.lit(None)).when(F.xxhash64("text") % 3 == 1, F.lit(5))
        assert_as_brute(df.withColumn("doc_id", F.when(third.isNotNull() | (F.xxhash64("text") % 3 == 0), third).otherwise(F.col("doc_id"))))


def test_pairs_near_each_other(spark):
    import random

    rng = random.Random(3)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(64)
        prints += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), n)) for n in (1, 2, 2, 3, 4)]
    prints = sorted(set(prints))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    df = spark.createDataFrame(signed, "owner long, fp long")
    want = Counter((i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2)
    for segments, chain in ((3, 2), (4, 3), (8, 4), (16, 7), (3, 3)):
        if (segments, chain) == (3, 3):
            continue  # the whole ring is what the check behind the join does
        assert Counter(tuple(r) for r in similar_pairs(df, 2, segments, chain).collect()) == want


def test_masks_keep_budgets():
    assert len(viable_masks(0, 2)) == 1 + 22
    assert viable_masks(3, 7, 2, 16) == [0]


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(300, x) for x in range(200, 230)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {i: 200 for i in [*range(201, 230), 300]}
    assert got == want


def test_empty_table(nothing):
    assert near_duplicates(nothing).count() == 0


def test_long_text():
    text = " ".join(f"w{i % 977}" for i in range(40000))
    assert fingerprint_of(text.encode()) == brute_print(text)
