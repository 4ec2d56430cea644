import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starlens.llm.fingerprints import fingerprint_documents, fingerprint_texts, next_ids, within_radius


def mix64(spark, pairs):
    """Spark's own hash of each word with the next one."""
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64("a", "b").alias("h"))
    return {(r.a, r.b): r.h % (1 << 64) for r in df.distinct().collect()}


def terms(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return list(zip(w, [*w[1:], None]))


def brute_print(text, hashes):
    votes, total = [0] * 64, 0
    for t in terms(text):
        weight = min(4, 1 + len(t[0]) // 4)
        total += weight
        for b in range(64):
            votes[b] += weight * (hashes[t] >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


@pytest.mark.parametrize("table", ["docs", "given"])
def test_equals_brute_force(request, spark, table):
    df = request.getfixturevalue(table)
    rows = [(-(2**63) if r.doc_id is None else r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    keys = sorted({k for k, _ in rows}, reverse=True)
    follows = dict(zip(keys, [*keys[1:], keys[0]]))
    smallest = {}
    for k, t in rows:
        smallest[k] = min(t.encode(), smallest.get(k, t.encode()))
    longest = {k: max(len(t) for j, t in rows if j == k) for k in keys}

    def edited(k, t):
        n = len(t) // 3
        # heads are compared as they are cut for the longest row that asks
        heads = [s[: longest[k] // 3] for j, s in rows if j == follows[k]]
        return t[: len(t) - n] + min(heads, key=lambda s: s.encode())[:n]

    texts = {t for _, t in rows} | {edited(k, t) for k, t in rows}
    hashes = mix64(spark, list({p for t in texts for p in terms(t)}))
    fp = {t: brute_print(t, hashes) for t in texts}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    first = {k: min((fp[t] for j, t in rows if j == k), key=signed) for k in keys}
    sizes = Counter(fp[t] for _, t in rows)
    near = {f: sum(n for g, n in sizes.items() if (f ^ g).bit_count() <= 2) - 1 for f in sizes}
    want = Counter()
    for k, t in rows:
        e = edited(k, t)
        like = lambda a, b: 1 - (a ^ b).bit_count() / 64
        want[(
            None if k == -(2**63) else k, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{fp[t]:016x}", f"{fp[e]:016x}",
            like(fp[t], fp[e]), like(fp[t], first[follows[k]]), near[fp[t]],
        )] += 1
    assert Counter(tuple(r) for r in fingerprint_documents(df).collect()) == want


def test_many_terms_do_not_overflow(spark):
    text = " ".join(f"averyveryverylongword{i % 3}" for i in range(30000))
    hashes = mix64(spark, list(set(terms(text))))
    got = fingerprint_texts(spark.createDataFrame([(1, text)], "k int, text string"), ["k"]).first().fp
    assert got % (1 << 64) == brute_print(text, hashes)


def test_radius(spark):
    import random

    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(20)}
    prints |= {p ^ sum(1 << b for b in rng.sample(range(64), n)) for p in list(prints) for n in (1, 2, 3)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for radius in (1, 2, 3):
        got = Counter((r.query % (1 << 64), r.found % (1 << 64)) for r in within_radius(df, df, radius).collect())
        want = Counter((a, b) for a in prints for b in prints if (a ^ b).bit_count() <= radius)
        assert got == want


def test_next_ids(spark):
    keys = [5, -3, 100, 2**60, 7]
    got = {r.key: r.next for r in next_ids(spark.createDataFrame([(k, 0) for k in keys], "key long, most long")).collect()}
    down = sorted(keys, reverse=True)
    assert got == dict(zip(down, [*down[1:], down[0]]))


def test_no_python_in_the_plan(docs):
    plan = fingerprint_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_empty_table(nothing):
    assert fingerprint_documents(nothing).count() == 0
