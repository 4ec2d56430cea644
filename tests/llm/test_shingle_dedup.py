import random
from itertools import combinations

import pytest

from starlens.llm.shingle_dedup import across, buckets_of, one_per_group, rarest_keys, shingles_of, words_of
from tests.llm.test_simhash_dedup import brute_components

SCHEMA = "doc_id long, text string, row string"


def shingles(text):
    words = words_of((text or "").encode())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, changes):
    words = list(words)
    for i in rng.sample(range(len(words)), changes):
        words[i] = f"new{rng.getrandbits(40)}"
    return words


def near_copies(seed=5):
    """Texts with copies of 1 to 6 changed words: similarities below and above 0.8; one chain of copies of copies."""
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        base = [f"w{rng.getrandbits(30)}" for _ in range(rng.randrange(60, 250))]
        texts += [base] + [edited(rng, base, n) for n in range(1, 7)]
    chain = [f"c{rng.getrandbits(30)}" for _ in range(200)]
    for _ in range(8):
        texts.append(chain)
        chain = edited(rng, chain, 3)
    texts += [["One", "two"], ["one", "TWO"], ["one", "two", "three"], [], []]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_stage_finds_all_near_copies(spark):
    texts = near_copies()
    sets = [shingles(t) for t in texts]
    pairs = [p for p in combinations(range(len(texts)), 2) if similarity(sets[p[0]], sets[p[1]]) >= 0.8]
    assert len(pairs) > 100
    linked = set(pairs)
    want = set(brute_components(range(len(texts)), lambda a, b: (a, b) in linked).values())
    df = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    kept = one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert all(r.text == texts[r.doc_id] for r in kept.collect())


def test_recall_at_the_threshold():
    """Share of pairs at 0.8 or a little above that meet in a bucket; 0.9999 is expected."""
    rng = random.Random(7)
    met = tried = 0
    while tried < 1000:
        base = [f"w{rng.getrandbits(30)}" for _ in range(300)]
        copy = edited(rng, base, 7)
        a, b = (shingles_of([w.encode() for w in t]) for t in (base, copy))
        if 0.8 <= similarity(set(a), set(b)) < 0.83:
            tried += 1
            met += bool(set(buckets_of(a)) & set(buckets_of(b)))
    assert met >= 0.995 * tried


@pytest.mark.parametrize("same_id", [None, 7])
def test_null_and_repeated_ids_link_nothing(spark, same_id):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.getrandbits(30)}" for _ in range(30)) for _ in range(30)]
    rows = [(same_id if i % 3 == 0 else 100 + i, t, "r") for i, t in enumerate(texts)]
    rows += [(same_id, texts[0], "r"), (500, texts[1].upper(), "r")]
    kept = one_per_group(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(r.text for r in kept) == sorted(texts)


def test_empty_table(nothing):
    assert one_per_group(nothing).count() == 0


def star(n=400, seed=12, changes=(1, 6), size=150):
    """Copies of one text with 1 to 6 changed words each; the text itself comes last, and some copies are not similar to it."""
    rng = random.Random(seed)
    base = [f"b{rng.getrandbits(30)}" for _ in range(size)]
    return [" ".join(edited(rng, base, rng.randint(*changes))) for _ in range(n)] + [" ".join(base)]


def test_star_whose_centre_comes_last(spark):
    rng = random.Random(5)
    texts = star()
    texts = [" ".join(edited(rng, t.split(), 1)) for t in texts[:60]] + texts  # copies of copies
    sets = [shingles(t) for t in texts]
    pairs = {p for p in combinations(range(len(texts)), 2) if similarity(sets[p[0]], sets[p[1]]) >= 0.8}
    outside = [i for i in range(len(texts) - 1) if similarity(sets[i], sets[-1]) < 0.8]
    assert len(outside) > 50 and any((i, j) in pairs for i in outside for j in range(i + 1, len(texts) - 1))
    want = set(brute_components(range(len(texts)), lambda a, b: (a, b) in pairs).values())
    df = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    assert sorted(r.doc_id for r in one_per_group(df).collect()) == sorted(want)


def test_rarest_shingles_lead_few_copies_together(spark):
    """The pairs looked at across components hold all similar ones, and grow far slower than the square of the copies."""
    found = {}
    for n in (100, 400):
        sets = [shingles_of([w.encode() for w in t.split()]) for t in star(n, changes=(4, 9))]
        nodes = spark.createDataFrame([(i, i) for i in range(n)], "node long, component long")
        lists = spark.createDataFrame([(i, s.view("int64").tolist()) for i, s in enumerate(sets)], "node long, shingles array<long>")
        got = {(r.a, r.b) for r in across(nodes, lists).collect()}
        want = {
            p for p in combinations(range(n), 2) if similarity(set(sets[p[0]].tolist()), set(sets[p[1]].tolist())) >= 0.8
        }
        assert want <= got
        found[n] = len(got)
    assert found[400] < 0.05 * 400 * 399 / 2


def test_similar_sets_share_a_key():
    rng = random.Random(8)
    for _ in range(2000):
        n = rng.choice([1, 2, 3, 5, 8, 20, 90, 400])
        a = set(rng.sample(range(10**6), n))
        b = set(rng.sample(sorted(a), n - rng.randint(0, n // 5))) | set(rng.sample(range(10**6), rng.randint(0, n // 5)))
        if similarity(a, b) >= 0.8:
            assert set(k[:3] for k in rarest_keys(sorted(a))) & set(k[:3] for k in rarest_keys(sorted(b)))
