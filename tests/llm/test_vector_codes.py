"""Codes against a plain loop with Python integers, and the transform against sums."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from starlens.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string, key int"


def brute(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    size = max(1, -(-max(len(r[1]) for r in kept) // 16))
    vectors = [[math.floor(Fraction(x) * 256) for x in r[1]] + [0] * (16 * size - len(r[1])) for r in kept]
    parts = [[tuple(v[p * size : (p + 1) * size]) for p in range(16)] for v in vectors]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:64]
    books = [[parts[i][p] for i in order] for p in range(16)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(books[p]))

    for _ in range(2):
        for p in range(16):
            members = {}
            for own in parts:
                members.setdefault(near(p, own[p])[1], []).append(own[p])
            books[p] = [tuple(sum(c) // len(members[e]) for c in zip(*members[e])) if e in members else y for e, y in enumerate(books[p])]
    found = [[near(p, own[p]) for p in range(16)] for own in parts]
    errors = [sum(f[0] for f in own) for own in found]
    totals = {}
    for r, e in zip(kept, errors):
        totals[r[2]] = totals.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()
    fits = lambda n: n if n < 2**63 - 1 else None
    return sorted(
        str((r[0], "".join(f"{f[1]:02x}" for f in own), fits(e), fits(totals[r[2]]), digest)) for r, own, e in zip(kept, found, errors)
    )


def compressed(spark, rows):
    return sorted(str(tuple(r)) for r in V.compress(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def random_rows(n, width, seed=1, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, scale) for _ in range(width)], rng.choice([None, 1, 2]), "c", "e", 0) for i in range(n)]


@pytest.mark.parametrize("width", [16, 48, 80])
def test_against_plain_loop(spark, width):
    rows = random_rows(150, width, width)
    assert compressed(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = random_rows(40, 48) + [(100 + i, [0.5] * 48, 7, "c", "e", 0) for i in range(40)]  # ties
    rows += [
        (1, None, 1, "", "", 0), (2, [float("nan")] * 48, 1, "", "", 0), (3, [None] * 48, None, "", "", 0),
        (4, [float("inf")] + [0.0] * 47, 1, "", "", 0), (5, [], 1, "", "", 0), (6, [-0.001] * 20, None, "", "", 0),
        (None, [0.25] * 48, None, "", "", 0), (7, [0.25] * 48, 2, "", "", 0), (7, [0.25] * 48, 2, "", "", 0),
    ]
    assert compressed(spark, rows) == brute(rows)
    assert compressed(spark, rows[40:43]) == brute(rows[40:43])
    assert compressed(spark, [rows[-9]]) == compressed(spark, []) == []


def test_numbers_of_any_size(spark):
    for scale in (1e5, 1e12, 1e300):
        rows = random_rows(70, 16, 5, scale) + random_rows(5, 16, 6)
        assert compressed(spark, rows) == brute(rows)


def test_transform():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-999, 999, (20, 8))
    own = V.transformed(vectors)
    assert ((own**2).sum(1) == 8 * (vectors**2).sum(1)).all()
    signs = np.sign(V.transformed(np.eye(8, dtype=np.int64)))[V.sequency_order(8)]
    assert [(np.diff(r) != 0).sum() for r in signs] == list(range(8))


def test_early_elimination_keeps_the_nearest():
    rng = np.random.default_rng(7)
    for width in (1, 3, 4, 11):
        vectors, entries = rng.integers(-40, 40, (300, width)), rng.integers(-40, 40, (64, width))
        entries[9] = entries[5]
        apart = ((vectors[:, None] - entries[None]) ** 2).sum(2)
        index, least = V.nearest(vectors, entries)
        assert (index == apart.argmin(1)).all() and (least == apart.min(1)).all()
