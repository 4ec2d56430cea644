"""Trees, proofs and folded roots against plain hashing."""

import hashlib
import random
import zlib

import pytest

from starlens.llm import merkle_manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, tree string, pos int, leaf string"


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf(doc, text, lang, source, n):
    return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text))


def climb(nodes, walkers):
    """The root; each walker [place, digest, siblings] climbs with its digest in the place of the node's."""
    while len(nodes) > 1:
        for w in walkers:
            first = w[0] // 8 * 8
            run, slot = nodes[first : first + 8], w[0] - first
            w[2] += run[:slot] + run[slot + 1 :]
            w[1] = sha([*run[:slot], w[1], *run[slot + 1 :]])
            w[0] //= 8
        nodes = [sha(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0]


def brute(rows):
    groups = {}
    for doc, text, lang, source, n, *_ in rows:
        changes = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        other = leaf(doc, lowered(text) if changes else text, lang, source, n)
        groups.setdefault(lang, []).append((doc is not None, doc or 0, leaf(doc, text, lang, source, n), other, doc))
    found, subroots = [], []
    for lang in sorted(groups, key=lambda l: (l is not None, (l or "").encode())):
        own = sorted(groups[lang], key=lambda g: g[:3])
        walkers = [[i, g[3], []] for i, g in enumerate(own)]
        subroot = climb([g[2] for g in own], walkers)
        for g, w in zip(own, walkers):
            w[0] = len(subroots)
            found.append((g[4], g[2], subroot, w))
        subroots.append(subroot)
    root = climb(subroots, [f[3] for f in found]) if subroots else None
    return sorted(str((d, l, s, root, sha(w[2]), w[1], w[1] == root)) for d, l, s, w in found)


def odd_rows(n, seed=1):
    rng = random.Random(seed)
    langs = [None, "", "t", "ü"] + ["en"] * 8
    return [
        (None if i % 3 == 0 else i % 50, rng.choice([None, "", "A b", "Ü X", str(i), "Long " * 900]), rng.choice(langs),
         rng.choice([None, "s"]), rng.choice([None, 3]), 1, "q", 2, "z")
        for i in range(n)
    ]


def verified(spark, rows, levels=M.LEVELS):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return sorted(str(tuple(r)) for r in M.verify(df, M.tampered_text(), levels).collect())


def test_hash_states():
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(21)]
    parents, before = M.parents_of(M.words_of(bytes.fromhex("".join(digests))))
    assert [M.bytes_of(p).hex() for p in parents] == [sha(digests[i : i + 8]) for i in range(0, 21, 8)]
    # a stored state goes on as if the left siblings had been read again
    nodes = M.words_of(bytes.fromhex("".join(digests)))
    for at in range(21):
        first = at // 8 * 8
        siblings = M.np.zeros((1, 8, 8), M.np.uint32)
        run = nodes[first : first + 8]
        siblings[0, : len(run)] = run
        siblings[0, : at - first] = 0  # those on the left are not needed
        other = hashlib.sha256(b"other").hexdigest()
        got = M.folded(M.words_of(bytes.fromhex(other)), before[at : at + 1], siblings, M.np.array([at - first]), M.np.array([len(run)]))
        assert M.bytes_of(got).hex() == sha([*digests[first:at], other, *digests[at + 1 : first + 8]])


@pytest.mark.parametrize("rows", [odd_rows(300), odd_rows(1), [r for r in odd_rows(60) if r[2] == "en"][:9], odd_rows(40) * 2])
def test_against_plain_hashing(spark, rows):
    assert verified(spark, rows) == brute(rows)


def test_many_rounds(spark):
    """With one level a round a small tree takes as many rounds as a huge one."""
    rows = odd_rows(200, 3)
    assert verified(spark, rows, 1) == brute(rows)


def test_empty_table(nothing):
    assert M.verify(nothing, M.tampered_text()).count() == 0


def test_untouched_rows_fold_to_the_root(docs):
    assert M.verify(docs).where("not verified").count() == 0
