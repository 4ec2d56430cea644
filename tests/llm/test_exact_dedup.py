import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from starlens.llm.exact_dedup import PatriciaTrie, exact_duplicates


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("table", ["docs", "given"])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("trie_bytes", [1, 32 << 20])
def test_equals_brute_force(request, table, keep, trie_bytes):
    df = request.getfixturevalue(table)
    groups = defaultdict(list)
    for r in df.select("doc_id", "text").collect():
        groups[lower(r.text)].append(r.doc_id)
    want = Counter()
    none = -(2**63)
    for text, ids in groups.items():
        best = (max if keep == "largest" else min)(none if i is None else i for i in ids)
        best = None if best == none else best
        for i in ids:
            want[(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in exact_duplicates(df, keep, trie_bytes).collect()) == want


def test_trie():
    rng = random.Random(1)
    texts = {bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(400)}
    trie = PatriciaTrie()
    nodes = {t: trie.find(t) for t in texts}
    assert len(set(map(id, nodes.values()))) == len(texts)
    assert all(trie.find(t) is n for t, n in nodes.items())


def test_bad_keep(docs):
    with pytest.raises(ValueError):
        exact_duplicates(docs, "any")


def test_empty_table(nothing):
    assert exact_duplicates(nothing).count() == 0
