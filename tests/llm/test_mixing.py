from collections import Counter, defaultdict

import pytest

from starlens.llm.mixing import WEIGHTS, mix, mixed, sizes_of, taken, targets


def brute_targets(sizes, weights, total, most=2):
    capped, out = set(), [0.0] * len(sizes)
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        free = [i for i in range(len(sizes)) if i not in capped]
        weight = sum(weights[i] for i in free)
        out = [most * sizes[i] if i in capped else left * weights[i] / weight for i in range(len(sizes))]
        over = {i for i in free if out[i] > most * sizes[i]}
        if not over:
            return out
        capped |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 50, 3, 900], [0, 0, 5], [7], [5, 0, 1000, 20, 20, 20, 2]])
def test_targets(sizes):
    weights = [WEIGHTS[i % 3] for i in range(len(sizes))]
    total = 1.5 * sum(sizes)
    assert targets(sizes, weights, total) == pytest.approx(brute_targets(sizes, weights, total))


@pytest.mark.parametrize("table", ["docs", "given"])
def test_totals(request, table):
    df = request.getfixturevalue(table)
    rows = taken(df).collect()
    texts = Counter((r.doc_id, len((r.text or "").split())) for r in df.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.size) for r in rows) == texts
    source = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    sums, sizes, goal = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        sums[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r.size
        goal[source[r.doc_id]] = r.target
        assert r.source_size >= r.size
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets([sizes[s] for s in names], [WEIGHTS[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))
    for s, t in zip(names, want):
        assert goal[s] == pytest.approx(t, abs=1e-5)
        assert abs(sums[s] - t) <= 1
    assert Counter(map(tuple, rows)) == Counter(map(tuple, taken(df).collect()))


def test_pieces_fill_the_slots(given):
    sized = sizes_of(given)
    pieces, entries = mix(sized, block_words=256)
    found = pieces.collect()
    by_slot = Counter()
    for p in found:
        by_slot[p.slot] += p.words
    assert sum(by_slot.values()) == sum(e["words"] for e in entries)
    source = {(r.key, r.row): r.source for r in sized.collect()}
    no = {e["source"]: e for e in entries}
    slots = defaultdict(set)
    for p in found:
        slots[p.slot].add(source[(p.key, p.row)])
    assert all(len(s) == 1 for s in slots.values())
    order = [next(iter(slots[k])) for k in sorted(slots)]
    # every stretch of the schedule has about its sources' shares
    total = sum(e["words"] for e in entries)
    for start in range(0, len(order) - 200, 97):
        seen = Counter(order[start : start + 200])
        for s, e in no.items():
            assert abs(seen[s] - 200 * e["words"] / total) < 5


def test_mixed_documents(docs, given, nothing):
    for df in (docs, given):
        out = mixed(df)
        assert out.columns == df.columns
        got = Counter()
        for r in out.collect():
            got[r.doc_id] += len((r.text or "").split())
        want = Counter()
        for r in taken(df).collect():
            want[r.doc_id] += r.taken
        assert +got == +want
    assert mixed(nothing).count() == taken(nothing).count() == 0
