"""Terms counted in batches against plain counting, with documents of several rows and slices that cut them."""

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starlens.operators import counting
from starlens.operators import features as FE
from starlens.operators import vectorise
from starlens.params import Params

KINDS = [("char", 3, 5), ("char", 2, 6), ("char", 4, 5), ("word", 1, 2), ("word", 2, 3)]


def pieces(word, low, high):
    padded = f" {word} "
    return [
        padded[i : i + n]
        for n in range(low, high + 1) if n == low or n <= len(padded) for i in range(max(len(padded) - n + 1, 1))
    ]


def grams(kind, words, low, high):
    if kind == "char":
        return [p for w in words for p in pieces(w, low, high)]
    return [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]


def drawn(rng):
    """(document, first row of it, words) of some documents; words may hold blanks."""
    out = []
    for d in range(rng.integers(1, 12)):
        for i in range(rng.integers(1, 4)):
            words = rng.choice(["a", "ab", "กขค", "abcdef", " ", "a b"], rng.integers(0, 6)).tolist()
            out.append((d, i == 0, words if rng.random() > 0.1 else None))
    return out


def batches(rows, rng):
    while rows:
        part, rows = rows[: (n := rng.integers(1, 6))], rows[n:]
        columns = [
            pa.array([r[0] for r in part]), pa.array([r[0] % 2 for r in part], pa.int32()), pa.array([r[1] for r in part]),
            pa.array([r[2] for r in part], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["id", "_group", "_first", "_words"])


@pytest.mark.parametrize("most", [1 << 20, 5])
@pytest.mark.parametrize(("kind", "low", "high"), KINDS)
def test_batches_give_plain_counts(monkeypatch, kind, low, high, most):
    monkeypatch.setattr(counting, "WORDS", 7)
    monkeypatch.setattr(counting, "TERMS", most)
    monkeypatch.setattr(counting, "KEPT", most)
    rng = np.random.default_rng(3)
    for _ in range(25):
        rows, want = drawn(rng), defaultdict(Counter)
        for d, _, words in rows:
            want[d].update(grams(kind, words or [], low, high))
        got = [r for b in counting.counts(["id"], kind, low, high)(batches(rows, rng)) for r in b.to_pylist()]
        assert len(got) == len({r["id"] for r in got}) and all(len(r["_terms"]) == len({x["term"] for x in r["_terms"]}) for r in got)
        assert {r["id"]: {x["term"]: x["tf"] for x in r["_terms"]} for r in got} == {d: dict(c) for d, c in want.items() if c}
        found, plain = Counter(), Counter()
        for b in counting.totals(kind, low, high, 2)(batches(rows, rng)):
            for r in b.to_pylist():
                found.update({(r["group"], r["term"], "df"): r["df"], (r["group"], r["term"], "ctf"): r["ctf"]})
        for d, c in want.items():
            for term, n in c.items():
                plain.update({(d % 2, term, "df"): 1, (d % 2, term, "ctf"): n})
        assert found == plain


def test_known_grams_are_counted(monkeypatch):
    monkeypatch.setattr(counting, "WORDS", 3)
    known = ["a", " a ", " ab", "กข", "abc", " abcd", "zzz", "bcdef", " a b", "cdef "]
    lists = [["a", "ab", "abcdef", "กขค", "a b"], [], None, ["abcdef", "abcdef", "x"]]
    for low, high in ((3, 5), (2, 6), (4, 5)):
        made = list(counting.known_grams(known, low, high)(iter([pa.array(lists, pa.list_(pa.string()))])))
        for row, words in zip(made[0].to_pylist(), lists):
            want = Counter(p for w in words or [] for p in pieces(w, low, high) if p in known)
            assert dict(zip((known[i] for i in row["indices"]), row["values"])) == want and row["size"] == len(known)


ROWS = [(1, "good food good"), (2, "bad food"), (2, "food again good"), (None, "good place"), (None, "place good place"), (3, ""), (4, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return vectorise.by_document(spark.createDataFrame(ROWS, "review_id long, text string").repartition(3))


@pytest.mark.parametrize("terms", [vectorise.word_terms, vectorise.char_terms])
def test_nested_terms_are_the_exploded_ones(docs, terms):
    nested = vectorise.term_counts(terms(docs, nested=True))
    assert "Aggregate" not in nested._jdf.queryExecution().executedPlan().toString()
    exploded = nested.select("review_id", F.explode("_terms").alias("t")).select("review_id", "t.*")
    plain = vectorise.term_counts(terms(docs))
    assert sorted(map(str, exploded.collect())) == sorted(map(str, plain.select("review_id", "term", "tf").collect()))
    vocabulary = vectorise.fit_vocabulary(terms(docs), F.lit(5), 20)
    got, want = (
        {(r["review_id"], r["term"]): r["weight"] for r in vectorise.weigh(made, vocabulary).collect()}
        for made in (terms(docs, nested=True), terms(docs))
    )
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_transforms_are_those_of_the_fitted_stages(spark):
    texts = ["good food here", "Bad food  here", "อร่อย ดี มาก", "ดี มาก here", "", "a b c food", "x"]
    rows = spark.createDataFrame([(i, x, i % 5 + 1) for i, x in enumerate(texts)], "review_id long, text string, user_rating int")
    params = Params(word_max_features=50, char_max_features=20, word_min_df=1, use_extra_features=True)
    made = FE.fit_features(rows, params)
    got = made.transform(rows)
    assert "char_grams" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {r["review_id"]: r["features"] for r in made.stages.transform(FE.analyse(rows, params)).collect()}
    assert {r["review_id"]: r["features"] for r in got.collect()} == want
