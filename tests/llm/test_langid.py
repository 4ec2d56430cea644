import zlib
from collections import Counter

import numpy as np

from starlens.llm.langid import cluster, counts_of, fit, held_out, identify, keep_identified, letters_of, predictions


def test_held_out_accuracy(given):
    rows = predictions(given).collect()
    truth = {r.doc_id: r.lang for r in given.select("doc_id", "lang").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) / len(tested) > 0.95
    assert not any(r.rejected for r in rows)


def test_odd_rows(docs):
    rows = predictions(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    by_id = {r.doc_id: r for r in rows}
    for i in (60, 61, 62, 63):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "und"}


def test_predictions_do_not_see_labels(spark, given):
    model = fit(given.where(~held_out()).select("doc_id", "text", "lang"))
    plain = {r.doc_id: (r.lang_pred, r.score) for r in identify(given, model).collect()}
    bare = identify(given.selectExpr("doc_id", "text"), model).collect()
    assert plain == {r.doc_id: (r.lang_pred, r.score) for r in bare}
    foreign = spark.createDataFrame([(1, "жщы фыва ячсмить"), (2, "漢字仮名交じり文")], "doc_id long, text string")
    assert all(r.rejected for r in identify(foreign, model).collect())


def test_keep_identified(docs, given, nothing):
    model = fit(given.select("doc_id", "text", "lang"))
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns
    good = Counter(r.doc_id for r in identify(docs, model).where("not rejected").collect())
    assert Counter(r.doc_id for r in kept.collect()) == good
    assert keep_identified(nothing, model).count() == 0


def test_nothing_to_learn(nothing, docs):
    assert predictions(nothing).count() == 0
    assert {r.lang_pred for r in identify(docs, fit(nothing.select("doc_id", "text", "lang"))).collect()} == {"und"}


def test_grams():
    assert letters_of("Ab, c1d!") == b" ab c d "
    assert letters_of("123") == letters_of(None) == b""
    a = b" ab "
    assert counts_of(a).sum() == 3 + 2


def test_cluster_finds_two_groups():
    v = np.array([[1, 0, 0], [0.99, 0.1, 0], [0, 1, 0], [0, 0.99, 0.1]], np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centres, near = cluster(v, 2, 5)
    assert len(centres) == 2 and (near > 0.99).all()
    assert cluster(v[:1], 3, 2)[0].shape == (1, 3)
