import re
from collections import Counter

import pytest

from starlens.llm.license_scan import BASE, TEMPLATES, compile_template, scan, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text):
    words = WORD.findall(lower(text))
    starts, labels = [], set()
    for label, phrase in BASE:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("table", ["docs", "given"])
def test_equals_brute_force(request, table):
    df = request.getfixturevalue(table)
    found = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan(df).collect())
    assert found == Counter((r.doc_id, *brute(r.text)) for r in df.select("doc_id", "text").collect())


def places(template, text):
    a = compile_template("t", template)
    w = words_of(text.encode())
    return [(i, a.longest(w, i)) for i in range(len(w)) if a.longest(w, i) > 0]


def test_markup():
    t = "a [[b [[c]]]] {{x y|z}} d {{1-2}} e"
    assert places(t, "A, z d q e") == [(0, 5)]
    assert places(t, "a b c x y d q r e tail") == [(0, 9)]
    assert places(t, "a c z d q e") == []  # c is optional within b only
    assert places(t, "a z d e") == []  # at least one free word
    assert places(t, "a z d q r s e") == []
    assert places("[[a]] b", "a b b") == [(0, 2), (1, 2), (2, 3)]


def test_bad_markup():
    for t in ("a [[b", "a ]] b", "[[a]]", "{{0-3}}"):
        with pytest.raises(ValueError):
            compile_template("t", t)


def test_labels_of_whole_texts(spark):
    mit = next(t for n, t in TEMPLATES if n == "mit-text")
    plain = re.sub(r"\[\[.*?\]\]", "", mit)
    rows = [
        (1, "Licensed under CC BY-NC 4.0.\nGnu general public license"),
        (2, plain), (3, plain.replace("sublicense", "sell")), (4, "mit license mit license"),
    ]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].base_labels == "cc-by,gpl" and {"cc-by-nc", "cc-notice"} <= set(got[1].labels.split(","))
    assert got[2].labels == "mit-text" and got[2].base_labels == "" and got[2].score > 0.99
    assert got[3].labels == ""
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].score) == (2, 0, 2, 1.0)


def test_empty_table(nothing):
    assert scan(nothing).count() == 0
