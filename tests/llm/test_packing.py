import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given as given_text
from hypothesis import settings
from hypothesis import strategies as st

from starlens.llm.packing import WordIds, first_fit_decreasing, pack

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


HARD = [
    "", " ", "Don't we'll I'M", "ÅB J̌ ́x", "İstanbul ΣΑΣ straße", "a b c\x1cd\x85e", "x\ty\nz\x0bw\x0cq\rr",
    "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "日本語 テスト 🚀✨ a1b22", "'s 't '' ''s", " ‍ ﻿bom", "\x00 \x01", "e" * 3000,
]


def test_ids_by_words(whole, given, docs):
    ids = WordIds(PATH)
    texts = HARD + [r.text for r in given.select("text").collect()] + [r.text for r in docs.select("text").collect()]
    found = list(ids.encode_all(pa.array([t or "" for t in texts])))
    for text, got in zip(texts, found, strict=True):
        assert got.tolist() == whole(text), text
    part = [x.tolist() for x in ids.encode_all(pa.array([t or "" for t in texts]).slice(3, 2))]
    assert part == [whole(texts[3]), whole(texts[4])]


@settings(max_examples=300, deadline=None)
@given_text(st.text("aJhtwyIKÅéß'., !1٣<|>\u0301\u0308\u030a\u030c\u0331İΣσ\n\x1c\x85\u00a0\u2028🚀", max_size=40))
def test_ids_of_random_texts(text):
    t = tokenizers.Tokenizer.from_file(PATH) if not _WHOLE else _WHOLE[0]
    _WHOLE[:] = [t]
    ids = _BY_WORDS[0] if _BY_WORDS else WordIds(PATH)
    _BY_WORDS[:] = [ids]
    assert next(ids.encode_all(pa.array([text]))).tolist() == t.encode(text, add_special_tokens=False).ids


_WHOLE, _BY_WORDS = [], []


def brute_first_fit(sizes, length):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, used in enumerate(bins) if used + sizes[i] <= length), len(bins))
        if b == len(bins):
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += sizes[i]
    return [out[i] for i in range(len(sizes))]


def test_first_fit():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 100, 700):
        sizes = rng.integers(1, 101, n).tolist()
        assert first_fit_decreasing(sizes, 100) == brute_first_fit(sizes, 100)


@pytest.mark.parametrize("table", ["docs", "given"])
def test_round_trip(request, table, whole):
    df = request.getfixturevalue(table)
    rows = pack(df, PATH, length=512, group_pieces=50, with_ids=True).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 512
    got = Counter()
    for r in rows:
        for i, x in enumerate(r.ids):
            got[(r.doc_id, r.start + i, x, r.doc_tokens)] += 1
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = whole(r.text) + [2]
        for i, x in enumerate(ids):
            want[(r.doc_id, i, x, len(ids))] += 1
    assert got == want
    used = sum(r.length for r in rows)
    assert used / (512 * len(sequences)) > 0.9


def test_empty_table(nothing):
    assert pack(nothing, PATH).count() == 0
