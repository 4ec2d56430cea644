"""The codec against the library on given and made texts."""

import hashlib
import random

import pytest
import sentencepiece

from starlens.llm.catalog import op12_sentencepiece, piece_model_path
from starlens.llm.piece_codec import PieceCodec, decode_documents, digests, encode_documents
from tests.llm.conftest import text_rows


@pytest.fixture(scope="module")
def own():
    return PieceCodec(piece_model_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def made_texts(own, n=6000, seed=4):
    rng = random.Random(seed)
    pieces = list(own.order)
    odd = [*"\n\t\0▁é̀中的😀​", "<s>", "</s>", "<0x41>", "<unk>", " "]
    for _ in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            yield "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))
        elif kind == 1:
            yield "".join(rng.choice("abcdeinrst  ") for _ in range(rng.randrange(80)))
        elif kind == 2:
            yield " " * rng.randrange(70) + rng.choice(["", "a", "the", "7"]) + " " * rng.randrange(40) + rng.choice(["", "x"])
        else:
            yield "".join(rng.choice(odd + ["th", "e"]) for _ in range(rng.randrange(1, 20)))


def test_encodes_and_decodes_like_the_library(own, library):
    for text in made_texts(own):
        ids = own.encode(text)
        assert ids == library.encode(text), text
        assert own.decode(ids) == library.decode(ids), text


def test_decodes_any_ids_like_the_library(own, library):
    rng = random.Random(9)
    for _ in range(6000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 259, 28705, 0, 1, 2]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_each_prefix_has_one_last_token(own):
    """What the table rests on: of all pieces that end at a place exactly one may follow the token before it."""
    for text in made_texts(own, 300, 11):
        for stretch in own.stretches(own.normalise(text)):
            if all(stretch[i : i + 2] in own.pairs for i in range(len(stretch) - 1)):
                last = {0: None}
                for end in range(1, len(stretch) + 1):
                    fits = [
                        p for p in (stretch[start:end] for start in range(end))
                        if (p in own.order) and (end == len(p) or own.compatible(last[end - len(p)], p))
                    ]
                    if len(stretch) > 1:
                        assert len(fits) == 1, (stretch, end, fits)
                    last[end] = fits[0] if fits else stretch[end - 1]


def test_long_texts_without_blanks(own, library):
    rng = random.Random(2)
    for text in ("".join(rng.choice("abcdefghij") for _ in range(20000)), "中文" * 5000, " " * 5000, "a" * 9999):
        assert own.encode(text) == library.encode(text)


def test_forgetting_changes_nothing(own, library, monkeypatch):
    monkeypatch.setattr("starlens.llm.piece_codec.REMEMBERED", 3)
    for text in made_texts(own, 200, 5):
        assert own.encode(text) == library.encode(text)


def test_odd_rows_and_round_trip(spark, docs, nothing, library):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc, text in text_rows(docs):
        ids = library.encode(text)
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in digests(docs, piece_model_path()).collect())
    coded = encode_documents(docs, piece_model_path())
    back = decode_documents(coded, piece_model_path())
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(d), t) for d, t in text_rows(docs))
    assert digests(nothing, piece_model_path()).count() == 0


def test_query(spark, data, given, library):
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in op12_sentencepiece(spark, data).collect()}
    for doc, text in text_rows(given):
        assert got[doc] == (len(library.encode(text)), hashlib.sha256(library.decode(library.encode(text)).encode()).hexdigest())
