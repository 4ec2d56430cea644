"""SentencePiece byte-pair encoding by a table of each prefix's last token, and decoding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import text_of

#: Stands for a blank in pieces.
BLANK = "▁"

#: Stretches and token pairs that a worker remembers before it forgets them all; about 200 bytes each.
REMEMBERED = 400_000

#: Longer stretches without a blank are not remembered whole.
SHORT = 48

_REPLACEMENT = "�"

#: Stands for begin and end ids, which have no text but part runs of bytes.
_CONTROL = "\ud800"


class PieceCodec:
    """Encodes and decodes with a byte-pair model file that has byte fallback.

    The encoding of a text ends, for each of its prefixes, in one token that no
    continuation changes as long as the prefix stands alone.  So a table of the
    last token of every prefix holds the whole encoding: the candidates for an
    entry are the pieces that end there, and the right one is that which may
    follow the last token of the prefix before it.  Two tokens may follow each
    other if merging their joined text gives these two again.

    Merges need two characters that stand side by side in some piece.  Texts
    are cut wherever no piece does so, and the stretches between are encoded by
    themselves.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=path)
        size = range(library.get_piece_size())
        pieces = [library.id_to_piece(i) for i in size]
        if any(library.is_unused(i) for i in size):
            raise ValueError("unused pieces are not supported")
        plain = [i for i in size if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        self.normalise = library.normalize
        self.id_of = {pieces[i]: i for i in plain}
        self.order = {pieces[i]: -library.get_score(i) for i in plain}
        self.byte_ids = {int(pieces[i][1:-1], 16): i for i in size if library.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        # A byte that is no character by itself is a lone surrogate, as in Python's "surrogateescape".
        self.surface = [_CONTROL] * len(pieces)
        for i in plain:
            self.surface[i] = pieces[i].replace(BLANK, " ")
        for byte, i in self.byte_ids.items():
            self.surface[i] = chr(byte if byte < 0x80 else 0xDC00 + byte)
        self.surface[library.unk_id()] = library.decode([library.unk_id()])
        self.plain = set(plain)
        self.decimal = [str(i) for i in size]
        self.prefix = self.normalise("x").startswith(BLANK)
        self.pairs = {p[i : i + 2] for p in self.order for i in range(len(p) - 1)}
        self.stretches = re.compile(self._stretch_pattern()).findall
        self.known: dict[str, list[int]] = {}
        # per piece, whether it may follow another one
        self.follow: dict[str, dict[str, bool]] = {p: {} for p in self.order if len(p) == 1 or self.merged(p) == [p]}
        self.followed = 0
        self.automaton = ahocorasick.Automaton()
        for piece, after in self.follow.items():
            self.automaton.add_word(piece, (piece, len(piece), after))
        self.automaton.make_automaton()

    def _stretch_pattern(self) -> str:
        """Cuts texts before blanks, and where the largest set of characters that pieces join begins or ends."""
        if any(pair[1] == BLANK != pair[0] for pair in self.pairs):
            return "(?s).+"
        joined: dict[str, set[str]] = {}
        for a, b in (pair for pair in self.pairs if BLANK not in pair):
            one, other = joined.setdefault(a, {a}), joined.setdefault(b, {b})
            if one is not other:
                small, large = sorted((one, other), key=len)
                large |= small
                joined.update(dict.fromkeys(small, large))
        letters = re.escape("".join(sorted(max(joined.values(), key=len, default={"x"}))))
        return f"{BLANK}*[{letters}]+|{BLANK}*[^{letters}{BLANK}]+|{BLANK}+"

    def merged(self, text: str) -> list[str]:
        """Tokens by the plain rule: merge the best pair, of equal ones the first, until none is left."""
        tokens = list(text)
        while len(tokens) > 1:
            best, at = None, 0
            for i in range(len(tokens) - 1):
                order = self.order.get(tokens[i] + tokens[i + 1])
                if order is not None and (best is None or order < best):
                    best, at = order, i
            if best is None:
                break
            tokens[at : at + 2] = [tokens[at] + tokens[at + 1]]
        return tokens

    def compatible(self, token: str, following: str) -> bool:
        after = self.follow[following]
        found = after.get(token)
        if found is None:
            if self.followed > REMEMBERED:
                for known in self.follow.values():
                    known.clear()
                self.followed = 0
            self.followed += 1
            found = after[token] = self.merged(token + following) == [token, following]
        return found

    def tokens(self, text: str) -> list[str]:
        """Tokens of a stretch by the table of last tokens, read backwards."""
        last: list[str | None] = [None] * len(text)
        for end, (piece, size, after) in self.automaton.iter(text):
            if last[end] is None:
                if size > end:
                    last[end] = piece
                else:
                    before = last[end - size]
                    if before is not None and (after[before] if before in after else self.compatible(before, piece)):
                        last[end] = piece
        out, end = [], len(text) - 1
        while end >= 0:
            piece = last[end]
            if piece is None:
                return self.merged(text)
            out.append(piece)
            end -= len(piece)
        out.reverse()
        return out

    def _ids(self, text: str) -> list[int]:
        """Ids of a stretch in which all neighbours meet in some piece."""
        found = self.known.get(text)
        if found is None:
            if text in self.id_of and text in self.follow:
                found = [self.id_of[text]]
            elif len(text) == 1:
                found = [self.byte_ids[b] for b in text.encode()]
            else:
                found = [self.id_of[t] for t in self.tokens(text)]
            self._remember(text, found)
        return found

    def _stretch(self, text: str) -> list[int]:
        """Ids of a stretch, cut wherever two neighbours never meet in a piece."""
        out, start, pairs = [], 0, self.pairs
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in pairs:
                out += self._ids(text[start:i])
                start = i
        out += self._ids(text[start:])
        if start:
            self._remember(text, out)
        return out

    def _remember(self, text: str, ids: list[int]) -> None:
        if len(text) <= SHORT:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            self.known[text] = ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        get, slow = self.known.get, self._stretch
        for stretch in self.stretches(self.normalise(text)):
            out += get(stretch) or slow(stretch)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; each byte that is no part of valid UTF-8 becomes U+FFFD."""
        text = "".join(map(self.surface.__getitem__, ids))
        if self.prefix and ids:
            # the blank before the first word, if a piece gives it and not a byte
            first = next((i for i in ids if self.surface[i] != _CONTROL), None)
            if first in self.plain and self.surface[first].startswith(" "):
                text = text.replace(" ", "", 1)
        return "".join(map(_with_bytes, text.split(_CONTROL))) if _CONTROL in text else _with_bytes(text)


def _with_bytes(text: str) -> str:
    """Runs of byte pieces as the characters that they spell."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        text = text.encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape")
    # what is no UTF-8 comes back as one surrogate a byte
    return re.sub("[\udc80-\udcff]", _REPLACEMENT, text)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One per worker process, kept from task to task."""
    if path not in _CODECS:
        _CODECS.clear()
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, without begin or end ids.

    Null text counts as empty and has no ids.  Rows are told apart by nothing:
    repeated rows and null ids come back as given, ties do not arise, other
    columns are not read and an empty table gives an empty result.  A long text
    takes memory for itself and its ids, no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = pa.array([own.encode(t.as_py()) for t in batch.column("text")], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = pa.array([own.decode(i.as_py() or []) for i in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded and decoded again in one pass.

    The digests are of the decimal ids with commas between, and of the decoded
    text.  Nulls and odd rows as in ``encode_documents``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column("text"):
                ids = own.encode(text.as_py())
                counts.append(len(ids))
                ids_digests.append(_sha256(",".join(map(own.decimal.__getitem__, ids))))
                text_digests.append(_sha256(own.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digests), pa.array(text_digests)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
