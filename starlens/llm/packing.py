"""Token sequences of fixed length by first-fit decreasing in randomised groups."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import NO_ID, key_of, stage, text_of

LENGTH = 4096
END_ID = 2

#: Pieces of one group on average; groups are drawn by hash.
GROUP_PIECES = 4000

#: Words whose ids a worker remembers before it forgets them all; some 150 bytes each.
REMEMBERED = 800_000

#: Bytes of text that are turned into ids together.
TOGETHER = 24 << 20

# Special tokens are told by their case, and a mark behind an ASCII capital may join with its
# small letter only; texts with either are cut at blanks and nothing else.
_CASED = r"<\||[\x{300}-\x{36f}]"

# A full stop or comma between an ASCII letter or digit and a blank is a token of its own.
_STOP = r"([a-z0-9])([.,])([ \t\n\r\v\f])"


class WordIds:
    """Ids of whole texts, put together from remembered ids of their words.

    The tokenizer cuts at white space before anything else and ignores case, so
    a text's ids are those of its blank-separated words in lower case, in
    order.  Words are told apart in Arrow, so that Python looks at each
    different word of many texts once.  New words are encoded together, with a
    special token between them.
    """

    BORDER = "<|startoftext|>"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.border = self.tokenizer.token_to_id(self.BORDER)
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        plain = [] if self.border is None else [w for w in words if "<|" not in w]
        for i in range(0, len(plain), 2000):
            part = plain[i : i + 2000]
            ids = self._encode(f" {self.BORDER} ".join(part))
            start = 0
            for w in part[:-1]:
                end = ids.index(self.border, start)
                self.known[w] = _packed(ids[start:end])
                start = end + 1
            self.known[part[-1]] = _packed(ids[start:])
        for w in words:
            if w not in self.known:
                self.known[w] = _packed(self._encode(w))

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), _STOP, r"\1 \2\3")
        cased = pc.match_substring_regex(texts, _CASED)
        words = pc.ascii_split_whitespace(pc.if_else(cased, texts, cut) if pc.any(cased).as_py() else cut)
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        packed = list(map(self.known.get, different))
        if missing := [w for w, ids in zip(different, packed) if ids is None]:
            self.learn(missing)
            packed = list(map(self.known.__getitem__, different))
        ids = np.frombuffer(b"".join(packed), "<u4")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        starts = np.cumsum(sizes) - sizes
        place = coded.indices.to_numpy()
        bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
        for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = place[first:last]
            many = sizes[own]
            ends = np.cumsum(many)
            total = int(ends[-1]) if len(own) else 0
            yield ids[np.arange(total) + np.repeat(starts[own] - ends + many, many)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process, kept from task to task."""
    if path not in _WORD_IDS:
        _WORD_IDS.clear()
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in stretches of about ``TOGETHER`` bytes of text."""
    passed = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
    first = 0
    for last in [*(np.flatnonzero(np.diff(passed)) + 1).tolist(), batch.num_rows]:
        if last > first:
            yield batch.slice(first, last - first)
        first = last


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut every document's ids, with ``end_id`` behind them, into full sequences and one rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        end = end_id.to_bytes(4, "little")
        drawn = 0
        for batch in (part for b in batches for part in _parts(b)):
            columns: list[list] = [[] for _ in range(7 if with_ids else 6)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of.encode_all(batch.column(1)), strict=True):
                own = ids.tobytes() + end
                total = len(own) // 4
                for start in range(0, total, length):
                    part = own[4 * start : 4 * (start + length)]
                    drawn += 1
                    row = [doc_id, start, len(part) // 4, zlib.crc32(part), total, drawn]
                    if with_ids:
                        row.append(memoryview(part).cast("I").tolist())
                    for column, value in zip(columns, row):
                        column.append(value)
            kinds = [pa.int64()] * 6 + [pa.list_(pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names[: len(columns)])

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.make_valid_utf8(text_of()).alias("text"),
    )
    return texts.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


class Tournament:
    """Room left in the bins, as a tree in which each match is won by the larger room."""

    def __init__(self, bins: int, room: int):
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.room = [0] * (2 * self.width)
        self.room[self.width : self.width + bins] = [room] * bins
        for i in range(self.width - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def put(self, size: int) -> int:
        """The first bin with room for ``size``; its room shrinks."""
        room, i = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while i < self.width:
            i = 2 * i if room[2 * i] >= size else 2 * i + 1
        found = i - self.width
        room[i] -= size
        while i > 1:
            i //= 2
            room[i] = max(room[2 * i], room[2 * i + 1])
        return found


def first_fit_decreasing(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) of each size, largest first; ties in the order given."""
    tree = Tournament(max(1, len(sizes)), length)
    filled = [0] * max(1, len(sizes))
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = tree.put(sizes[i])
        out[i] = (b, filled[b])
        filled[b] += sizes[i]
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Pieces are drawn into groups by a hash of their document, place and row,
    and each group is packed by itself: the number of groups grows with the
    pieces, so a task sees about ``group_pieces`` of them.  A document longer
    than a sequence fills whole ones and only its rest shares one.  Null text
    counts as empty and gives the one piece of ``end_id``; a null doc_id stays
    null; repeated rows are packed as often as given; an empty table gives an
    empty result; other columns are not read.
    """
    cut = stage(pieces(docs, tokenizer, length, end_id, with_ids))
    groups = max(1, -(-cut.count() // group_pieces))
    # in pandas a column of longs must not have nulls
    drawn = cut.withColumn("doc_id", key_of()).withColumn(
        "group", F.pmod(F.xxhash64("doc_id", "start", "draw"), F.lit(groups))
    )

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "draw"], ascending=[False, True, True, True])
        places = first_fit_decreasing(frame["length"].tolist(), length)
        frame["sequence_id"] = frame["group"] * (1 << 32) + [b for b, _ in places]
        frame["offset"] = [o for _, o in places]
        return frame[names]

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = drawn.groupBy("group").applyInPandas(run, schema + (", ids array<int>" if with_ids else ""))
    return packed.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NO_ID), F.col("doc_id")))
