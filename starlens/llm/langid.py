"""Languages by the nearest of several centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import hash_fraction

#: Length of the hashed n-gram vectors, in bits.
SIZE_BITS = 12
SIZE = 1 << SIZE_BITS

#: Bytes in an n-gram, over words with a blank around them.
GRAMS = (2, 3)

#: Labelled rows of one language that its centroids are fitted on (about; drawn by hash).
FIT_ROWS = 1500

#: Centroids of one language, and rounds of moving them.
CENTROIDS = 3
ROUNDS = 8

#: Languages that a model may have.
MAX_LANGUAGES = 500

#: A text is rejected when its best cosine is below this share of what the least typical
#: 1 % of its language's fitted rows reach.
REJECT_SHARE = 0.1

UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_BLANKS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def letters_of(text: str | None) -> bytes:
    """Lower-case words with one blank around each; empty without a letter."""
    if not text or not _LETTER.search(text):
        return b""
    words = text.lower().encode("utf-8", "replace").translate(_BLANKS).split()
    return b" %b " % b" ".join(words)


def counts_of(letters: bytes) -> np.ndarray:
    """Hashed n-gram counts."""
    a = np.frombuffer(letters, np.uint8).astype(np.uint32)
    found = np.zeros(SIZE, np.float32)
    for n in GRAMS:
        if len(a) < n:
            continue
        code = np.full(len(a) - n + 1, n, np.uint32)
        for i in range(n):
            code = code * np.uint32(257) + a[i : len(a) - n + 1 + i]
        slots = (code * np.uint32(2654435761)) >> np.uint32(32 - SIZE_BITS)
        found += np.bincount(slots, minlength=SIZE)
    return found


def vector_of(letters: bytes, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts by document rarity, of length 1."""
    v = np.log1p(counts_of(letters)) * idf
    norm = float(np.sqrt(v @ v))
    return v / norm if norm else v


@dataclass(frozen=True)
class LanguageModel:
    """A row of ``centroids`` per cluster, its language in ``names`` and its least cosine in ``floors``."""

    names: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    floors: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine, rejected); without a letter the language is unknown and rejected."""
        letters = letters_of(text)
        if not letters or not self.names:
            return UNKNOWN, 0.0, True
        near = self.centroids @ vector_of(letters, self.idf)
        best = int(near.argmax())
        score = float(min(1.0, max(0.0, near[best])))
        return self.names[best], score, score < self.floors[best]


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of ``docs`` and, for each slot, how many of them have an n-gram there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found = 0, np.zeros(SIZE, np.int64)
        for batch in batches:
            for text in batch.column(0):
                rows += 1
                found += counts_of(letters_of(text.as_py())) > 0
        slots = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(slots, -1)), pa.array(np.append(found[slots], rows))], ["slot", "n"]
        )

    sums = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out, rows = np.zeros(SIZE, np.int64), 0
    for r in sums:  # SIZE + 1 rows at most
        if r.slot < 0:
            rows = r.n
        else:
            out[r.slot] = r.n
    return rows, out


def cluster(vectors: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1 by cosine, and each row's cosine to its nearest one.

    The first is the mean; each further one starts at the row farthest from those before.
    """
    centres = _unit(vectors.mean(0, keepdims=True))
    while len(centres) < min(k, len(vectors)):
        near = (vectors @ centres.T).max(1)
        centres = np.vstack([centres, vectors[int(near.argmin())][None]])
    for _ in range(rounds):
        owner = (vectors @ centres.T).argmax(1)
        centres = np.vstack([
            _unit(vectors[owner == i].mean(0, keepdims=True)) if (owner == i).any() else centres[i : i + 1]
            for i in range(len(centres))
        ])
    return centres, (vectors @ centres.T).max(1)


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, k: int = CENTROIDS, rounds: int = ROUNDS) -> LanguageModel:
    """Learn from (doc_id, text, lang); rows without a text, a letter or a lang teach nothing.

    Document frequencies count all rows.  Each language's centroids come from
    about ``fit_rows`` of its rows, drawn by a hash of doc_id and text without
    repeats, clustered by one task per language.
    """
    labelled = labelled.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows, frequencies = document_frequencies(labelled)
    idf = np.log((1 + rows) / (1 + frequencies)).astype(np.float32) + np.float32(0.05)
    if not sizes:
        return LanguageModel((), idf, np.zeros((0, SIZE), np.float32), np.zeros(0))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(fit_rows / r["count"]))])
    drawn = labelled.where(hash_fraction("doc_id", "text", F.lit("langid")) < share[F.col("lang")])

    def run(group: pa.Table) -> pa.Table:
        found = sorted(zip(*(group.column(c).to_pylist() for c in ("doc_id", "text", "lang"))), key=lambda r: (r[0] is None, r[:2]))
        kept = [x for x in (letters_of(text) for _, text, _ in found) if x]
        if not kept:
            return learned_type.empty_table()
        centres, near = cluster(np.stack([vector_of(x, idf) for x in kept]).astype(np.float32), k, rounds)
        floor = float(np.quantile(near, 0.01)) * REJECT_SHARE
        columns = [[found[0][2]] * len(centres), [floor] * len(centres), [c.tolist() for c in centres]]
        return pa.table(columns, schema=learned_type)

    learned_type = pa.schema([("lang", pa.string()), ("floor", pa.float64()), ("centroid", pa.list_(pa.float32()))])
    learned = (
        drawn.select("doc_id", "text", "lang").distinct()
        .groupBy("lang")
        .applyInArrow(run, "lang string, floor double, centroid array<float>")
        .collect()  # languages x centroids rows
    )
    learned.sort(key=lambda r: (r["lang"], r["centroid"]))
    return LanguageModel(
        tuple(r["lang"] for r in learned),
        idf,
        np.array([r["centroid"] for r in learned], np.float32).reshape(-1, SIZE),
        np.array([r["floor"] for r in learned]),
    )


def held_out() -> Column:
    """Whether a document is not to be learned from: crc32 of its id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs``.

    The prediction reads nothing but the whole text.  Null texts and texts
    without a letter are ``und`` with score 0.  ``rejected`` says that the text
    is farther from every centroid than the model allows; ``lang_pred`` still
    names the nearest.  Repeated rows come back as often as given; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(1)]
            names, scores, rejected = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, rejected boolean"
    )


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, all columns as they are."""

    @F.arrow_udf("boolean")
    def rejected(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([model.predict(t.as_py())[2] for t in texts], pa.bool_())

    return docs.where(~rejected("text"))


def predictions(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learned on the rows that are not held out."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"), **settings)
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
