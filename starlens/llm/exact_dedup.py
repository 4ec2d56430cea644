"""Exact duplicates owned by terminal nodes of Patricia tries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import NO_ID, key_of, stage

#: Bytes of text that a trie may hold before its nodes are handed on and it starts anew.
TRIE_BYTES = 32 << 20

#: Bytes of text in one Arrow batch on its way out.
BATCH_BYTES = 4 << 20

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Node:
    """An edge label with what hangs below it; a terminal node has its owner and size."""

    __slots__ = ("label", "below", "entry")

    def __init__(self, label: bytes, entry=None):
        self.label = label
        self.below: dict[int, Node] = {}
        self.entry = entry


def shared_length(a: bytes, b: bytes, at: int) -> int:
    """Length of the common start of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A compressed radix trie over whole byte strings."""

    def __init__(self):
        self.root = Node(b"")
        self.held = 0

    def find(self, text: bytes) -> Node:
        """The terminal node of ``text``, made if it is not there."""
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                self.held += len(text) - at
                child = node.below[text[at]] = Node(text[at:])
                return child
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            n = shared_length(child.label, text, at)
            fork = Node(child.label[:n])
            child.label = child.label[n:]
            fork.below[child.label[0]] = child
            node.below[text[at]] = fork
            node, at = fork, at + n
        return node


def _local(keep_largest: bool, trie_bytes: int):
    """Tries of one task's rows: a row for each document and one with the text for each terminal node."""
    schema = pa.schema([
        ("is_text", pa.bool_()), ("task", pa.int32()), ("node", pa.int64()), ("key", pa.int64()),
        ("n", pa.int64()), ("length", pa.int64()), ("digest", pa.binary()), ("text", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better = max if keep_largest else min
        trie, texts, made = PatriciaTrie(), [], 0

        def handed_on():
            rows, size = [], 0
            for task, node_id, (key, n, digest, text) in texts:
                rows.append((True, task, node_id, key, n, len(text), digest, text))
                size += len(text)
                if size > BATCH_BYTES:
                    yield _batch(rows, schema)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, schema)

        for batch in batches:
            members = []
            for task, key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = text.translate(_LOWER)
                node = trie.find(text)
                if node.entry is None:
                    node.entry = (task, made, [key, 0, hashlib.sha256(text).digest(), text])
                    texts.append(node.entry)
                    made += 1
                _, node_id, entry = node.entry
                entry[0] = better(entry[0], key)
                entry[1] += 1
                members.append((False, task, node_id, key, None, None, None, None))
                if trie.held > trie_bytes:
                    yield from handed_on()
                    trie, texts = PatriciaTrie(), []
            yield _batch(members, schema)
        yield from handed_on()

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema
    )


def _owners(keep_largest: bool, trie_bytes: int):
    """Tries over the texts of all tasks.  Rows come sorted by length and digest, so a subtree's rows stand
    together and a full trie is emptied as soon as the next (length, digest) begins."""
    schema = pa.schema([
        ("task", pa.int32()), ("node", pa.int64()), ("keep", pa.int64()), ("size", pa.int64()), ("sha", pa.string())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        better = max if keep_largest else min
        trie, open_rows, now = PatriciaTrie(), [], None

        def closed():
            rows = [(task, node, e[0], e[1], e[2]) for task, node, e in open_rows]
            for i in range(0, len(rows), 10_000):
                yield _batch(rows[i : i + 10_000], schema)

        for batch in batches:
            for task, node_id, key, n, length, digest, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (length, digest) != now:
                    now = (length, digest)
                    if trie.held > trie_bytes:
                        yield from closed()
                        trie, open_rows = PatriciaTrie(), []
                node = trie.find(text)
                if node.entry is None:
                    node.entry = [key, 0, digest.hex()]
                node.entry[0] = better(node.entry[0], key)
                node.entry[1] += n
                open_rows.append((task, node_id, node.entry))
        yield from closed()

    return run


def exact_duplicates(docs: DataFrame, keep: str = "largest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when all bytes agree after lower-casing A-Z; null counts as
    empty.  Of equal texts the row with the largest (or smallest) doc_id is the
    owner.  Each task first inserts its rows into a local trie, so a text costs
    one row per task however often it comes; the distinct texts go to
    partitions by length and digest, where tries of whole strings find the
    owners.  A trie that holds ``trie_bytes`` is handed on and begun anew, at
    the border of a subtree in the second step.

    A null doc_id sorts below all others and comes back as null.  Rows that
    repeat a doc_id and text are one group, and each of them says ``kept`` if
    its id is the owner's.  An empty table gives an empty result; other columns
    are not read.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError("keep is largest or smallest")
    texts = docs.select(
        F.spark_partition_id().alias("task"), key_of().alias("key"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
    )
    local = stage(
        texts.mapInArrow(
            _local(keep == "largest", trie_bytes),
            "is_text boolean, task int, node long, key long, n long, length long, digest binary, text binary",
        )
    )
    owners = (
        local.where("is_text")
        .select("task", "node", "key", "n", "length", "digest", "text")
        .repartition("length", "digest")
        .sortWithinPartitions("length", "digest")
        .mapInArrow(_owners(keep == "largest", trie_bytes), "task int, node long, keep long, size long, sha string")
    )
    members = local.where("not is_text").select("task", "node", "key")
    none = F.lit(NO_ID)
    return members.join(owners, ["task", "node"]).select(
        F.when(F.col("key") != none, F.col("key")).alias("doc_id"),
        F.when(F.col("keep") != none, F.col("keep")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("key") == F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
