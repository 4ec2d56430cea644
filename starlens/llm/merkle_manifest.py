"""A Merkle tree of a dataset whose parents keep the hash state before each child, for cheap folding."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.llm.common import key_of, stage

ARITY = 8

#: Levels that one task builds or folds at once, for stretches of ARITY ** LEVELS nodes.
LEVELS = 4

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Names the tree over the subroots; a group's tree is called "l" + its value, or "" for null.
TOP = "t"

# A digest as hex text has 64 bytes, one block of SHA-256.  So the state before a child slot is the
# eight words of the chaining value, nothing more, and can be stored.


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _root_bits(n: int, power: int) -> int:
    """The first 32 bits behind the point of the square or cube root of n."""
    scaled = n << (32 * power)
    root = math.isqrt(scaled) if power == 2 else round(scaled ** (1 / 3))
    while root**power > scaled:
        root -= 1
    while (root + 1) ** power <= scaled:
        root += 1
    return root & 0xFFFFFFFF


_START = np.array([_root_bits(p, 2) for p in _primes(8)], np.uint32)
_ROUND = np.array([_root_bits(p, 3) for p in _primes(64)], np.uint32)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compressed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """SHA-256 chaining values (n, 8) after one more block of words (n, 16) each."""
    w = [block[:, i] for i in range(16)]
    for i in range(16, 64):
        x, y = w[i - 15], w[i - 2]
        low = _turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))
        high = _turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))
        w.append(w[i - 16] + low + w[i - 7] + high)
    a, b, c, d, e, f, g, h = (state[:, i] for i in range(8))
    for i in range(64):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + (w[i] + _ROUND[i])
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def finished(state: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Digests from the states after all of ``children`` hex digests: one block of padding and length."""
    end = np.zeros((len(state), 16), np.uint32)
    end[:, 0] = 1 << 31
    end[:, 15] = children * 512
    return compressed(state, end)


_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def hex_words(digests: np.ndarray) -> np.ndarray:
    """(n, 16) words of the hex text of digests (n, 8)."""
    raw = digests.astype(">u4").view(np.uint8).reshape(-1, 32)
    text = np.empty((len(raw), 64), np.uint8)
    text[:, ::2], text[:, 1::2] = _HEX[raw >> 4], _HEX[raw & 15]
    return text.view(">u4").astype(np.uint32)


def words_of(raw: bytes) -> np.ndarray:
    """(n, 8) words of digests or states that stand one after the other."""
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8)


def bytes_of(words: np.ndarray) -> bytes:
    return words.astype(">u4").tobytes()


def parents_of(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the parents of consecutive nodes (n, 8), and the state before each node's slot (n, 8)."""
    n = len(digests)
    count = -(-n // ARITY)
    blocks = hex_words(digests)
    before = np.empty((n, 8), np.uint32)
    state = np.tile(_START, (count, 1))
    for slot in range(ARITY):
        at = np.arange(slot, n, ARITY)
        before[at] = state[: len(at)]
        state[: len(at)] = compressed(state[: len(at)], blocks[at])
    sizes = np.minimum(ARITY, n - ARITY * np.arange(count))
    return finished(state, sizes), before


def folded(replaced: np.ndarray, before: np.ndarray, siblings: np.ndarray, slots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of parents whose child at ``slots`` is replaced.

    The state ``before`` the slot goes on with the replacement and then with
    the ``siblings`` (n, ARITY, 8) right of it; those left of it are not read.
    """
    state, own = before.copy(), hex_words(replaced)
    for slot in range(ARITY):
        at = np.flatnonzero((slots <= slot) & (slot < sizes))
        if len(at):
            block = np.where((slots[at] == slot)[:, None], own[at], hex_words(siblings[at, slot]))
            state[at] = compressed(state[at], block)
    return finished(state, sizes)


def height(nodes: int) -> int:
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // ARITY), levels + 1
    return levels


PARENT = "tree string, base int, stretch long, level int, parent long, digest binary, children binary, states binary"


def _built(key: tuple, table: pa.Table, most: int) -> pa.Table:
    """The parents above a stretch of nodes: as many levels as its tree still has, at ``most`` so many."""
    tree, base, stretch = (k.as_py() for k in key)
    table = table.sort_by("pos")
    nodes = words_of(b"".join(table.column("digest").to_pylist()))
    levels = min(most, height(table.column("n")[0].as_py()))
    first = table.column("pos")[0].as_py()
    rows: list[list] = [[] for _ in range(8)]
    for level in range(1, levels + 1):
        digests, before = parents_of(nodes)
        first //= ARITY
        for i, digest in enumerate(digests):
            own = slice(i * ARITY, (i + 1) * ARITY)
            values = (
                tree, base, stretch, base + level, first + i, bytes_of(digest), bytes_of(nodes[own]), bytes_of(before[own])
            )
            for column, value in zip(rows, values):
                column.append(value)
        nodes = digests
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    names = [field.split()[0] for field in PARENT.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(rows, types)], names=names)


def grow(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Parents of all trees of nodes (tree, pos, digest, n), and (tree, digest) of their roots.

    ``pos`` counts a tree's nodes without gaps, ``n`` is their number.  Every
    task builds the lowest ``levels`` above a stretch of nodes; the digests on
    top are the nodes of the next round, until each tree has one.
    """
    width = ARITY**levels

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return _built(key, table, levels)

    parts, roots, base = [], [], 0
    while True:
        roots.append(nodes.where("n = 1").select("tree", "digest"))
        growing = nodes.where("n > 1")
        if growing.isEmpty():
            break
        made = stage(
            growing.select("*", F.lit(base).alias("base"), F.floor(F.col("pos") / width).alias("stretch"))
            .groupBy("tree", "base", "stretch").applyInArrow(run, PARENT)
        )
        parts.append(made)
        sizes = growing.groupBy("tree").agg(F.max("n").alias("n"))
        # a tree whose stretch reached its root before the last level ends there
        tops = made.join(made.groupBy("tree").agg(F.max("level").alias("level")), ["tree", "level"])
        nodes = stage(
            tops.join(sizes, "tree").select(
                "tree", F.col("parent").alias("pos"), "digest", F.ceil(F.col("n") / width).alias("n")
            )
        )
        base += levels
    return (_all(parts) if parts else None), _all(roots)


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def field_text(name: str) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> Column:
    """SHA-256 of a row's fields as hex text; ``changed`` gives other contents of some fields."""
    return F.sha2(F.concat(*[(changed or {}).get(f, field_text(f)) for f in fields]), 256)


def ordered_leaves(leaves: DataFrame) -> DataFrame:
    """Add ``pos`` (place in its tree) and ``n`` (leaves of the tree) to leaves (tree, key, leaf, ...), stored.

    Rows are sorted across tasks by tree, key and leaf, so a tree with most of
    the rows, or a key that most rows share, is spread like any other.
    """
    placed = (
        leaves.repartitionByRange("tree", "key", "leaf").sortWithinPartitions("tree", "key", "leaf")
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = stage(placed)
    part, within = F.shiftrightunsigned("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per task of the sort
    tasks = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(tasks.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")))
    trees = stage(
        placed.groupBy("tree").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
        .join(starts, F.shiftrightunsigned("_first", 33) == F.col("_part"))
        .select("tree", "n", (F.col("_start") + F.col("_first").bitwiseAND(F.lit((1 << 33) - 1))).alias("_tree_start"))
    )
    return (
        placed.join(starts, part == F.col("_part")).join(trees, "tree")
        .withColumn("pos", F.col("_start") + within - F.col("_tree_start"))
        .drop("_place", "_part", "_start", "_tree_start")
    )


def tree_of(group: str = "lang") -> Column:
    """The name of a row's tree; names sort as null first, then by UTF-8 bytes."""
    value = F.col(group).cast("string")
    return F.coalesce(F.concat(F.lit("l"), value), F.lit(""))


def heights(parents: DataFrame, above: int) -> DataFrame:
    """(tree, top): the highest level of each tree with more than ``above`` levels."""
    return stage(parents.groupBy("tree").agg(F.max("level").alias("top")).where(F.col("top") > above))


def ancestors(nodes: DataFrame, parents: DataFrame, level: int) -> DataFrame:
    """Nodes (tree, node, top, ...) of a ``level`` joined with all parents above them, up to level ``top``."""
    above = parents.select("tree", "level", "parent", "digest", "children", "states")
    steps = (
        nodes.where(F.col("top") > level)
        .withColumn("level", F.explode(F.sequence(F.lit(level + 1), F.col("top"))))
        .withColumn("parent", F.floor(F.col("node") / F.pow(F.lit(ARITY), F.col("level") - level)))
        .drop("node", "top")
    )
    return steps.join(above, ["tree", "level", "parent"])


def _steps(table: pa.Table) -> list[tuple[int, list[int], list[bytes], list[bytes], list[bytes]]]:
    """Per level, upwards: (level, parents, digests, children, states), parents ascending."""
    table = table.sort_by([("level", "ascending"), ("parent", "ascending")])
    out = []
    columns = [table.column(c).to_pylist() for c in ("level", "parent", "digest", "children", "states")]
    for level, *rest in zip(*columns):
        if not out or out[-1][0] != level:
            out.append((level, [], [], [], []))
        for into, value in zip(out[-1][1:], rest):
            into.append(value)
    return out


FOLDED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _climb(pos: np.ndarray, digest: np.ndarray, proofs: list[list[bytes]], steps) -> tuple[np.ndarray, np.ndarray]:
    """Fold every row's digest through all levels; adds its siblings' hex text to ``proofs``."""
    for _, parents, _, children, states in steps:
        pos, slots = pos // ARITY, pos % ARITY
        at = pos - parents[0]
        sizes = np.fromiter((len(c) // 32 for c in children), np.int64, len(children))
        nodes = np.zeros((len(children), ARITY, 8), np.uint32)
        before = np.zeros((len(children), ARITY, 8), np.uint32)
        for i, (c, s) in enumerate(zip(children, states)):
            nodes[i, : sizes[i]], before[i, : sizes[i]] = words_of(c), words_of(s)
        digest = folded(digest, before[at, slots], nodes[at], slots, sizes[at])
        texts = [c.hex().encode() for c in children]
        for proof, i, slot in zip(proofs, at.tolist(), slots.tolist()):
            proof.append(texts[i][: 64 * slot])
            proof.append(texts[i][64 * slot + 64 :])
    return pos, digest


def _folds(key: tuple, rows: pa.Table, above: pa.Table) -> pa.Table:
    """The proofs and folded roots of a stretch of leaves, from the parents above it in its tree and in the top tree."""
    n = rows.num_rows
    pos = rows.column("pos").to_numpy()
    leaf = words_of(b"".join(rows.column("leaf").to_pylist()))
    digest = words_of(b"".join(rows.column("replaced").to_pylist()))
    proofs: list[list[bytes]] = [[] for _ in range(n)]
    top = pc.equal(above.column("tree"), TOP)
    own_steps = _steps(above.filter(pc.invert(top)))
    top_steps = _steps(above.filter(top))
    _, digest = _climb(pos, digest, proofs, own_steps)
    subroot = [own_steps[-1][2][0].hex()] * n if own_steps else [bytes_of(d).hex() for d in leaf]
    root = subroot
    if top_steps:
        place = np.full(n, rows.column("tree_pos")[0].as_py() if n else 0, np.int64)
        _, digest = _climb(place, digest, proofs, top_steps)
        root = [top_steps[-1][2][0].hex()] * n
    result = [bytes_of(d).hex() for d in digest]
    return pa.table(
        [
            rows.column("doc_id"), pa.array([bytes_of(d).hex() for d in leaf], pa.string()), pa.array(subroot, pa.string()),
            pa.array(root, pa.string()), pa.array([hashlib.sha256(b"".join(p)).hexdigest() for p in proofs], pa.string()),
            pa.array(result, pa.string()), pa.array([a == b for a, b in zip(result, root)], pa.bool_()),
        ],
        names=[field.split()[0] for field in FOLDED.split(", ")],
    )


def manifest(
    docs: DataFrame, replaced: dict[str, Column] | None = None, group: str = "lang", levels: int = LEVELS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leaves, parents, trees) of a table with the columns FIELDS.

    ``parents`` is the manifest: per tree, level and place the parent's digest,
    its children's digests and the hash states before each child slot.
    ``trees`` has the place of each tree's root in the tree TOP.  ``leaves``
    carries each row's digest and, in ``replaced``, that of its changed fields.
    """
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key_of().alias("key"), tree_of(group).alias("tree"),
        F.unhex(leaf_of()).alias("leaf"), F.unhex(leaf_of(changed=replaced)).alias("replaced"),
    )
    placed = stage(ordered_leaves(leaves))
    parents, roots = grow(placed.select("tree", "pos", F.col("leaf").alias("digest"), "n"), levels)
    subroots = stage(
        ordered_leaves(roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("key"), F.col("digest").alias("leaf")))
    )
    top, _ = grow(subroots.select("tree", "pos", F.col("leaf").alias("digest"), "n"), levels)
    found = [p for p in (parents, top) if p is not None]
    empty = docs.sparkSession.createDataFrame([], PARENT)
    return placed, _all(found) if found else empty, subroots.select(F.col("key").alias("tree"), F.col("pos").alias("tree_pos"))


def prove(leaves: DataFrame, parents: DataFrame, trees: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per leaf: its proof, and the root that its replacement folds to."""
    rows = leaves.join(trees, "tree").withColumn("stretch", F.floor(F.col("pos") / ARITY**levels))
    stretches = rows.select(F.col("tree").alias("own"), "tree_pos", "stretch").distinct()
    inside = parents.where((F.col("tree") != TOP) & (F.col("base") == 0)).withColumn("own", F.col("tree"))
    high = parents.where((F.col("tree") != TOP) & (F.col("base") > 0))
    over = ancestors(
        stretches.select(F.col("own").alias("tree"), "own", "stretch", F.col("stretch").alias("node"))
        .join(heights(high, levels), "tree"),
        high, levels,
    )
    # the roots of the groups' trees are the leaves of the top tree
    top = ancestors(
        stretches.select(
            F.lit(TOP).alias("tree"), "own", "stretch", F.col("tree_pos").alias("node"), F.lit(height(trees.count())).alias("top")
        ),
        parents.where(F.col("tree") == TOP), 0,
    )
    columns = ["own", "stretch", "tree", "level", "parent", "digest", "children", "states"]
    above = _all([t.select(columns) for t in (inside, over, top)])
    return (
        rows.groupBy("tree", "stretch")
        .cogroup(above.groupBy("own", "stretch"))
        .applyInArrow(_folds, FOLDED)
    )


def verify(docs: DataFrame, replaced: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """The manifest of ``docs`` and, per row, whether its (replaced) contents fold to the root.

    Each row is a leaf.  Rows with the same ``lang`` (null is one, too) form a
    tree in the order of doc_id; nulls come first, ties stand in the order of
    their digests, and rows that repeat are leaves of their own.  Null fields
    have a sign of their own, so null and empty texts differ.  Very long texts
    are hashed inside the scan and never travel.  Other columns are not read;
    an empty table gives an empty result.
    """
    return prove(*manifest(docs, replaced, levels=levels), levels)


def tampered_text() -> dict[str, Column]:
    """Texts in lower case (A-Z only) where 3 divides the CRC-32 of the decimal doc_id."""
    changes = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    as_text = F.coalesce(F.concat(F.octet_length(lower).cast("string"), F.lit(":"), lower), F.lit("-"))
    return {"text": F.when(F.coalesce(changes, F.lit(False)), as_text).otherwise(field_text("text"))}
