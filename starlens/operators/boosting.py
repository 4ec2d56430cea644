"""Boosted trees for several classes with one joint loss: softmax gradients, one tree per class and round.

Rows stay where they are.  Each level of all trees of a round costs one pass:
tasks add up gradients per tree node, feature and bin, the sums are dealt by
feature, and only the best split of each node comes back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.operators.stacked import Block, block_of, each_block, over_blocks, softmax, stage_blocks

#: Values at which a feature may be cut, at most; they are quantiles of its non-zero values.
CUTS = 15

#: Features whose sums one task adds up.
FEATURES_EACH = 256

#: Rounds after which the rows' scores are kept anew; until then they are summed up from the last trees.
ROUNDS_EACH = 10


@dataclass(frozen=True)
class Settings:
    rounds: int = 50
    depth: int = 5
    rate: float = 0.1
    classes: int = 5
    least_weight: float = 1.0
    ridge: float = 1.0
    rows_share: float = 0.8
    patience: int = 10
    seed: int = 42


@dataclass(frozen=True)
class Part:
    """The row groups that one of several models learns from and those that stop its rounds."""

    learns: frozenset[int] = frozenset({0})
    stops: frozenset[int] = frozenset({1})
    class_weight: tuple[float, ...] | None = None

    def weights(self, block: Block, groups: frozenset[int]) -> np.ndarray:
        weight = np.where(np.isin(block.part, list(groups)), block.weight, 0.0)
        return weight if self.class_weight is None else weight * np.array(self.class_weight)[block.label.astype(np.int64)]


@dataclass
class Tree:
    """A node's children are 2 i + 1 and 2 i + 2; feature -1 is a leaf.  Values up to the threshold go left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    @classmethod
    def leaf(cls, depth: int) -> Tree:
        n = (1 << (depth + 1)) - 1
        return cls(np.full(n, -1, np.int32), np.zeros(n), np.zeros(n))

    @property
    def depth(self) -> int:
        return len(self.feature).bit_length() - 1

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after so many levels; rows in a leaf stay there."""
        at = np.zeros(len(x), np.int32)
        for _ in range(levels):
            feature = self.feature[at]
            inner = feature >= 0
            right = x[np.arange(len(x)), np.maximum(feature, 0)] > self.threshold[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


class Seen:
    """Trees over the few columns that they cut, and rows with those columns alone."""

    def __init__(self, trees: list[list[Tree | None]], width: int):
        self.columns = np.unique(np.concatenate([np.zeros(1, np.int32), *[t.feature for each in trees for t in each if t is not None]]))
        self.columns = self.columns[self.columns >= 0]
        self.place = np.full(max(width, 1), -1)
        self.place[self.columns] = np.arange(len(self.columns))
        self.trees = [[t and replace(t, feature=np.where(t.feature >= 0, self.place[t.feature], -1)) for t in each] for each in trees]

    def rows(self, block: Block) -> np.ndarray:
        if block.dense is not None:
            return block.dense[:, self.columns]
        out = np.zeros((block.rows, len(self.columns)))
        place = self.place[block.columns]
        own = np.flatnonzero(place >= 0)
        out[block.row_of[own], place[own]] = block.values[own]
        return out


def find_cuts(table: DataFrame) -> list[np.ndarray]:
    """Per feature the values between which trees may cut; one row per feature comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in each_block(batches):
            columns = block.columns if block.dense is None else np.tile(np.arange(block.width, dtype=np.int32), block.rows)
            yield pa.RecordBatch.from_arrays([pa.array(columns), pa.array(block.values)], ["feature", "value"])

    shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    found = (
        table.mapInArrow(run, "feature int, value double").groupBy("feature")
        .agg(F.percentile_approx("value", shares, 1000).alias("cuts"), F.min("value").alias("low"))
    )
    first = table.select("width").first()
    out = [np.empty(0)] * (first["width"] if first else 0)
    for r in found.collect():
        # absent values are zero, so zero may be told from small positive numbers
        out[r["feature"]] = np.unique([*r["cuts"], *([0.0] if r["low"] > 0 else [])])
    return out


class Bins:
    """Features as numbers of the stretch between cuts that a value lies in."""

    def __init__(self, cuts: list[np.ndarray]):
        self.width = max([len(c) for c in cuts], default=0) + 1
        self.flat = np.full((len(cuts), self.width - 1), np.inf)
        for row, c in zip(self.flat, cuts):
            row[: len(c)] = c
        self.of_zero = (self.flat < 0).sum(1)

    def of(self, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """A value up to cut i and above cut i - 1 is in bin i."""
        out = np.zeros(len(values), np.int64)
        for i in range(self.width - 1):
            out += values > self.flat[columns, i]
        return out


def _scores(trees: list[list[Tree | None]], x: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.copy()
    for each in trees:
        for k, tree in enumerate(each):
            if tree is not None:
                out[:, k] += tree.value[tree.nodes(x, tree.depth)]
    return out


@dataclass
class Scored:
    """A block that stays with an executor: its number, the cell (feature and bin) of each value, and the rows' scores."""

    block: Block
    number: int
    cell: np.ndarray
    scores: np.ndarray


def _drawn(of: Scored, round_: int, settings: Settings) -> np.ndarray:
    """Rows that take part in a round, drawn anew by their place, the same in every pass."""
    draw = np.random.default_rng([settings.seed, round_, of.number])
    return draw.random(of.block.rows) < settings.rows_share


_SPLIT = ("class", "node", "gain", "feature", "bin", "gradient", "weight", "left_gradient", "left_weight")


def _gains(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g**2 / (h + ridge)


def _add(total: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> None:
    """Add the numbers at their places of a flat array, which may be far longer."""
    if len(total) <= 4 * len(at):
        total += np.bincount(at, numbers, len(total))
    else:
        np.add.at(total, at, numbers)


def _splits(
    rows: RDD, shared, open_nodes: list[tuple[int, int]], bins: Bins, parts: list[Part], settings: Settings
) -> pd.DataFrame:
    """The best split of each open (class, node): one pass, one row per node and range of features comes back."""
    sent = rows.context.broadcast((shared, bins))
    nodes, classes = len(open_nodes), settings.classes
    of_class: dict[int, list[tuple[int, int]]] = {}
    for i, (k, node) in enumerate(open_nodes):
        of_class.setdefault(k, []).append((i, node))
    features_all = len(bins.flat)
    each = min(FEATURES_EACH, -(-features_all // rows.context.defaultParallelism))

    def run(blocks: Iterator[Scored]) -> Iterator[tuple]:
        (trees, current, level, round_), bins = sent.value
        total, sums, seen = None, np.zeros((nodes, 2)), None
        for of in blocks:
            block = of.block
            if total is None:
                total = np.zeros((2, nodes, features_all * bins.width))
                seen = Seen([*trees, current], features_all)
            x = seen.rows(block)
            scores, drawn = _scores(seen.trees[:-1], x, of.scores), _drawn(of, round_, settings)
            row_of = block.row_of if block.dense is None else np.repeat(np.arange(block.rows), block.width)
            for m in sorted({k // classes for k in of_class}):
                weight = parts[m].weights(block, parts[m].learns)
                gradient, bend = _slopes(block, scores[:, m * classes : (m + 1) * classes], weight)
                used = (weight > 0) & drawn
                for c, tree in enumerate(seen.trees[-1][m * classes : (m + 1) * classes]):
                    if not (own_nodes := of_class.get(m * classes + c)):
                        continue
                    slot, first, n = np.full(len(tree.feature), -1), own_nodes[0][0], len(own_nodes)
                    for i, node in own_nodes:
                        slot[node] = i - first
                    own = np.where(used, slot[tree.nodes(x, level)], -1)
                    of_row = own[row_of]
                    hit = np.flatnonzero(of_row >= 0)
                    row, at = row_of[hit], of_row[hit] * total.shape[2] + of.cell[hit]
                    there = own >= 0
                    for j, numbers in enumerate((gradient[:, c], bend[:, c])):
                        sums[first : first + n, j] += np.bincount(own[there], numbers[there], n)
                        _add(total[j, first : first + n].reshape(-1), at, numbers[row])
        if total is None:
            return
        step = each * bins.width
        for piece in range(0, features_all * bins.width, step):
            own = total[:, :, piece : piece + step].reshape(2, -1)
            hits = np.flatnonzero(own[1])
            yield piece // step, (sums, hits.astype(np.int32), own[:, hits])

    def best(found: Iterator[tuple]) -> Iterator[np.ndarray]:
        """The best splits of the ranges of features that came to this task."""
        bins, added = sent.value[1], {}
        for piece, (s, cells, numbers) in found:
            if piece not in added:
                features = min(each, features_all - piece * each)
                added[piece] = np.zeros((2, nodes * features * bins.width)), np.zeros((nodes, 2))
            added[piece][0][:, cells] += numbers
            added[piece][1][:] += s
        for piece, (total, sums) in added.items():
            yield _best(piece * each, total.reshape(2, nodes, -1, bins.width), sums, open_nodes, bins, settings)

    try:
        # one row per open node and range of features, so few that the driver picks the best
        found = rows.mapPartitions(run).partitionBy(-(-features_all // each), int).mapPartitions(best).collect()
        table = pd.DataFrame(np.concatenate(found) if found else np.empty((0, len(_SPLIT))), columns=_SPLIT)
        table = table.astype(dict.fromkeys(("class", "node", "feature", "bin"), int))
        return table.sort_values(["gain", "feature"], ascending=[False, True]).drop_duplicates(["class", "node"])
    finally:
        sent.destroy()


def _best(first: int, total: np.ndarray, sums: np.ndarray, open_nodes: list[tuple[int, int]], bins: Bins, settings: Settings) -> np.ndarray:
    """The best split of each open node among some features, from sums (2, nodes, features, bins) and those of all rows."""
    nodes, features = total.shape[1:3]
    # rows without a value lie in the bin of zero
    rest = sums.T[:, :, None] - total.sum(3)
    zero = bins.of_zero[first : first + features]
    for f in range(features):
        total[:, :, f, zero[f]] += rest[:, :, f]
    left = total.cumsum(3)[..., :-1]
    right = sums.T[:, :, None, None] - left
    gain = _gains(left[0], left[1], settings.ridge) + _gains(right[0], right[1], settings.ridge)
    gain -= _gains(sums[:, 0], sums[:, 1], settings.ridge)[:, None, None]
    possible = (left[1] >= settings.least_weight) & (right[1] >= settings.least_weight)
    gain = np.where(possible & np.isfinite(bins.flat[first : first + features])[None], gain, -np.inf).reshape(nodes, -1)
    where = gain.argmax(1) if gain.shape[1] else np.zeros(nodes, int)
    top = gain[np.arange(nodes), where] if gain.shape[1] else np.full(nodes, -np.inf)
    cuts = max(bins.width - 1, 1)
    own_left = left.reshape(2, nodes, -1)[:, np.arange(nodes), where] if gain.shape[1] else np.zeros((2, nodes))
    keys = np.array(open_nodes)
    return np.column_stack([keys, top, first + where // cuts, where % cuts, sums, own_left.T])


def _slopes(block: Block, scores: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted softmax loss by the scores."""
    probs = softmax(scores)
    truth = np.zeros_like(probs)
    truth[np.arange(block.rows), block.label.astype(int)] = 1
    return (probs - truth) * weight[:, None], np.maximum(2 * probs * (1 - probs), 1e-16) * weight[:, None]


def _scored(rows: RDD, trees: list[list[Tree | None]]) -> RDD:
    """The blocks with the scores after ``trees``."""
    sent = rows.context.broadcast(trees)

    def run(of: Scored) -> Scored:
        seen = Seen(sent.value, of.block.width)
        return replace(of, scores=_scores(seen.trees, seen.rows(of.block), of.scores))

    return rows.map(run)


def _losses(rows: RDD, trees: list[list[Tree | None]], parts: list[Part], classes: int) -> np.ndarray:
    """(models, 2): mean loss of every model over the rows it learns from and those that stop it."""

    def add(of: Scored, trees: list, total: np.ndarray) -> None:
        block, seen, sums = of.block, Seen(trees, of.block.width), total.reshape(-1, 2, 2)
        scores = _scores(seen.trees, seen.rows(block), of.scores)
        for m, part in enumerate(parts):
            probs = softmax(scores[:, m * classes : (m + 1) * classes])
            loss = -np.log(np.maximum(probs[np.arange(block.rows), block.label.astype(int)], 1e-300))
            for i, groups in enumerate((part.learns, part.stops)):
                weight = part.weights(block, groups)
                sums[m, i] += (loss * weight).sum(), weight.sum()

    found = over_blocks(rows, trees, 4 * len(parts), add).reshape(-1, 2, 2)
    return np.divide(found[..., 0], found[..., 1], out=np.full(found.shape[:2], np.nan), where=found[..., 1] > 0)


def _leaf(gradient: float, weight: float, settings: Settings) -> float:
    return -settings.rate * gradient / (weight + settings.ridge)


@dataclass
class Boosted:
    trees: list[list[Tree]]
    train_loss: list[float]
    validation_loss: list[float]
    done: bool = False

    def judge(self, losses: np.ndarray, patience: int) -> None:
        """Note a round's losses; stop where the validation loss has not fallen for long."""
        self.train_loss.append(float(losses[0]))
        self.validation_loss.append(float(losses[1]))
        if not np.isnan(losses[1]):
            best = int(np.nanargmin(self.validation_loss))
            if len(self.trees) - 1 - best >= patience:
                self.trees, self.done = self.trees[: best + 1], True


def fit(table: DataFrame, settings: Settings = Settings()) -> Boosted:
    """Trees for the rows of part 0 of ``stacked.blocks``; rows of part 1 stop the rounds."""
    return fit_many(table, [Part()], settings)[0]


def fit_many(table: DataFrame, parts: list[Part], settings: Settings = Settings()) -> list[Boosted]:
    """Several models that share every pass, for instance one per fold.

    Each round draws rows and grows one tree per model and class level by
    level.  When a model's validation loss has not fallen for ``patience``
    rounds, its rounds up to the lowest one are kept; without validation rows
    all are.  ``table`` comes from ``stacked.blocks``.
    """
    classes = settings.classes
    columns = classes * len(parts)
    table = stage_blocks(table.withColumn("number", F.monotonically_increasing_id()))
    bins = Bins(find_cuts(table))
    models = [Boosted([], [], []) for _ in parts]
    if not len(bins.flat):
        return models
    sent = table.sparkSession.sparkContext.broadcast(bins)

    def first(row) -> Scored:
        block, bins = block_of(row), sent.value
        features = block.columns if block.dense is None else np.tile(np.arange(block.width, dtype=np.int32), block.rows)
        cell = features * np.int64(bins.width) + bins.of(features, block.values)
        return Scored(block, row["number"], cell, np.zeros((block.rows, columns)))

    rows = table.rdd.map(first).persist(StorageLevel.MEMORY_AND_DISK)
    since: list[list[Tree | None]] = []
    try:
        for round_ in range(settings.rounds):
            growing = [m for m, model in enumerate(models) if not model.done]
            if not growing:
                break
            current = [Tree.leaf(settings.depth) if k // classes in growing else None for k in range(columns)]
            _grow(rows, (since, current, round_), bins, parts, settings)
            since.append(current)
            losses = _losses(rows, since, parts, classes)
            for m in growing:
                models[m].trees.append(current[m * classes : (m + 1) * classes])
                models[m].judge(losses[m], settings.patience)
            if len(since) == ROUNDS_EACH:
                before, rows, since = rows, _scored(rows, since).persist(StorageLevel.MEMORY_AND_DISK), []
                rows.count()
                before.unpersist()
    finally:
        rows.unpersist()
    return models


def _grow(rows: RDD, state: tuple, bins: Bins, parts: list[Part], settings: Settings) -> None:
    """Split the current trees level by level."""
    since, current, round_ = state
    open_nodes = [(k, 0) for k, tree in enumerate(current) if tree is not None]
    for level in range(settings.depth):
        found = _splits(rows, (since, current, level, round_), sorted(open_nodes), bins, parts, settings)
        open_nodes = []
        for r in found.itertuples():
            tree, node = current[r[1]], r.node
            if not node:
                tree.value[0] = _leaf(r.gradient, r.weight, settings)
            if r.gain > 1e-12:
                left, right = 2 * node + 1, 2 * node + 2
                tree.feature[node], tree.threshold[node] = r.feature, bins.flat[r.feature, r.bin]
                tree.value[left] = _leaf(r.left_gradient, r.left_weight, settings)
                tree.value[right] = _leaf(r.gradient - r.left_gradient, r.weight - r.left_weight, settings)
                open_nodes += [(r[1], left), (r[1], right)]
        if not open_nodes:
            break


class SoftmaxTrees(Transformer, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` (vector) from fitted trees, which are kept as text."""

    trees = Param(Params._dummy(), "trees", "trees per round and class as JSON", typeConverter=TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, trees: str = "[]", classes: int = 5):
        super().__init__()
        self._setDefault(featuresCol="features", trees="[]", classes=5)
        self._set(**self._input_kwargs)

    @classmethod
    def of(cls, fitted: Boosted, classes: int) -> SoftmaxTrees:
        listed = [
            [[t.feature.tolist(), t.threshold.tolist(), t.value.tolist()] for t in each] for each in fitted.trees
        ]
        return cls(trees=json.dumps(listed), classes=classes)

    def fitted(self) -> list[list[Tree]]:
        listed = json.loads(self.getOrDefault(self.trees))
        return [[Tree(np.array(f, np.int32), np.array(t, float), np.array(v, float)) for f, t, v in each] for each in listed]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, classes = self.fitted(), self.getOrDefault(self.classes)
        used = np.unique([f for each in trees for t in each for f in t.feature if f >= 0]).astype(np.int32)
        for each in trees:
            for t in each:
                t.feature = np.where(t.feature >= 0, np.searchsorted(used, t.feature), -1).astype(np.int32)

        @F.pandas_udf("array<double>")
        def score(features: pd.DataFrame) -> pd.Series:
            x = np.zeros((len(features), max(len(used), 1)))
            if len(used):
                for row, indices, values in zip(x, features["indices"], features["values"]):
                    if indices is None:
                        row[:] = values[used]
                    else:
                        known = np.isin(indices, used)
                        row[np.searchsorted(used, indices[known])] = values[known]
            return pd.Series(list(softmax(_scores(trees, x, np.zeros((len(x), classes))))))

        return dataset.withColumn("probability", array_to_vector(score(F.col(self.getFeaturesCol()))))
