"""Many linear models at once: every pass over the rows serves all folds, candidates and classes.

Single fits read the whole table once per step and model.  Here the
coefficients of all models stand side by side in one matrix, and one pass gives
the losses and gradients of all of them.  Which rows a model learns from is a
mask on the row's group, so folds need no tables of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from operator import add as plus

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.session import stage

#: Values of one training block, about; a block is one row of the staged table.
BLOCK_VALUES = 1 << 18

#: Doubles of one piece of a gradient; pieces are added up by different tasks.
PIECE = 1 << 16

#: Doubles that tasks give to the driver at once; beyond, pieces are added up by other tasks before.
DIRECT = 1 << 22

#: Doubles of a block's rows that are spread out at once.
DENSE_VALUES = 1 << 21

#: Cells per value up to which rows are spread out: products of matrices outweigh their zeros.
CELLS_EACH = 64

#: Steps that the search for a minimum remembers.
MEMORY = 8


@dataclass(frozen=True)
class Plan:
    """One model of a stack.

    ``groups`` are the row groups it learns from, ``class_weight`` multiplies
    the rows' weights by label.  ``logistic`` has a softmax over the classes,
    ``svm`` one squared hinge per class against the rest; ``strength`` weighs
    the summed loss against half the squared coefficients.  ``columns`` are
    the ranges (start, stop, unit) of features that the model sees, with
    ``unit`` scaled to length one within the range; None is all as they are.
    ``view`` is the place of the model's own view of the table, if there are
    several.
    """

    family: str
    groups: frozenset[int]
    classes: int = 5
    strength: float = 1.0
    iterations: int = 100
    class_weight: tuple[float, ...] | None = None
    columns: tuple[tuple[int, int, bool], ...] | None = None
    view: int | None = None

    def width(self, all_columns: int) -> int:
        return all_columns if self.columns is None else sum(stop - start for start, stop, _ in self.columns)

    def weights(self, block: Block) -> np.ndarray:
        weight = np.where(np.isin(block.part, list(self.groups)), block.weight, 0.0)
        return weight if self.class_weight is None else weight * np.array(self.class_weight)[block.label.astype(np.int64)]


#: Columns of the staged table.
BLOCK = "width int, starts binary, columns binary, values binary, label binary, weight binary, part binary"


#: Blocks are long rows: a writer looks at what it holds after each few of them, a reader reads few at once.
_FILES = {
    "parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 4,
    "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 4, "parquet.enable.dictionary": "false",
}


def stage_blocks(table: DataFrame) -> DataFrame:
    return stage(table, **_FILES)


def block_row(
    width: int, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, label: np.ndarray, weight: np.ndarray, part: np.ndarray
) -> pa.RecordBatch:
    """One training block as a row of the staged table."""
    kinds = (np.int64, np.int32, np.float64, np.float64, np.float64, np.int32)
    numbers = zip(kinds, (starts, columns, values, label, weight, part))
    made = [pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary()) for kind, x in numbers]
    return pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), *made], [f.split()[0] for f in BLOCK.split(", ")])


def blocks(rows: DataFrame) -> DataFrame:
    """Training blocks of (features, label, weight, part), staged: many rows' numbers in one row."""

    def pack(columns: pa.Array, label, weight, part) -> Iterator[pa.RecordBatch]:
        sparse = columns.field("type").to_numpy(zero_copy_only=False) == 0
        values = columns.field("values")
        lengths = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
        flat, listed = values.flatten().to_numpy(), columns.field("indices").flatten().to_numpy()
        width = int(columns.field("size")[0].as_py()) if sparse[0] else int(lengths[0])
        ends, sparse_ends = np.cumsum(lengths), np.cumsum(np.where(sparse, lengths, 0))
        first = 0
        while first < len(columns):
            base = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, base + BLOCK_VALUES, "right")), first + 1)
            own = slice(int(base), int(ends[last - 1]))
            starts = np.concatenate([[0], ends[first:last] - base])
            # full rows list no places
            places = np.arange(own.stop - own.start) - np.repeat(starts[:-1], lengths[first:last])
            places[np.repeat(sparse[first:last], lengths[first:last])] = listed[
                sparse_ends[first - 1] if first else 0 : sparse_ends[last - 1]
            ]
            yield block_row(width, starts, places, flat[own], label[first:last], weight[first:last], part[first:last])
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from pack(
                    batch.column("features"), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "part"))
                )

    chosen = rows.select(
        "features", F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"),
        F.col("part").cast("int").alias("part"),
    )
    return stage_blocks(chosen.mapInArrow(run, BLOCK))


class Block:
    """The numbers of one training block."""

    def __init__(self, width: int, *buffers):
        kinds = (np.int64, np.int32, np.float64, np.float64, np.float64, np.int32)
        self.__setstate__((width, *(np.frombuffer(b, kind) for b, kind in zip(buffers, kinds))))

    def __getstate__(self) -> tuple:
        return self.width, self.starts, self.columns, self.values, self.label, self.weight, self.part

    def __setstate__(self, state: tuple) -> None:
        self.width, self.starts, self.columns, self.values, self.label, self.weight, self.part = state
        self.rows = len(self.label)
        self.dense = self.values.reshape(self.rows, self.width) if len(self.values) == self.rows * self.width else None
        self.row_of = None if self.dense is not None else np.repeat(np.arange(self.rows), np.diff(self.starts))

    def times(self, matrix: np.ndarray) -> np.ndarray:
        """(rows, k): the rows times coefficients (width, k)."""
        return np.concatenate([part.times(0, self.width, matrix) for part in self.parts()])

    def transposed_times(self, errors: np.ndarray) -> np.ndarray:
        """(width, k): the columns times numbers of the rows (rows, k)."""
        return sum(part.transposed_times(0, self.width, errors[part.rows]) for part in self.parts())

    def parts(self) -> Iterator[Dense | Sparse]:
        """The rows in stretches, spread out unless nearly all cells are zero."""
        if self.dense is not None:
            yield Dense(slice(0, self.rows), self.dense)
        elif len(self.values) * CELLS_EACH < self.rows * self.width:
            yield Sparse(self)
        else:
            step = max(DENSE_VALUES // self.width, 1)
            for first in range(0, self.rows, step):
                rows = slice(first, min(first + step, self.rows))
                own = slice(self.starts[first], self.starts[rows.stop])
                matrix = np.zeros((rows.stop - first, self.width))
                matrix[self.row_of[own] - first, self.columns[own]] = self.values[own]
                yield Dense(rows, matrix)


@dataclass(frozen=True)
class View:
    """A table's columns as some models see them: the place of each (-1 is left out), its factor, and their number."""

    place: np.ndarray
    factor: np.ndarray
    width: int

    def of(self, block: Block, rows: np.ndarray) -> Block:
        """The chosen rows of a block with the columns of the view."""
        row_of = np.repeat(np.arange(block.rows), np.diff(block.starts)) if block.row_of is None else block.row_of
        place = self.place[block.columns]
        there = np.flatnonzero((place >= 0) & rows[row_of])
        row = (np.cumsum(rows) - 1)[row_of[there]]
        starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=int(rows.sum())))])
        values = block.values[there] * self.factor[block.columns[there]]
        made = Block.__new__(Block)
        made.__setstate__((self.width, starts, place[there], values, block.label[rows], block.weight[rows], block.part[rows]))
        # places are not in order
        made.dense, made.row_of = None, row
        return made


def seen_by(
    block: Block, plans: Sequence[Plan], groups: Sequence[frozenset[int]], views: Sequence[View] | None
) -> Iterator[tuple[Block, list[int]]]:
    """The block in every view, with the plans that look at it so and have rows of their ``groups`` in it."""
    for view in dict.fromkeys(p.view for p in plans):
        own = [i for i, p in enumerate(plans) if p.view == view]
        if view is None:
            yield block, own
            continue
        rows = np.isin(block.part, list(frozenset().union(*[groups[i] for i in own])))
        if rows.any():
            yield views[view].of(block, rows), own


class Dense:
    """Rows of a block as a matrix; ranges of its columns are multiplied where they stand."""

    def __init__(self, rows: slice, matrix: np.ndarray):
        self.rows, self.matrix = rows, matrix

    def times(self, start: int, stop: int, matrix: np.ndarray) -> np.ndarray:
        return self.matrix[:, start:stop] @ matrix

    def transposed_times(self, start: int, stop: int, errors: np.ndarray) -> np.ndarray:
        return self.matrix[:, start:stop].T @ errors

    def squares(self, start: int, stop: int) -> np.ndarray:
        own = self.matrix[:, start:stop]
        return np.einsum("ij,ij->i", own, own)


class Sparse:
    """All rows of a block, of which nearly all cells are zero."""

    def __init__(self, block: Block):
        self.rows, self.block = slice(0, block.rows), block

    def _range(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = self.block
        if (start, stop) == (0, b.width):
            return b.row_of, b.columns, b.values
        own = (b.columns >= start) & (b.columns < stop)
        return b.row_of[own], b.columns[own] - start, b.values[own]

    def times(self, start: int, stop: int, matrix: np.ndarray) -> np.ndarray:
        row, place, values = self._range(start, stop)
        return np.stack([np.bincount(row, values * column[place], self.block.rows) for column in matrix.T], axis=1)

    def transposed_times(self, start: int, stop: int, errors: np.ndarray) -> np.ndarray:
        row, place, values = self._range(start, stop)
        return np.stack([np.bincount(place, values * column[row], stop - start) for column in errors.T], axis=1)

    def squares(self, start: int, stop: int) -> np.ndarray:
        row, _, values = self._range(start, stop)
        return np.bincount(row, values**2, self.block.rows)


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    names = [f.split()[0] for f in BLOCK.split(", ")]
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(batch.column("width")[i].as_py(), *(batch.column(n)[i].as_buffer() for n in names[1:]))


def block_of(row) -> Block:
    """The block of a row of the staged table."""
    return Block(*(row[f.split()[0]] for f in BLOCK.split(", ")))


@contextmanager
def kept(table: DataFrame | RDD) -> Iterator[RDD]:
    """The blocks as objects that executors keep on their disks while passes go over them.

    In memory they would fill the heap beside the Python workers' own memory.
    A lost one is made again from the staged table.  What is kept already is given back.
    """
    if isinstance(table, RDD):
        yield table
        return
    rows = table.rdd.map(block_of).persist(StorageLevel.DISK_ONLY)
    try:
        yield rows
    finally:
        rows.unpersist()


def softmax(scores: np.ndarray) -> np.ndarray:
    grown = np.exp(scores - scores.max(1, keepdims=True))
    return grown / grown.sum(1, keepdims=True)


def _loss(plan: Plan, scores: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss and its derivative by the scores."""
    own = label.astype(np.int64)
    truth = np.zeros_like(scores)
    truth[np.arange(len(own)), own] = 1
    if plan.family == "logistic":
        probs = softmax(scores)
        loss = -np.log(np.maximum(probs[np.arange(len(own)), own], 1e-300))
        return float(weight @ loss), (probs - truth) * weight[:, None]
    sign = 2 * truth - 1
    short = np.maximum(1 - sign * scores, 0)
    return float(weight @ (short**2).sum(1)), -2 * sign * short * weight[:, None]


def pieces(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    return enumerate(numbers[i : i + PIECE] for i in range(0, len(numbers), PIECE))


def summed(parts: RDD, size: int) -> np.ndarray:
    """The sum of arrays of ``size`` numbers that tasks gave in pieces; its size is that of the models."""
    if size * parts.getNumPartitions() > DIRECT:
        parts = parts.reduceByKey(plus, min(-(-size // PIECE), 4 * parts.context.defaultParallelism))
    total = np.zeros(size)
    for piece, numbers in parts.collect():
        total[piece * PIECE : piece * PIECE + len(numbers)] += numbers
    return total


def over_blocks(table: DataFrame | RDD, shared, size: int, add: Callable[[Block, object, np.ndarray], None]) -> np.ndarray:
    """The sum over all blocks of what ``add`` puts into an array of ``size`` numbers; ``shared`` is broadcast."""
    rows = table.rdd.map(block_of) if isinstance(table, DataFrame) else table
    sent = rows.context.broadcast(shared)

    def run(blocks: Iterator[Block]) -> Iterator[tuple[int, np.ndarray]]:
        total, value = np.zeros(size), sent.value
        for block in blocks:
            add(block, value, total)
        return pieces(total)

    try:
        return summed(rows.mapPartitions(run), size)
    finally:
        sent.destroy()


def by_range(plans: Sequence[Plan], chosen: Sequence[int], width: int) -> dict[tuple[int, int, bool], list[tuple[int, int]]]:
    """The chosen plans that see each range of columns, and the place of its first one in their coefficients."""
    out: dict[tuple[int, int, bool], list[tuple[int, int]]] = {}
    for i in chosen:
        first = 0
        for start, stop, unit in plans[i].columns or ((0, width, False),):
            out.setdefault((start, stop, unit), []).append((i, first))
            first += stop - start
    return out


def _lengths(part: Dense | Sparse, start: int, stop: int) -> np.ndarray:
    length = np.sqrt(part.squares(start, stop))
    return np.where(length > 0, length, 1)[:, None]


def scores_of(block: Block, plans: Sequence[Plan], chosen: Sequence[int], at) -> Iterator[tuple]:
    """(part, scores of each chosen plan, lengths of the ranges to scale) of the block's stretches; a range is multiplied once for all plans."""
    ranges = by_range(plans, chosen, block.width)
    stacks = {r: np.concatenate([at[i][first : first + r[1] - r[0]] for i, first in users], axis=1) for r, users in ranges.items()}
    for part in block.parts():
        scores = {i: np.tile(at[i][-1], (part.rows.stop - part.rows.start, 1)) for i in chosen}
        lengths = {r: _lengths(part, *r[:2]) for r in ranges if r[2]}
        for r, users in ranges.items():
            found, done = part.times(*r[:2], stacks[r]), 0
            if r in lengths:
                found /= lengths[r]
            for i, _ in users:
                scores[i] += found[:, done : (done := done + plans[i].classes)]
        yield part, scores, lengths


def _evaluate(
    table: DataFrame | RDD, plans: Sequence[Plan], at: Sequence[np.ndarray], views: Sequence[View] | None = None
) -> list[tuple[float, np.ndarray]]:
    """Objective and gradient of every model at its coefficients (width + 1, classes), intercepts last; one pass."""
    head = 2 * len(plans)
    ends = head + np.cumsum([x.size for x in at])
    starts = ends - [x.size for x in at]

    def add(whole: Block, shared: tuple, total: np.ndarray) -> None:
        at, views = shared
        sums = total[:head].reshape(-1, 2)
        for block, own_plans in seen_by(whole, plans, [p.groups for p in plans], views):
            weights = {i: w for i in own_plans if (w := plans[i].weights(block)).any()}
            if not weights:
                continue
            ranges = by_range(plans, list(weights), block.width)
            for part, scores, lengths in scores_of(block, plans, list(weights), at):
                errors = {}
                for i, w in weights.items():
                    loss, errors[i] = _loss(plans[i], scores[i], block.label[part.rows], w[part.rows])
                    sums[i] += loss, w[part.rows].sum()
                    total[ends[i] - plans[i].classes : ends[i]] += errors[i].sum(0)
                for r, users in ranges.items():
                    joined, done = np.concatenate([errors[i] for i, _ in users], axis=1), 0
                    slopes = part.transposed_times(*r[:2], joined / lengths[r] if r in lengths else joined)
                    for i, first in users:
                        classes = plans[i].classes
                        own = slice(starts[i] + first * classes, starts[i] + (first + r[1] - r[0]) * classes)
                        total[own] += slopes[:, done : (done := done + classes)].ravel()

    found = over_blocks(table, (list(at), views), int(ends[-1]), add)
    out = []
    for i, (plan, x) in enumerate(zip(plans, at)):
        loss, weight = found[2 * i : 2 * i + 2]
        weight = weight or 1.0
        penalty = 1 / (plan.strength * weight)
        slope = found[starts[i] : ends[i]].reshape(x.shape) / weight
        slope[:-1] += penalty * x[:-1]
        out.append((loss / weight + penalty / 2 * float((x[:-1] ** 2).sum()), slope))
    return out


class Descent:
    """Limited-memory quasi-Newton steps of one model, one evaluation at a time."""

    def __init__(self, start: np.ndarray, iterations: int):
        self.x, self.left = start, iterations
        self.value, self.slope = np.inf, None
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.direction, self.length, self.tries, self.done = np.zeros_like(start), 1.0, 0, iterations <= 0

    def proposal(self) -> np.ndarray:
        return self.x + self.length * self.direction

    def report(self, value: float, slope: np.ndarray) -> None:
        """Take the proposal if it goes down far enough, else shorten the step."""
        if self.slope is None:
            self.value, self.slope = value, slope
            self._turn()
            return
        gain = 1e-4 * self.length * float((self.slope * self.direction).sum())
        if not value <= self.value + gain:
            self.length, self.tries = self.length / 2, self.tries + 1
            self.done = self.tries > 20
            return
        step, change = self.length * self.direction, slope - self.slope
        if float((step * change).sum()) > 1e-12 * float((change**2).sum()):
            self.steps = [*self.steps[-MEMORY + 1 :], (step, change)]
        flat = self.value - value <= 1e-7 * max(1.0, abs(self.value))
        self.x, self.value, self.slope = self.x + step, value, slope
        self.left -= 1
        self.done = self.left <= 0 or flat
        self._turn()

    def _turn(self) -> None:
        down, shares = -self.slope, []
        for step, change in reversed(self.steps):
            share = float((step * down).sum()) / float((step * change).sum())
            shares.append(share)
            down = down - share * change
        if self.steps:
            step, change = self.steps[-1]
            down = down * (float((step * change).sum()) / float((change**2).sum()))
        for (step, change), share in zip(self.steps, reversed(shares)):
            down = down + (share - float((change * down).sum()) / float((step * change).sum())) * step
        steep = float(np.abs(self.slope).max(initial=0.0))
        self.done = self.done or steep < 1e-7
        self.direction, self.tries = down, 0
        self.length = 1.0 if self.steps else min(1.0, 1 / max(float(np.sqrt((self.slope**2).sum())), 1e-12))


def fit(table: DataFrame | RDD, plans: Sequence[Plan], views: Sequence[View] | None = None) -> list[np.ndarray]:
    """Coefficients (width + 1, classes) of every model, intercepts last; ``table`` comes from ``blocks`` or ``kept``.

    Each round is one pass over the blocks for all models that are not done.
    The driver holds the coefficients and the last steps of all models, which
    their number and width bound.  Without rows all coefficients are zero.
    """
    with kept(table) as rows:
        first = rows.map(lambda block: block.width).take(1)
        width = first[0] if first else 0
        widths = [p.width(width if p.view is None else views[p.view].width) for p in plans]
        searches = [Descent(np.zeros((w + 1, p.classes)), p.iterations if first else 0) for p, w in zip(plans, widths)]
        while open_ones := [i for i, s in enumerate(searches) if not s.done]:
            found = _evaluate(rows, [plans[i] for i in open_ones], [searches[i].proposal() for i in open_ones], views)
            for i, (value, slope) in zip(open_ones, found):
                searches[i].report(value, slope)
    return [s.x for s in searches]


def sigmoids(table: DataFrame | RDD, plans: Sequence[Plan], fitted: Sequence[np.ndarray], judged: Sequence[frozenset[int]]) -> list[np.ndarray]:
    """(classes, 2) slope and shift of a sigmoid over each class's margin, fitted on the row groups ``judged``.

    The margins are computed once.  Newton steps of all models and classes
    together; each is one pass over them.
    """
    bounds = np.cumsum([0, *[p.classes for p in plans]])
    at, steps = np.tile([1.0, 0.0], (int(bounds[-1]), 1)), np.zeros((int(bounds[-1]), 2))
    value = np.full(len(at), np.inf)

    def add(judged_rows: tuple, now: np.ndarray, total: np.ndarray) -> None:
        label, part, margins = judged_rows
        sums = total.reshape(-1, 6)
        for i, groups in enumerate(judged):
            chosen = np.isin(part, list(groups))
            for k in range(bounds[i], bounds[i + 1]):
                m, truth = margins[chosen, k], label[chosen] == k - bounds[i]
                z = now[k, 0] * m + now[k, 1]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                loss = np.logaddexp(0, z) - truth * z
                error, bend = p - truth, p * (1 - p)
                sums[k] += loss.sum(), error @ m, error.sum(), bend @ m**2, bend @ m, bend.sum()

    with kept(table) as rows:
        sent = rows.context.broadcast(np.concatenate(fitted, axis=1))
        margins = rows.map(
            lambda block: (block.label, block.part, block.times(sent.value[:-1]) + sent.value[-1])
        ).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for _ in range(40):
                trial = at + steps
                found = over_blocks(margins, trial, 6 * len(at), add).reshape(-1, 6)
                ridge = 1e-3  # keeps the slope of a perfect separation finite
                loss = found[:, 0] + ridge / 2 * (trial**2).sum(1)
                better = loss <= value
                if np.abs(steps[~better]).max(initial=0) < 1e-9 and np.abs(np.where(better, value - loss, 0.0)).max() < 1e-9 * len(at):
                    break
                next_steps = np.empty_like(steps)
                for k in range(len(at)):
                    if better[k]:
                        slope = found[k, 1:3] + ridge * trial[k]
                        bend = np.array([[found[k, 3], found[k, 4]], [found[k, 4], found[k, 5]]]) + ridge * np.eye(2)
                        at[k], value[k], next_steps[k] = trial[k], loss[k], -np.linalg.solve(bend, slope)
                    else:
                        next_steps[k] = steps[k] / 2
                steps = next_steps
        finally:
            margins.unpersist()
            sent.destroy()
    return [at[bounds[i] : bounds[i + 1]] for i in range(len(plans))]


def _java(spark, name: str, *arguments):
    made = getattr(spark._jvm.org.apache.spark.ml.classification, name)
    return made(*[_py2java(spark.sparkContext, a) for a in arguments])


def logistic_stages(spark, fitted: np.ndarray, name: str) -> PipelineModel:
    """The softmax model as a Spark ML model."""
    width, classes = fitted.shape[0] - 1, fitted.shape[1]
    matrix = DenseMatrix(classes, width, fitted[:-1].T.ravel(order="F"))
    model = LogisticRegressionModel(_java(spark, "LogisticRegressionModel", name, matrix, Vectors.dense(fitted[-1]), classes, True))
    return PipelineModel([model])


def svm_stages(spark, fitted: np.ndarray, curves: np.ndarray, name: str) -> PipelineModel:
    """One machine, margin column and sigmoid per class as Spark ML models."""
    made = []
    for k in range(fitted.shape[1]):
        machine = LinearSVCModel(_java(spark, "LinearSVCModel", f"{name}_{k}", Vectors.dense(fitted[:-1, k]), float(fitted[-1, k])))
        made.append(machine.setRawPredictionCol(f"margin_{k}").setPredictionCol(f"side_{k}"))
        made.append(VectorAssembler(inputCols=[f"margin_{k}"], outputCol=f"margins_{k}"))
        # a margin column holds (-m, m)
        slope, shift = curves[k]
        matrix = DenseMatrix(1, 2, [0.0, float(slope)], True)
        sigmoid = LogisticRegressionModel(
            _java(spark, "LogisticRegressionModel", f"{name}_sigmoid_{k}", matrix, Vectors.dense([float(shift)]), 2, False)
        )
        made.append(
            sigmoid.setFeaturesCol(f"margins_{k}").setProbabilityCol(f"probability_{k}")
            .setRawPredictionCol(f"sigmoid_{k}").setPredictionCol(f"calibrated_{k}")
        )
    return PipelineModel(made)


def fit_families(table: DataFrame, plans: Sequence[Plan], calibration: Sequence[frozenset[int]], mode: str = "five_class") -> list[PipelineModel]:
    """Fitted stages of every model; the machines' sigmoids learn from their ``calibration`` groups."""
    spark = table.sparkSession
    machines = [i for i, p in enumerate(plans) if p.family == "svm"]
    curves: dict[int, np.ndarray] = {}
    with kept(table) as rows:
        fitted = fit(rows, plans)
        if machines:
            found = sigmoids(rows, [plans[i] for i in machines], [fitted[i] for i in machines], [calibration[i] for i in machines])
            curves = dict(zip(machines, found))
    return [
        svm_stages(spark, fitted[i], curves[i], f"svm_{i}") if i in curves else logistic_stages(spark, fitted[i], f"logistic_{i}")
        for i in range(len(plans))
    ]


def judged(
    table: DataFrame, plans: Sequence[Plan], fitted: Sequence[np.ndarray], groups: Sequence[frozenset[int]],
    views: Sequence[View] | None = None,
) -> DataFrame:
    """(model, user_rating, ai_expected_rating) of each logistic model's rows in its ``groups``, one pass for all."""
    sent = table.sparkSession.sparkContext.broadcast((list(fitted), views))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, views = sent.value
        for whole in each_block(batches):
            for block, own_plans in seen_by(whole, plans, groups, views):
                chosen = {i: np.isin(block.part, list(groups[i])) for i in own_plans}
                open_ones = [i for i, c in chosen.items() if c.any()]
                for part, scores, _ in scores_of(block, plans, open_ones, at):
                    for i in open_ones:
                        own = chosen[i][part.rows]
                        probs, label = softmax(scores[i][own]), block.label[part.rows][own]
                        expected = probs @ np.arange(1, plans[i].classes + 1)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(probs), i, np.int32)), pa.array((label + 1).astype(np.int32)), pa.array(expected)],
                            ["model", "user_rating", "ai_expected_rating"],
                        )

    return table.mapInArrow(run, "model int, user_rating int, ai_expected_rating double")
