"""Linear classifiers by Newton steps over stored sparse rows, many problems per scan.

A problem is ``0.5 |w|^2 + C x sum of weighted losses`` over the rows of one part of a table. Two
losses: ``log`` (logistic regression, intercept free) and ``squared_hinge`` (the support vector
machine, its intercept penalised like any other weight).

All problems of a table advance together: one scan serves every C, class weight and fold at
once. A step is Newton's: conjugate gradients solve its equation, and steps are cut until the
objective falls enough. Scans of three kinds: in the first a task adds up loss and gradient over
its rows. A task that holds all rows of a problem solves the Newton equation in the second. Where
several tasks hold them, a scan adds up one product with the Hessian of all rows, and the equation
is solved between the scans. (Directions that each task finds with the Hessian of its own rows
need fewer scans a step, but a task sees few of the rows that a rare feature occurs in: their
average all but stops far from the optimum.)

Sums leave the tasks in blocks of the vector and meet by block, so no task and no
driver step ever sees rows of others. The driver keeps a few vectors per problem, as long as the
vocabulary, which is bounded (see ``terms``). A task that solves an equation holds the cells of its
rows: see ``written_parts`` for how many. Other scans hold a stretch of rows at a time.

NULL labels are not allowed; a label other than 1 is the negative class.
"""

from __future__ import annotations

from collections.abc import Generator, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from threading import Lock

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.shipping import ship_package

LOG, SQUARED_HINGE = "log", "squared_hinge"
TOLERANCE, MAX_SCANS = 1e-4, 10_000
# A solver's vectors leave a task in blocks of this length; rows are worked off by stored cells.
BLOCK, CELLS = 1 << 16, 1 << 20
# Cells that are multiplied and added up at a time.
STRETCH = 1 << 14
VALUE, DIRECTION, PRODUCT = 0, 1, 2
# What comes back: (rows, losses), a gradient, a direction or a product, how many tasks had rows, and
# the diagonal of the losses' Hessian.
LOSS, VECTOR, TASKS, DIAGONAL = 0, 1, 2, 3
# Rows that travel to Python at a time while rows are scanned: long ones fill a buffer soon.
BATCH_ROWS = 512
# Sufficient decrease, how far a Newton equation is solved, and in how many steps at most.
DECREASE, FORCING, INNER = 1e-4, 0.03, 250
# How much of the Hessian's diagonal scales the equation (Hsia et al. 2018).
SCALING = 0.01
# How often the rows that shape a careful step may grow in number, and the share of the slope that
# a step must gain to be left as it is. Plain and careful steps take turns where the gradient falls
# slower than to SLOW of what it was; a step that had to be cut makes the next one careful.
WIDENINGS, ENOUGH, SLOW = 10, 0.1, 0.5
# Shorter steps whose objective is told along with that of the whole step.
STEPS = 0.5 ** np.arange(0.5, 12.5, 0.5)


@dataclass(frozen=True)
class Problem:
    """``part`` names its rows, ``size`` the number of features."""

    part: int
    size: int
    loss: str
    c: float = 1.0
    class_weight: dict[int, float] = field(default_factory=dict, hash=False)

    @property
    def penalty(self) -> np.ndarray:
        """1 for every weight that is penalised; the intercept comes last."""
        out = np.ones(self.size + 1)
        out[-1] = 1.0 if self.loss == SQUARED_HINGE else 0.0
        return out


@dataclass(frozen=True)
class Solution:
    """``weights`` and ``intercept``; ``gradient`` is the largest component left."""

    weights: np.ndarray
    intercept: float
    objective: float
    gradient: float
    steps: int
    scans: int
    converged: bool


class _State:
    """Where one problem stands: it asks for a value at a point or a product with a direction."""

    def __init__(self, problem: Problem, tolerance: float):
        self.problem, self.tolerance = problem, tolerance
        self.penalty = problem.penalty
        self.at = self.tried = np.zeros(problem.size + 1)
        self.value = self.first = None
        self.step, self.steps, self.scans = 1.0, 0, 0
        self.phase, self.done = VALUE, False
        self.way = self.slope = None
        self.line = self.converged = False
        self.size, self.careful = None, True
        self.tasks = self.equation = self.ahead = None

    def asks(self) -> tuple:
        """(phase, point, origin of the step, whether several tasks may have to solve the next
        equation), (phase, point, gradient, rows, accuracy, whether rows outside the margin shape
        the step) or (phase, point, what the Hessian multiplies)."""
        if self.phase == VALUE:
            return VALUE, self.tried, self.at if self.line else None, self.tasks != 1
        if self.phase == PRODUCT:
            return PRODUCT, self.at, self.ahead
        return DIRECTION, self.at, self.gradient, self.rows, self._near(), self.careful

    def _near(self) -> float:
        return min(FORCING, (self.size / self.first) ** 0.5)

    def take(self, sums: dict[int, np.ndarray]) -> None:
        self.scans += 1
        if self.phase == VALUE:
            self.tasks = int(sums[TASKS][0])
            self._take_value(sums[LOSS], sums[VECTOR], sums.get(DIAGONAL))
        elif self.phase == PRODUCT:
            self._ask(sums[VECTOR] + self.penalty * self.ahead)
        else:
            self._go(sums[VECTOR])

    def _ask(self, product: np.ndarray | None) -> None:
        """The next vector of the Newton equation; None begins."""
        try:
            self.ahead = self.equation.send(product)
        except StopIteration as end:
            self._go(end.value)

    def _go(self, way: np.ndarray) -> None:
        self.way = way
        self.slope = float(self.gradient @ self.way)
        self.step, self.tried, self.phase, self.line = 1.0, self.at + self.way, VALUE, True

    def _take_value(self, told: np.ndarray, slopes: np.ndarray, diagonal: np.ndarray | None
                    ) -> None:
        rows, loss, *shorter = told.tolist()
        value = loss + self._penalties(self.tried)
        if self.value is not None:
            enough = self.value + DECREASE * self.step * self.slope + 1e-12 * abs(self.value)
            if value > enough and self.step > 1e-8:
                steps, values = [self.step / 2], [0.0]
                if self.line:
                    steps = list(STEPS)
                    values = [v + self._penalties(self.at + s * self.way)
                              for s, v in zip(steps, shorter, strict=True)]
                self.step = steps[int(np.argmin(values))]
                self.tried, self.line = self.at + self.step * self.way, False
                return
            self.steps += 1
        self.at, self.value, self.rows = self.tried, value, rows
        self.gradient = slopes + self.penalty * self.at
        before, self.size = self.size, float(np.linalg.norm(self.gradient))
        if self.step < 1:
            self.careful = True
        elif before is not None and self.size > SLOW * before:
            self.careful = not self.careful
        self.first = self.size if self.first is None else self.first
        self.converged = self.size <= self.tolerance * self.first
        # No step helps any more: as near as the arithmetic gets.
        self.done = self.converged or self.step <= 1e-8
        self.phase = DIRECTION
        if self.tasks > 1 and not self.done:
            self.phase = PRODUCT
            self.equation = _equation(_scale(diagonal, self.penalty), self.gradient,
                                      np.zeros_like(self.gradient), self._near() * self.size)
            self._ask(None)

    def _penalties(self, point: np.ndarray) -> float:
        return 0.5 * float(self.penalty @ (point * point))

    def solution(self) -> Solution:
        return Solution(self.at[:-1], float(self.at[-1]), float(self.value),
                        float(np.abs(self.gradient).max()), self.steps, self.scans, self.converged)


def solve(rows: DataFrame, problems: Sequence[Problem], tolerance: float = TOLERANCE,
          max_scans: int = MAX_SCANS) -> list[Solution]:
    """Solutions of all problems over ``rows``: ``part, label, indices, values``.

    A problem is solved when its gradient is ``tolerance`` of what it was at zero. ``rows`` is
    read once per scan: pass a written table.
    """
    states = [_State(p, tolerance) for p in problems]
    tasks = rows.rdd.getNumPartitions()
    with short_batches(rows.sparkSession):
        for _ in range(max_scans):
            active = [i for i, s in enumerate(states) if not s.done]
            if not active:
                break
            sums = _scan(rows, {i: (states[i].problem, *states[i].asks()) for i in active}, tasks)
            for i in active:
                states[i].take(sums[i])
    return [s.solution() for s in states]


_batches, _batches_lock = {"users": 0, "before": None}, Lock()


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """While this lasts, at most BATCH_ROWS rows travel to Python at a time.

    Threads share the session's setting: the last one to leave puts the old one back.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    with _batches_lock:
        if not _batches["users"]:
            _batches["before"] = before = spark.conf.get(key)
            if not 0 < int(before) < BATCH_ROWS:
                spark.conf.set(key, str(BATCH_ROWS))
        _batches["users"] += 1
    try:
        yield
    finally:
        with _batches_lock:
            _batches["users"] -= 1
            if not _batches["users"]:
                spark.conf.set(key, _batches["before"])


def gradient(rows: DataFrame, problem: Problem, solution: Solution) -> np.ndarray:
    """The gradient of the objective at a solution, the intercept's last."""
    return gradients(rows, [(problem, solution)])[0]


def gradients(rows: DataFrame, solutions: Sequence[tuple[Problem, Solution]]
              ) -> list[np.ndarray]:
    """The gradients of the objectives at all solutions, in one scan."""
    at = [np.append(s.weights, s.intercept) for _, s in solutions]
    sums = _scan(rows, {i: (p, VALUE, at[i], None) for i, (p, _) in enumerate(solutions)})
    return [sums[i][VECTOR] + p.penalty * at[i] for i, (p, _) in enumerate(solutions)]


# --------------------------------------------------------------------------- one scan

class Cells:
    """Some rows as flat arrays: ``index`` and ``value`` of every stored cell, row by row, as Arrow
    holds them.

    Sums add up cells one after another. Decision values are taken a stretch of rows at a time
    that the processor's cache holds.
    """

    def __init__(self, indices: pa.Array, values: pa.Array):
        self._keep(indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False),
                   indices.flatten().to_numpy(zero_copy_only=False),
                   values.flatten().to_numpy(zero_copy_only=False))

    @classmethod
    def from_flat(cls, lengths: np.ndarray, index: np.ndarray, value: np.ndarray) -> Cells:
        cells = cls.__new__(cls)
        cells._keep(lengths, index, value)
        return cells

    def _keep(self, lengths: np.ndarray, index: np.ndarray, value: np.ndarray) -> None:
        self.lengths, self.index, self.value = lengths, index, value
        self.n, self.kept = len(lengths), None
        ends = np.cumsum(lengths, dtype=np.int64)
        # Rows that have cells, and the first cell of each.
        self.filled = np.flatnonzero(lengths)
        self.begin = ends[self.filled] - lengths[self.filled]
        # (first row, end, first cell, end) of every stretch.
        self.stretches, row, cell = [], 0, 0
        while row < self.n:
            end = max(row + 1, int(np.searchsorted(ends, cell + STRETCH, "right")))
            self.stretches.append((row, end, cell, int(ends[end - 1])))
            row, cell = end, int(ends[end - 1])

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Decision values; the last weight is the intercept."""
        out = np.zeros(self.n)
        for row, end, a, b in self.stretches:
            cells = weights.take(self.index[a:b], mode="clip")
            cells *= self.value[a:b]
            np.add.at(out, np.repeat(np.arange(row, end), self.lengths[row:end]), cells)
        return weights[-1] + out

    def near(self, weights: np.ndarray) -> np.ndarray:
        """Decision values whose cells add up in pairs: quicker, with another rounding."""
        out, done = np.full(self.n, weights[-1]), 0
        for _, end, a, b in self.stretches:
            upto = int(np.searchsorted(self.filled, end))
            if upto > done:
                cells = weights.take(self.index[a:b], mode="clip")
                cells *= self.value[a:b]
                out[self.filled[done:upto]] += np.add.reduceat(cells, self.begin[done:upto] - a)
            done = upto
        return out

    def back(self, per_row: np.ndarray, size: int, squared: bool = False) -> np.ndarray:
        """Sums over rows of ``per_row`` times the row, the intercept's constant 1 last."""
        out = np.zeros(size + 1)
        for row, end, a, b in self.stretches:
            value = self.value[a:b]
            cells = value * value if squared else value
            np.add.at(out, self.index[a:b], cells * np.repeat(
                per_row[row:end], self.lengths[row:end]))
        if self.kept is not None:
            # Added up as the constant of all rows is, to the last bit.
            per_row, chosen = np.zeros(len(self.kept)), per_row
            per_row[self.kept] = chosen
        out[-1] = per_row.sum()
        return out

    def of(self, kept: np.ndarray) -> Cells:
        """The rows that are ``kept``; the cells themselves if all are."""
        if kept.all():
            return self
        inside = np.repeat(kept, self.lengths)
        cells = Cells.from_flat(self.lengths[kept], self.index[inside], self.value[inside])
        cells.kept = kept
        return cells


def slices_of(batch: pa.RecordBatch, column: str = "indices") -> Iterator[pa.RecordBatch]:
    """Stretches of a batch with a bounded number of stored cells (or a single row)."""
    ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(
        zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + CELLS, "right")))
        yield batch.slice(start, end - start)
        start = end


def losses(loss: str, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, first and second derivative by the margin ``y z``."""
    if loss == LOG:
        low = np.exp(-np.abs(margin))
        chance = np.where(margin > 0, low, 1.0) / (1 + low)  # of the other class
        return np.log1p(low) + np.maximum(-margin, 0), -chance, chance * (1 - chance)
    if loss == SQUARED_HINGE:
        short = np.maximum(1 - margin, 0)
        return short * short, -2 * short, 2.0 * (short > 0)
    raise ValueError(f"unknown loss {loss!r}")


def _signs(label: np.ndarray, problem: Problem) -> tuple[np.ndarray, np.ndarray]:
    """(+1 or -1, weight of the loss) of every row."""
    weight = np.full(len(label), float(problem.c))
    for value, w in problem.class_weight.items():
        weight[label == value] *= w
    return np.where(label == 1, 1.0, -1.0), weight


def _value(cells: Cells, label: np.ndarray, problem: Problem, point: np.ndarray,
           origin: np.ndarray | None = None, bent: bool = False) -> dict[int, np.ndarray]:
    """Rows, loss, losses at shorter steps from the origin, gradient of the losses, and the
    diagonal of their Hessian if it is asked for."""
    sign, weight = _signs(label, problem)
    margin = sign * cells.times(point)
    loss, slope, bend = losses(problem.loss, margin)
    told = [float(cells.n), float((weight * loss).sum())]
    if origin is not None:
        start = sign * cells.times(origin)
        told += [float((weight * losses(problem.loss, start + s * (margin - start))[0]).sum())
                 for s in STEPS]
    out = {LOSS: np.array(told), VECTOR: cells.back(weight * slope * sign, problem.size)}
    if bent:
        out[DIAGONAL] = cells.back(weight * bend, problem.size, squared=True)
    return out


def _direction(cells: Cells, label: np.ndarray, problem: Problem, point: np.ndarray,
               slope: np.ndarray, rows: float, near: float, careful: bool
               ) -> dict[int, np.ndarray]:
    """The share of these rows in the Newton direction against the gradient ``slope``."""
    sign, weight = _signs(label, problem)
    share = cells.n / rows
    margin = sign * cells.times(point)
    loss, slant, bend = losses(problem.loss, margin)
    penalty, way = problem.penalty, np.zeros_like(slope)
    goal = near * float(np.linalg.norm(slope))
    for _ in range(WIDENINGS):
        curved = weight * bend / share
        # Rows without curvature add nothing: the equation is solved over the others alone.
        bending = curved != 0
        bent, curved = cells.of(bending), curved[bending]
        scale = _scale(bent.back(curved, problem.size, squared=True), penalty)
        way = _newton(bent, curved, penalty, scale, slope, way, goal)
        if problem.loss != SQUARED_HINGE or not careful:
            break
        # What the whole step does to the objective, as far as these rows can tell.
        moved = sign * cells.times(way)
        beyond = losses(problem.loss, margin + moved)[0] - loss - slant * moved
        downhill = float(slope @ way)
        change = downhill + float((weight * beyond).sum()) / share + 0.5 * float(
            penalty @ (way * way))
        if change <= ENOUGH * downhill:
            break
        # It goes too far: rows that it would bring inside the margin must resist it.
        fresh = (bend == 0) & (margin + moved < 1)
        if not fresh.any():
            break
        bend[fresh] = 2.0
    return {VECTOR: share * (way if way.any() else -slope / scale)}


def _product(cells: Cells, label: np.ndarray, problem: Problem, point: np.ndarray,
             ahead: np.ndarray) -> dict[int, np.ndarray]:
    """The losses' Hessian times ``ahead``."""
    sign, weight = _signs(label, problem)
    curved = weight * losses(problem.loss, sign * cells.near(point))[2]
    bending = curved != 0
    bent, curved = cells.of(bending), curved[bending]
    return {VECTOR: bent.back(curved * bent.near(ahead), problem.size)}


def _scale(diagonal: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """What the Newton equation is scaled by, from the diagonal of the losses' Hessian."""
    return penalty + SCALING * (np.maximum(diagonal + penalty, 1e-12) - penalty)


def _newton(cells: Cells, curved: np.ndarray, penalty: np.ndarray, scale: np.ndarray,
            slope: np.ndarray, way: np.ndarray, goal: float) -> np.ndarray:
    """``(penalty + rows' curvature) way = -slope`` by conjugate gradients, begun at ``way``."""
    equation = _equation(scale, slope, way, goal)
    try:
        ahead = next(equation)
        while True:
            ahead = equation.send(cells.back(curved * cells.times(ahead), len(ahead) - 1)
                                  + penalty * ahead)
    except StopIteration as end:
        return end.value


def _equation(scale: np.ndarray, slope: np.ndarray, way: np.ndarray, goal: float
              ) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Conjugate gradients for ``Hessian x way = -slope``: gives vectors, takes their products."""
    rest = -slope - (yield way) if way.any() else -slope
    ahead = rest / scale
    match = float(rest @ ahead)
    for _ in range(INNER):
        if np.linalg.norm(rest) <= goal:
            break
        step = yield ahead
        bent = float(ahead @ step)
        if bent <= 0:
            break
        length = match / bent
        way = way + length * ahead
        rest = rest - length * step
        scaled = rest / scale
        again = float(rest @ scaled)
        ahead = scaled + (again / match) * ahead
        match = again
    return way


def _cells_of(rows: pa.RecordBatch | pa.Table) -> tuple[Cells, np.ndarray]:
    """Cells and labels of ``part, label, indices, values``."""
    indices, values = rows.column(2), rows.column(3)
    if isinstance(rows, pa.Table):
        indices, values = indices.combine_chunks(), values.combine_chunks()
    return Cells(indices, values), rows.column(1).to_numpy()


SUMS = "problem int, kind int, start bigint, sums binary"


def _packed(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    problem, kind, start, sums = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(problem, pa.int32()), pa.array(kind, pa.int32()), pa.array(start, pa.int64()),
         pa.array([v.tobytes() for v in sums], pa.binary())],
        names=["problem", "kind", "start", "sums"])


def _blocks_of(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, int, int, np.ndarray]]:
    for i, kind, start, sums in zip(*[rows.column(c).to_pylist() for c in range(4)], strict=True):
        yield i, kind, start, np.frombuffer(sums)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple[int, int, int], np.ndarray] = {}
    for batch in batches:
        for *key, sums in _blocks_of(batch):
            at = tuple(key)
            totals[at] = totals[at] + sums if at in totals else sums
    yield _packed([(*key, sums) for key, sums in totals.items()])


def apart(frames: Iterable[DataFrame]) -> DataFrame:
    """The union of frames that keeps each one's tasks.

    Spark takes a union of frames of one task each for one task. The last frame here has no rows
    and no tasks; as it is not partitioned like the others, they stay apart.
    """
    frames = list(frames)
    none = frames[0].sparkSession.range(0).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in frames[0].schema])
    return reduce(DataFrame.union, [*frames, none])


def _scan(rows: DataFrame, asked: dict[int, tuple], tasks: int | None = None
          ) -> dict[int, dict[int, np.ndarray]]:
    """What every asked problem wants to know, added up over its rows.

    Directions take long: while the ``tasks`` of the rows leave processors idle, the problems of
    a part are dealt over several tasks that read the same rows.
    """
    by_part: dict[int, dict[int, tuple]] = {}
    for i, ask in asked.items():
        by_part.setdefault(ask[0].part, {})[i] = ask
    steep = [sum(phase == DIRECTION for _, phase, *_ in asks.values())
             for asks in by_part.values()]
    idle = rows.sparkSession.sparkContext.defaultParallelism // tasks if tasks else 1
    shares = max(1, min(max(steep), idle))
    # A task fetches only what concerns the parts it holds rows of.
    shared = {part: rows.sparkSession.sparkContext.broadcast(asks)
              for part, asks in by_part.items()}

    def dealt(part: int, share: int) -> dict[int, tuple]:
        asks = list(shared[part].value.items())
        return dict(asks[share::shares])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        held: dict[int, list[pa.RecordBatch]] = {}

        def add(i: int, sums: dict[int, np.ndarray]) -> None:
            for kind, values in sums.items():
                found[i, kind] = found[i, kind] + values if (i, kind) in found else values

        share = 0
        phases = {VALUE: _value, PRODUCT: _product}
        for batch in batches:
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            share = batch.column(4)[0].as_py() if batch.num_rows else share
            for part in np.unique(parts).tolist():
                if part not in shared:
                    continue
                own = batch if (parts == part).all() else batch.filter(pa.array(parts == part))
                asks = dealt(part, share)
                if any(phase == DIRECTION for _, phase, *_ in asks.values()):
                    held.setdefault(part, []).append(own)
                if all(phase == DIRECTION for _, phase, *_ in asks.values()):
                    continue
                for piece in slices_of(own):
                    cells, label = _cells_of(piece)
                    for i, (problem, phase, *at) in asks.items():
                        if phase in phases:
                            add(i, phases[phase](cells, label, problem, *at))
                            if phase == VALUE:
                                found[i, TASKS] = np.ones(1)
        while held:
            part, batches_of = held.popitem()
            cells, label = _cells_of(pa.Table.from_batches(batches_of).combine_chunks())
            del batches_of
            for i, (problem, phase, *at) in dealt(part, share).items():
                if phase == DIRECTION:
                    add(i, _direction(cells, label, problem, *at))
        rows_of = [(i, kind, b, sums[b:b + BLOCK]) for (i, kind), sums in found.items()
                   for b in range(0, len(sums), BLOCK)]
        yield _packed(rows_of)

    ship_package(rows.sparkSession)
    # Blocks travel as bytes and are added up where they meet, one running sum per block.
    copies = [rows.select("part", "label", "indices", "values", F.lit(k).alias("share"))
              for k in range(shares)]
    pieces = (apart(copies) if shares > 1 else copies[0]).mapInArrow(run, SUMS)
    total = pieces.repartition("problem", "kind", "start").mapInArrow(_added, SUMS)
    # A few vectors as long as the vocabulary.
    result = total.toArrow().sort_by([("problem", "ascending"), ("kind", "ascending"),
                                      ("start", "ascending")])
    for part in shared.values():
        part.destroy()
    out: dict[int, dict[int, list]] = {i: {} for i in asked}
    for i, kind, _, sums in _blocks_of(result):
        out[i].setdefault(kind, []).append(sums)
    whole = {i: {kind: np.concatenate(v) for kind, v in kinds.items()}
             for i, kinds in out.items()}
    for i, (problem, *_) in asked.items():
        # No row of this part: nothing to add up.
        whole[i].setdefault(VECTOR, np.zeros(problem.size + 1))
        whole[i].setdefault(LOSS, np.zeros(2))
        whole[i].setdefault(TASKS, np.zeros(1))
    return whole


# --------------------------------------------------------------------------- applying

def decisions(rows: DataFrame, weights: np.ndarray, intercept: float, column: str = "score"
              ) -> DataFrame:
    """``rows`` with ``column``, the decision value, in place of ``indices, values``."""
    others = [c for c in rows.columns if c not in ("indices", "values")]
    schema = T.StructType([*[rows.schema[c] for c in others],
                           T.StructField(column, T.DoubleType())])
    shared = rows.sparkSession.sparkContext.broadcast(np.append(weights, intercept))
    n = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices_of(batch):
                cells = Cells(piece.column(n), piece.column(n + 1))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:n], pa.array(cells.times(shared.value))],
                    names=[*others, column])

    ship_package(rows.sparkSession)
    return rows.select(*others, "indices", "values").mapInArrow(run, schema)


def confusions(rows: DataFrame, models: Sequence[tuple[int, np.ndarray, float]]
               ) -> list[tuple[int, int, int]]:
    """(true positives, false positives, false negatives) of every ``(part, weights, intercept)``
    over the rows of its part, all in one scan."""
    shared = rows.sparkSession.sparkContext.broadcast(
        [(part, np.append(w, b)) for part, w, b in models])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(shared.value), 3), np.int64)
        for batch in batches:
            for piece in slices_of(batch):
                parts = piece.column(0).to_numpy(zero_copy_only=False)
                truth = piece.column(1).to_numpy(zero_copy_only=False) == 1
                for part in np.unique(parts):
                    own = parts == part
                    kept = piece.filter(pa.array(own))
                    cells = Cells(kept.column(2), kept.column(3))
                    for i, (of, weights) in enumerate(shared.value):
                        if of == part:
                            said, so = cells.times(weights) > 0, truth[own]
                            counts[i] += ((said & so).sum(), (said & ~so).sum(),
                                          (~said & so).sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(counts)), pa.int32()), *[pa.array(c) for c in counts.T]],
            names=["model", "tp", "fp", "fn"])

    ship_package(rows.sparkSession)
    counted = rows.select("part", "label", "indices", "values").mapInArrow(
        run, "model int, tp bigint, fp bigint, fn bigint")
    # One row per model.
    by_model = {r["model"]: (r["tp"], r["fp"], r["fn"]) for r in counted.groupBy("model").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()}
    shared.destroy()
    return [by_model.get(i, (0, 0, 0)) for i in range(len(models))]
