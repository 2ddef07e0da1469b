"""Polynomial features by tensor sketching (Pham and Pagh, 2013), and logistic regression on them.

A sketch is dense: 64 KB a row at the default width. The regression never stores it. A scan makes
the spectra of a few rows at a time from their stored sparse features; decision values and
gradients are products with the spectra (Parseval), so no spectrum is transformed back. What a
task holds does not grow with its rows, and nothing is cached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.operators import linear
from gazette.shipping import ship_package
from gazette.sources.scratch import written

# Sketch width, and the weight of the constant feature.
COMPONENTS = 8192
COEF0 = 1.0
ROWS_AT_ONCE = 128
NOISE_DIGITS = 12
# Rows whose spectra are made at a time in a scan (the processor's cache holds them), and rows of a
# file of training rows, so that a scan has tasks for all processors.
PIECE, ROWS_PER_FILE = 16, 512
# Quasi-Newton steps: pairs that are remembered, sufficient decrease, and the values over which the
# objective's progress is judged (as Spark ML does).
PAIRS, DECREASE, VALUES = 10, 1e-4, 20


def hash_tables(size: int, degree: int, components: int = COMPONENTS, seed: int = 42
                ) -> tuple[np.ndarray, np.ndarray]:
    """(cell, sign) of every feature in each of ``degree`` count sketches."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, components, size=(degree, size + 1)),
            rng.choice(np.array([-1.0, 1.0]), size=(degree, size + 1)))


def sketch_rows(indices, values, size: int, degree: int, components: int = COMPONENTS,
                coef0: float = COEF0, seed: int = 42, tables=None) -> np.ndarray:
    """Sketches of sparse rows: dot products approximate (x . y + coef0) ** degree.

    Each of ``degree`` count sketches hashes every feature to a cell with a sign; multiplying
    their spectra convolves them, which sketches the tensor power. ``tables`` may hold the hash
    tables that the seed gives.
    """
    found = spectra(indices, values, size, components, coef0,
                    tables or hash_tables(size, degree, components, seed))
    # Cells that hold nothing come out as rounding noise; Spark scales columns to unit deviation
    # while it fits, so noise must be an exact zero.
    return np.round(np.fft.irfft(found, n=components, axis=1), NOISE_DIGITS)


def spectra(indices, values, size: int, components: int, coef0: float, tables) -> np.ndarray:
    """The sketches' spectra: products of those of the count sketches."""
    lengths = np.array([len(i) for i in indices], dtype=np.int64)
    return _spectra(lengths, np.concatenate([np.zeros(0, np.int64), *indices]).astype(np.int64),
                    np.concatenate([np.zeros(0), *values]), size, components, coef0, tables)


def _spectra(lengths: np.ndarray, index: np.ndarray, value: np.ndarray, size: int,
             components: int, coef0: float, tables) -> np.ndarray:
    cell, sign = tables
    rows = len(lengths)
    # The constant feature comes last, at index ``size``.
    feature = np.concatenate([index, np.full(rows, size, dtype=np.int64)])
    value = np.concatenate([value, np.full(rows, np.sqrt(coef0))])
    row = np.concatenate([np.repeat(np.arange(rows), lengths), np.arange(rows)])
    spectrum = None
    for table, signs in zip(cell, sign, strict=True):
        flat = np.bincount(row * components + table[feature], weights=value * signs[feature],
                           minlength=rows * components)
        transformed = np.fft.rfft(flat.reshape(rows, components), axis=1)
        spectrum = transformed if spectrum is None else np.multiply(
            spectrum, transformed, out=spectrum)
    return spectrum


def polynomial_sketch(arrays: DataFrame, size: int, degree: int, column: str = "features",
                      components: int = COMPONENTS, coef0: float = COEF0, seed: int = 42
                      ) -> DataFrame:
    """Replace the stored sparse rows in ``column`` by dense sketch vectors.

    Every task draws the same hash tables from the seed, so nothing is broadcast. A row takes
    8 bytes per component: do not keep the result longer than the fit that reads it.
    """
    others = [c for c in arrays.columns if c != column]
    flat = arrays.select(*others, F.col(f"{column}.indices").alias("_i"),
                         F.col(f"{column}.values").alias("_v"))
    schema = T.StructType([arrays.schema[c] for c in others]
                          + [T.StructField("_sketch", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = hash_tables(size, degree, components, seed)  # once per task
        for batch in batches:
            for start in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[start:start + ROWS_AT_ONCE]
                dense = sketch_rows(part["_i"], part["_v"], size, degree, components, coef0, seed,
                                    tables)
                yield part[others].assign(_sketch=list(dense))

    ship_package(flat.sparkSession)
    return flat.mapInPandas(run, schema).select(
        *others, array_to_vector("_sketch").alias(column))


# --------------------------------------------------------------------------- regression

@dataclass(frozen=True)
class Sketch:
    """How stored sparse rows become sketches."""

    size: int
    degree: int
    components: int = COMPONENTS
    coef0: float = COEF0
    seed: int = 42

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        return hash_tables(self.size, self.degree, self.components, self.seed)

    def spectral(self, weights: np.ndarray) -> np.ndarray:
        """What a spectrum is multiplied by to give the product of its sketch and ``weights``."""
        twice = np.full(self.components // 2 + 1, 2.0)
        twice[0] = 1.0
        if self.components % 2 == 0:
            twice[-1] = 1.0
        return (np.fft.rfft(weights) * twice / self.components).view(float)

    def pieces(self, indices: pa.Array, values: pa.Array, tables
               ) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first row, end, spectra as pairs of numbers) of a few rows at a time."""
        lengths = indices.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        index = indices.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        value = values.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        for a in range(0, len(lengths), PIECE):
            b = min(a + PIECE, len(lengths))
            cells = slice(ends[a], ends[b])
            yield a, b, _spectra(lengths[a:b], index[cells], value[cells], self.size,
                                 self.components, self.coef0, tables).view(float)


@dataclass(frozen=True)
class SketchModel:
    """Weights of the sketch's cells; the intercept comes last in ``weights``."""

    sketch: Sketch
    weights: np.ndarray
    steps: int
    converged: bool


def fit_log_reg(arrays: DataFrame, sketch: Sketch, class_weight: dict[int, float], n: int,
                ridge: float, tolerance: float, max_steps: int) -> SketchModel:
    """Logistic regression of ``label`` on the sketches of ``features`` (stored sparse rows).

    Minimises ``ridge / 2 |w|^2 + sum of weighted losses / n``, the intercept free, by quasi-Newton
    steps (L-BFGS) under Spark ML's rules to stop. ``n`` is the number of rows and the sum of their
    weights. The sparse rows are written once in even files. A label other than 1 is the negative
    class.
    """
    rows = written(arrays.select("label", "features.indices", "features.values").repartition(
        -(-n // ROWS_PER_FILE)), "sketched", long_rows=True)

    def value(point: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slopes = _losses(rows, sketch, class_weight, point)
        penalty = ridge * np.append(point[:-1], 0.0)
        return loss / n + 0.5 * float(penalty @ point), slopes / n + penalty

    weights, steps, converged = minimised(value, sketch.components + 1, tolerance, max_steps)
    return SketchModel(sketch, weights, steps, converged)


def _losses(rows: DataFrame, sketch: Sketch, class_weight: dict[int, float], point: np.ndarray
            ) -> tuple[float, np.ndarray]:
    """The sum of the losses and its gradient, the intercept's last: one scan."""
    shared = rows.sparkSession.sparkContext.broadcast(point)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sketch.tables()
        at, intercept = sketch.spectral(shared.value[:-1]), shared.value[-1]
        told, slopes = np.zeros(2), np.zeros(len(at))
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            sign = np.where(label == 1, 1.0, -1.0)
            weight = np.ones(len(label))
            for one, w in class_weight.items():
                weight[label == one] = w
            for a, b, found in sketch.pieces(batch.column(1), batch.column(2), tables):
                loss, slant, _ = linear.losses(linear.LOG, sign[a:b] * (found @ at + intercept))
                slant = weight[a:b] * sign[a:b] * slant
                told += float(weight[a:b] @ loss), slant.sum()
                slopes += slant @ found
        yield linear._packed([(0, linear.LOSS, 0, told), (0, linear.VECTOR, 0, slopes)])

    ship_package(rows.sparkSession)
    pieces = rows.mapInArrow(run, linear.SUMS).repartition("problem", "kind", "start")
    sums = {kind: v for _, kind, _, v in linear._blocks_of(
        pieces.mapInArrow(linear._added, linear.SUMS).toArrow())}
    shared.destroy()
    if not sums:  # no rows
        return 0.0, np.zeros(sketch.components + 1)
    loss, constant = sums[linear.LOSS]
    slopes = np.fft.irfft(sums[linear.VECTOR].view(complex), n=sketch.components)
    return float(loss), np.append(slopes, constant)


def minimised(value: Callable[[np.ndarray], tuple[float, np.ndarray]], size: int,
              tolerance: float, max_steps: int) -> tuple[np.ndarray, int, bool]:
    """(point, steps, whether it converged) of a convex function from zero, by L-BFGS.

    It has converged when the gradient is ``tolerance`` of the value, when the last VALUES steps
    gained less than ``tolerance`` of the first value, or when no step helps any more.
    """
    at = np.zeros(size)
    now, slope = value(at)
    first, values, pairs = now, [], []
    for steps in range(max_steps):
        if np.linalg.norm(slope) <= max(tolerance * abs(now), 1e-8) or (
                len(values) == VALUES and max(values) - now <= tolerance * abs(first)):
            return at, steps, True
        values = [*values, now][-VALUES:]
        way = -_turned(slope, pairs)
        downhill, length = float(slope @ way), 1.0
        while True:
            then, fresh = value(at + length * way)
            if then <= now + DECREASE * length * downhill:
                break
            length /= 2
            if length < 1e-8:
                return at, steps, True
        move, bend = length * way, fresh - slope
        if float(move @ bend) > 0:
            pairs = [*pairs, (move, bend)][-PAIRS:]
        at, now, slope = at + move, then, fresh
    return at, max_steps, False


def _turned(slope: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The slope times the inverse Hessian that the last moves suggest."""
    if not pairs:
        return slope / np.linalg.norm(slope)
    shares = []
    for move, bend in reversed(pairs):
        share = float(move @ slope) / float(move @ bend)
        shares.append(share)
        slope = slope - share * bend
    move, bend = pairs[-1]
    slope = slope * (float(move @ bend) / float(bend @ bend))
    for (move, bend), share in zip(pairs, reversed(shares), strict=True):
        slope = slope + (share - float(bend @ slope) / float(move @ bend)) * move
    return slope


def decisions(arrays: DataFrame, model: SketchModel, column: str) -> DataFrame:
    """``arrays`` with ``column``, the decision value, in place of ``features``."""
    others = [c for c in arrays.columns if c != "features"]
    schema = T.StructType([*[arrays.schema[c] for c in others],
                           T.StructField(column, T.DoubleType())])
    shared = arrays.sparkSession.sparkContext.broadcast(model.weights)
    sketch, n = model.sketch, len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sketch.tables()
        at, intercept = sketch.spectral(shared.value[:-1]), shared.value[-1]
        for batch in batches:
            told = [found @ at for _, _, found in sketch.pieces(
                batch.column(n), batch.column(n + 1), tables)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(np.concatenate([np.zeros(0), *told]) + intercept)],
                names=[*others, column])

    ship_package(arrays.sparkSession)
    return arrays.select(*others, "features.indices", "features.values").mapInArrow(run, schema)
