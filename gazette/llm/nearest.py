"""Nearest neighbours by cosine: collision counting over query-centred windows.

Method: vectors are scaled to length one and projected on ``projections`` random normal
directions. An index block keeps, for each direction, its vectors sorted by their projection. A
query looks at the window of half-width ``R`` around its own projection in every sorted array; a
vector that lies in enough of these windows (collides often enough) is verified by its exact
cosine. Windows then grow by ``growth`` (virtual rehashing: the same arrays serve every radius),
and only the ring that came in is counted. The search of a block ends when as many vectors as
wanted have been verified within distance ``R``; the last window holds everything, so a block with
too few vectors verifies them all. Nothing caps the number of candidates.

A vector at distance R lies in the window of one direction with probability 0.683 (a normal
deviate within one standard deviation). The collisions needed are two standard deviations below
the mean of that binomial, so one at distance R or less is verified with probability 0.977 or more.

Scale: rows are dealt over blocks of about ``block`` vectors by a hash; queries are sent to every
block and answered as they stream by, so a task holds one block and one batch of queries. Each
block offers the nearest few of each query, and these few rows are merged per query. Equal vectors
are one class, which carries its ``k + 1`` smallest ids: as ties go to the smaller id, no other id
of it can be among the ``k`` nearest. A vector that a third of the rows share is thus one row.

Vectors that are NULL, zero, or hold NULL or non-finite components, and rows without an id, take
no part. Vectors of other dimensions are not candidates. Rows that share id and vector are one; an
id with several vectors is a candidate, and a query, with each of them, never its own neighbour.
An empty table gives an empty result, fewer candidates than ``k`` all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.shipping import ship_package
from gazette.sources.scratch import written

PROJECTIONS, GROWTH, FIRST_RADIUS, BLOCK, SEED = 64, 1.2, 0.1, 8192, 77
QUERIES_AT_ONCE = 256
# A normal deviate stays within one standard deviation; deviations left as slack.
WITHIN_ONE, SLACK = 0.6827, 2.0


def collisions_needed(projections: int) -> int:
    spread = (WITHIN_ONE * (1 - WITHIN_ONE) * projections) ** 0.5
    return max(1, int(np.floor(WITHIN_ONE * projections - SLACK * spread)))


def radii(first: float, growth: float) -> np.ndarray:
    """Growing radii up to the diameter of the unit sphere, then everything."""
    steps = int(np.ceil(np.log(2.0 / first) / np.log(growth)))
    return np.append(first * growth ** np.arange(steps + 1), np.inf)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


class BlockIndex:
    """Sorted projections of the vectors of one block."""

    def __init__(self, vectors: np.ndarray, projections: int, seed: int):
        self.vectors = vectors
        self.peaks = np.abs(vectors).max(1)
        scaled = vectors / self.peaks[:, None]
        self.lengths = np.sqrt((scaled * scaled).sum(1))
        rng = np.random.default_rng([seed, vectors.shape[1]])
        self.directions = rng.standard_normal((vectors.shape[1], projections))
        places = (unit(vectors) @ self.directions).T
        order = np.argsort(places, axis=1, kind="stable")
        self.sorted = np.take_along_axis(places, order, axis=1)
        self.order = order.astype(np.int32).ravel()
        self.needed = collisions_needed(projections)

    def cosines(self, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact cosines in double precision; the same for equal vectors wherever they stand."""
        peak = np.abs(query).max()
        scaled = query / peak
        dots = ((self.vectors[rows] / self.peaks[rows, None]) * scaled).sum(1)
        return dots / (self.lengths[rows] * np.sqrt((scaled * scaled).sum()))

    def windows(self, queries: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last place of every query, radius and direction."""
        centres = unit(queries) @ self.directions
        shape = (len(queries), len(steps), len(self.sorted))
        low, high = np.empty(shape, np.int64), np.empty(shape, np.int64)
        for j, values in enumerate(self.sorted):
            low[:, :, j] = np.searchsorted(values, centres[:, j, None] - steps, "left")
            high[:, :, j] = np.searchsorted(values, centres[:, j, None] + steps, "right")
        return low, high

    def nearest(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, steps: np.ndarray,
                want: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the ``want`` nearest vectors found."""
        n = self.sorted.shape[1]
        offsets = np.arange(len(self.sorted)) * n
        counts = np.zeros(n, np.int64)
        verified = np.zeros(n, bool)
        rows, scores = np.empty(0, np.int64), np.empty(0)
        for r, radius in enumerate(steps):
            if r == 0:
                counts += self._count(offsets + low[0], high[0] - low[0], n)
            else:
                counts += self._count(
                    np.concatenate([offsets + low[r], offsets + high[r - 1]]),
                    np.concatenate([low[r - 1] - low[r], high[r] - high[r - 1]]), n)
            fresh = np.flatnonzero((counts >= self.needed) & ~verified)
            if len(fresh):
                verified[fresh] = True
                rows = np.concatenate([rows, fresh])
                scores = np.concatenate([scores, self.cosines(query, fresh)])
            # Distance R between unit vectors is a cosine of 1 - R * R / 2.
            if len(rows) >= want and np.count_nonzero(
                    scores >= 1 - radius * radius / 2) >= want:
                break
        # More than wanted on ties: the caller decides by id.
        if len(rows) > want:
            cut = np.partition(scores, len(scores) - want)[len(scores) - want]
            rows, scores = rows[scores >= cut], scores[scores >= cut]
        return rows, scores

    def _count(self, starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
        """How often each vector lies in the given stretches of the sorted arrays."""
        total = int(lengths.sum())
        if not total:
            return np.zeros(n, np.int64)
        ends = np.cumsum(lengths)
        places = np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
        return np.bincount(self.order[places], minlength=n)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(
        len(vectors), -1)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of a batch with equal ``dim, block, query``."""
    keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
    marks = np.zeros(batch.num_rows, bool)
    for key in keys:
        marks[1:] |= key[1:] != key[:-1]
    cuts = [0, *np.flatnonzero(marks).tolist(), batch.num_rows]
    for start, end in zip(cuts, cuts[1:]):
        yield tuple(key[start] for key in keys), batch.slice(start, end - start)


OFFERS = "q1 bigint, q2 bigint, ids array<bigint>, score double"


def _search(want: int, projections: int, first: float, growth: float, seed: int):
    """Builds the index of a block from its rows, then answers the queries behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = radii(first, growth)
        at, index, parts, ids = None, None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            for (dim, block, is_query), part in _runs(batch):
                if at != (dim, block):
                    at, index, parts = (dim, block), None, []
                if not is_query:
                    parts.append(part)
                    continue
                if not parts:
                    continue
                if index is None:
                    index = BlockIndex(np.concatenate([_matrix(p.column(6)) for p in parts]),
                                       projections, seed)
                    ids = pa.concat_arrays([p.column(5) for p in parts])
                for start in range(0, part.num_rows, QUERIES_AT_ONCE):
                    yield _answers(index, ids, part.slice(start, QUERIES_AT_ONCE), steps, want)

    return run


def _answers(index: BlockIndex, ids: pa.Array, part: pa.RecordBatch, steps: np.ndarray,
             want: int) -> pa.RecordBatch:
    queries = _matrix(part.column(6))
    low, high = index.windows(queries, steps)
    found = [index.nearest(q, low[i], high[i], steps, want) for i, q in enumerate(queries)]
    sizes = [len(rows) for rows, _ in found]
    times = pa.array(np.repeat(np.arange(len(found)), sizes))
    rows = np.concatenate([rows for rows, _ in found])
    return pa.RecordBatch.from_arrays(
        [part.column(3).take(times), part.column(4).take(times), ids.take(pa.array(rows)),
         pa.array(np.concatenate([scores for _, scores in found]))],
        names=["q1", "q2", "ids", "score"])


def sound(vector: Column) -> Column:
    """Whether a vector has a direction: no NULL, no NaN, nothing infinite, not all zero."""
    return (F.size(vector) > 0) & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(
        vector, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
            vector_col: str = "embedding", projections: int = PROJECTIONS,
            growth: float = GROWTH, first_radius: float = FIRST_RADIUS, block: int = BLOCK,
            seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows found nearest to every query row.

    ``is_query`` is a condition on the columns of ``vectors``. Nearest first, ties to the smaller
    id. Raise ``projections`` for a higher recall and fewer verifications.
    """
    vector = F.col(vector_col)
    rows = vectors.where(sound(vector) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), vector.alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.xxhash64(vector).alias("h1"), F.xxhash64(vector, F.lit(1)).alias("h2"))
    key, want = ["h1", "h2"], k + 1
    smallest = W.partitionBy(*key).orderBy("id")
    classes = rows.select("id", "vector", *key).withColumn(
        "place", F.dense_rank().over(smallest)).where(F.col("place") <= want).groupBy(*key).agg(
        F.array_sort(F.collect_set("id")).alias("ids"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("dim", F.size("vector")), "classes")
    most = classes.groupBy("dim").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-most // block)
    asked = rows.where("asks").select("id", *key).distinct()
    asking = classes.join(asked.select(*key).distinct(), key, "left_semi")
    columns = ["h1", "h2", "ids", F.col("vector").cast("array<double>").alias("vector")]
    held = classes.select("dim", F.pmod(F.xxhash64("h1", F.lit(seed)), F.lit(blocks)).cast("int")
                          .alias("block"), F.lit(0).alias("query"), *columns)
    sent = asking.select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                         F.lit(1).alias("query"), *columns)
    ship_package(vectors.sparkSession)
    # One task per block, so that no task's index waits behind another.
    offers = held.union(sent).repartition(blocks, "dim", "block").sortWithinPartitions(
        "dim", "block", "query").mapInArrow(
        _search(want, projections, first_radius, growth, seed), OFFERS)
    best = W.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0])
    kept = offers.withColumn("place", F.row_number().over(best)).where(F.col("place") <= want)
    per_query = W.partitionBy("id", *key).orderBy(F.desc("score"), "vec_id")
    return asked.join(kept.select(F.col("q1").alias("h1"), F.col("q2").alias("h2"), "ids", "score"),
                      key).select("id", *key, F.explode("ids").alias("vec_id"), "score").where(
        "vec_id != id").withColumn("rank", F.row_number().over(per_query)).where(
        F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")
