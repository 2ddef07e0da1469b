"""Near-duplicate vectors by p-stable hashing, confirmed by exact cosines.

Vectors are scaled to length one. In each of ``tables`` hash tables, ``projections`` random normal
directions are drawn; a projection plus a random offset, divided by ``width`` and rounded down, is
one coordinate of the bucket. Vectors that share a bucket in any table are compared by their cosine
in double precision, and linked from ``threshold`` on.

For unit vectors a cosine of 0.95 is a distance of 0.316. At the default width of 1.265 one
projection keeps such a pair together with probability 0.80, eight of them with 0.17, and one of 24
tables does so with 0.988; closer pairs are found more surely (cosine 0.98: 0.99999).

Equal vectors are one class with a weight, so groups of exact copies cost one row. A bucket of any
size is dealt in blocks of chunk pairs (see ``in_blocks``); pairs never become rows: a block gives
each of its vectors the weight it is newly linked to, and one link towards its group in the block.
A pair that meets in several tables counts in the first only.

NULL vectors, vectors of length zero and vectors with NULL or non-finite components link with
nothing. Vectors of different dimensions are never compared. Rows that share an id are one vertex
of the graph; the vectors of rows without an id link with nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.llm.common import in_blocks, over_blocks, slices
from gazette.llm.components import components
from gazette.shipping import ship_package
from gazette.sources.scratch import written

TABLES, PROJECTIONS, WIDTH, SEED = 24, 8, 1.265, 20240
BLOCK = 1024


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length one in double precision, largest component first made 1."""
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def bucket_codes(unit: np.ndarray, tables: int, projections: int, width: float, seed: int
                 ) -> np.ndarray:
    """One 64-bit code per vector and table."""
    rng = np.random.default_rng([seed, unit.shape[1]])
    directions = rng.standard_normal((unit.shape[1], tables * projections))
    offsets = rng.uniform(0, width, tables * projections)
    cells = np.floor((unit @ directions + offsets) / width).astype(np.int64)
    codes = np.full((len(unit), tables), unit.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for p in range(projections):
            codes = (codes ^ cells[:, p::projections].astype(np.uint64)) * np.uint64(
                0x9E3779B97F4A7C15)
            codes ^= codes >> np.uint64(29)
    return codes.view(np.int64)


def _coded(classes: DataFrame, tables: int, projections: int, width: float, seed: int
           ) -> DataFrame:
    """Adds the codes of each class's vector."""
    schema = T.StructType(
        [*classes.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))])
    at = classes.columns.index("vector")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for part in slices(batches, 2048):
            vectors = part.column(at)
            sizes = vectors.value_lengths().to_numpy()
            codes: list = [None] * part.num_rows
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                unit = unit_rows(vectors.take(pa.array(rows)).to_pylist())
                for row, code in zip(rows, bucket_codes(unit, tables, projections, width, seed),
                                     strict=True):
                    codes[row] = code
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(codes, target.field("codes").type)], schema=target)

    ship_package(classes.sparkSession)
    return classes.mapInArrow(run, schema)


def _compare(threshold: float, tables: int):
    """What a block says: newly linked weight and a link towards the group, per vector."""

    def work(group: pa.Table) -> dict[str, np.ndarray] | None:
        n = group.num_rows
        if n < 2:
            return None
        table = group.column("tab")[0].as_py()
        cross = group.column("lo")[0].as_py() != group.column("hi")[0].as_py()
        rep = group.column("rep").to_numpy()
        weight = group.column("weight").to_numpy()
        unit = unit_rows(group.column("vector").to_pylist())
        codes = np.array(group.column("codes").to_pylist(), np.int64)
        chunk = group.column("chunk").to_numpy()
        near = unit @ unit.T >= threshold
        if cross:
            near &= chunk[:, None] != chunk
        np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        # A pair of an earlier table was counted there.
        fresh = ~(codes[i, :table] == codes[j, :table]).any(1)
        i, j = i[fresh], j[fresh]
        if not len(i):
            return None
        new = np.bincount(i, weight[j].astype(float), n).astype(np.int64)
        # The smallest partner of each vector keeps the block's pairs connected, as every other
        # pair is found by following them: see _spanning.
        to = _spanning(n, i, j)
        seen = np.flatnonzero(new)
        return {"rep": rep[seen], "linked": new[seen], "towards": rep[to[seen]]}

    return work


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n vertices the first vertex of its component of the pairs (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.95, tables: int = TABLES, projections: int = PROJECTIONS,
                    width: float = WIDTH, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``id_col, n_links, component_id, kept`` for every row of ``vectors``.

    ``n_links`` counts the other rows linked directly. ``kept`` marks the smallest id of a group,
    and every vector without links.
    """
    vector = F.col(vector_col)
    sound = (F.size(vector) > 0) & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(
        vector, lambda v: v != 0)
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.when(sound & F.col(id_col).isNotNull(), vector).alias("vector"))
    rows = rows.select("id", "vector", F.xxhash64("vector").alias("h1"),
                       F.xxhash64("vector", F.lit(1)).alias("h2"))
    key = ["h1", "h2"]
    classes = rows.where("vector IS NOT NULL").groupBy(*key).agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"),
        F.first("vector").alias("vector"))
    classes = written(_coded(classes, tables, projections, width, seed), "vectors")
    in_tables = classes.select("rep", "h1", "h2", F.posexplode("codes").alias("tab", "code"))
    dealt = in_blocks(in_tables, ["tab", "code"], "h1", block).join(
        classes.select("h1", "h2", "vector", "codes", "weight"), key)
    found = written(over_blocks(
        dealt, ["tab", "code", "lo", "hi"], _compare(threshold, tables),
        "rep bigint, linked bigint, towards bigint"), "near")
    group = components(found, "rep", "towards")
    linked = found.groupBy("rep").agg(F.sum("linked").alias("linked"))
    each = classes.select("rep", "weight", *key).join(linked, "rep", "left").join(
        group.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = each.select(
        *key, (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("id", *[F.when(F.col("vector").isNotNull(), F.col(c)).alias(c)
                              for c in key]).join(by_class, key, "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
