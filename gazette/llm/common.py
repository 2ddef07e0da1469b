"""Shared by the operators: tables, texts in bounded Arrow slices, spans, seeded hashes."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.shipping import ship_package

# Python works on so many rows of an Arrow batch at a time, whatever the batch holds.
SLICE_ROWS = 256
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
SPANS = f"array<{SPAN}>"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` alone, so other columns never travel; a NULL text is the empty text."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def with_results(frame: DataFrame, work: Callable[[list[str]], dict[str, list]], added: str,
                 text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns of each row plus what ``work`` finds for its text.

    ``added`` is a DDL list of the new columns; ``work`` maps a list of texts to one list per new
    column. Rows never leave their partition. A NULL text is passed as the empty text.
    """
    kept = list(frame.columns if keep is None else keep)
    source = frame.select(*dict.fromkeys([*kept, text_col]))
    schema = T.StructType([*source.select(*kept).schema, *T.StructType.fromDDL(added)])
    at = source.columns.index(text_col)
    places = [source.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for part in slices(batches):
            texts = [t or "" for t in part.column(at).to_pylist()]
            found = work(texts)
            columns = [part.column(i) for i in places]
            for name in target.names[len(places):]:
                columns.append(pa.array(found[name], target.field(name).type))
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    ship_package(source.sparkSession)
    return source.mapInArrow(run, schema)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined; the empty string for none."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def sorted_spans(*parts: Column) -> Column:
    """By start, then by the rank of the kind."""
    return F.array_sort(F.concat(*parts))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; distinct inputs stay distinct."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of the words of a text; hashes of frequent words are remembered.

    Words are the runs of characters outside ``\\x20\\x09-\\x0D``, A-Z in lower case.
    """

    def __init__(self, most: int = 50_000):
        self.most, self.known = most, {}

    def words(self, text: str) -> list[bytes]:
        return text.encode("utf-8", "replace").lower().split()

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        if len(self.known) > self.most:
            self.known = {}
        known, get = self.known, self.known.get
        out = []
        for word in words:
            code = get(word)
            if code is None:
                code = known[word] = xxh3_64_intdigest(word)
            out.append(code)
        return np.array(out, np.uint64)


def shingle_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; fewer words make one run of all, none make nothing."""
    if not len(codes):
        return codes
    n = min(n, len(codes))
    out = codes[:len(codes) - n + 1].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out * GOLDEN) + codes[k:len(codes) - n + 1 + k]
        return mix(out + np.uint64(n))


class Covered:
    """What a list of spans covers, for overlap tests in logarithmic time."""

    def __init__(self, spans: Sequence[tuple]):
        self.starts, self.ends = [], []
        for start, _, end, _ in sorted(spans):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at >= 0 and self.ends[at] > start


@contextmanager
def small_batches(spark: SparkSession, rows: int = 4 * SLICE_ROWS) -> Iterator[None]:
    """What is executed inside passes at most so many rows at a time to Python: for rows that
    carry whole sets, of which Spark's usual batch holds tens of megabytes on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(usual)) if int(usual) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, usual)


def in_blocks(rows: DataFrame, keys: Sequence[str], member: str, size: int, salt: int = 17,
              own: bool = False) -> DataFrame:
    """Rows of buckets with two or more rows, dealt into blocks of bounded size.

    A bucket (equal ``keys``) of up to ``size`` rows is one block. A larger one is cut into chunks
    by the hash of ``member``, and every pair of chunks is a block (``lo``, ``hi``), so each pair
    of its rows meets in some block whatever the size, and no task holds a whole bucket.
    ``chunk`` tells which side a row is on. ``salt`` deals the chunks anew. With ``own`` a chunk
    is a block by itself and meets no other, so a row is dealt once.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1")
    parts = F.ceil(F.col("in_bucket") / F.lit(size)).cast("int")
    dealt = rows.join(sizes, list(keys)).withColumn(
        "chunk", F.pmod(F.xxhash64(member, F.lit(salt)), parts).cast("int"))
    if own:
        return dealt.withColumns({"lo": F.col("chunk"), "hi": F.col("chunk")}).drop("in_bucket")
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).withColumns({
        "lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other"),
    }).drop("other", "in_bucket")


def over_blocks(rows: DataFrame, keys: Sequence[str], work: Callable, schema: str) -> DataFrame:
    """``work`` on each group of rows that agree in ``keys``, many groups to a task.

    ``work`` takes one Arrow table per group and returns a dict of columns, or None for nothing.
    """
    keys = list(keys)
    fields = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        out: list[dict] = []

        def packed() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([o[n] for o in out]), target.field(n).type)
                       for n in target.names]
            return pa.RecordBatch.from_arrays(columns, schema=target)

        for group in _groups(batches, keys):
            found = work(group)
            if found is not None:
                out.append(found)
            if len(out) >= 4096:
                yield packed()
                out.clear()
        if out:
            yield packed()

    ship_package(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, fields)


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys; the last run of a batch may go on in the next."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        rest = part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
        marks = np.zeros(rest.num_rows, bool)
        for key in keys:
            value = rest.column(key).to_numpy()
            marks[1:] |= value[1:] != value[:-1]
        cuts = [0, *np.flatnonzero(marks).tolist()]
        for start, end in zip(cuts, cuts[1:]):
            yield rest.slice(start, end - start)
        rest = rest.slice(cuts[-1])
    if rest is not None:
        yield rest
