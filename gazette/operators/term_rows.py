"""Terms per document as one array column, and row-wise weights from it.

A text is shuffled once, by document; its terms are counted there and stay together as one row,
``id, label, fold, terms``. What travels afterwards is one pre-aggregated row per term and task
(document frequencies of all folds at once). Weights and norms are made within a row: the
vocabulary of a setting and fold comes along as a broadcast index, behind a check of its size,
and Arrow looks the terms up. No row of ``(id, term)`` is ever exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.operators.linear import slices_of
from gazette.operators.terms import TermSettings, limit_terms, term_counts
from gazette.shipping import ship_package
from gazette.sources.scratch import new_path, wide, written

# The largest vocabulary that is broadcast. A vocabulary is bounded by (mean distinct terms of a
# document) / min_df, whatever the corpus; one beyond this needs the joins of ``vectors``.
MOST_TERMS = 4_000_000
CELLS_PER_TASK = 8 << 20
TERMS = "array<struct<term:string,tf:bigint>>"


class VocabularyTooLarge(ValueError):
    """More terms than are broadcast."""


def term_rows(docs: DataFrame, settings: TermSettings, text: str = "description") -> DataFrame:
    """``id, terms`` of every document that has terms, in the order of the terms."""
    counts = term_counts(docs, settings, text)
    return counts.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("terms"))


def marked_terms(docs: DataFrame, marks: DataFrame, settings: TermSettings,
                 text: str = "description") -> DataFrame:
    """``marks`` with ``terms``, as a written table; no terms: an empty array.

    Spark takes an array for one element when it guesses sizes, and would broadcast the terms.
    """
    rows = marks.join(term_rows(docs, settings, text).hint("merge"), "id", "left")
    return written(rows.withColumn("terms", F.coalesce("terms", F.array().cast(TERMS))), "terms",
                   long_rows=True)


def fold_frequencies(table: DataFrame, train: Column, folds: Sequence[int]) -> DataFrame:
    """``term, df, total, df_<fold>..., total_<fold>...`` over the training rows, written.

    What a vocabulary without one fold needs is the whole minus that fold's share, so the terms
    are counted once for all folds.
    """
    cells = table.where(train).select("fold", F.explode("terms").alias("t")).select("fold", "t.*")
    own = {f: F.col("fold") == f for f in folds}
    sums = [F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"),
            *[F.count_if(c).alias(f"df_{f}") for f, c in own.items()],
            *[F.sum(F.when(c, F.col("tf")).otherwise(0)).alias(f"total_{f}")
              for f, c in own.items()]]
    return written(cells.groupBy("term").agg(*sums), "frequencies")


@dataclass(frozen=True)
class Vocabulary:
    """Terms in order with their ``idf``; the place of a term is its feature."""

    terms: pa.Array
    idf: np.ndarray

    @property
    def size(self) -> int:
        return len(self.terms)


def fold_vocabulary(frequencies: DataFrame, n: int, settings: TermSettings,
                    without: int | None = None) -> Vocabulary:
    """The vocabulary of the training rows outside the fold ``without``; ``n`` counts them."""
    df, total = F.col("df"), F.col("total")
    if without is not None:
        df, total = df - F.col(f"df_{without}"), total - F.col(f"total_{without}")
    rest = frequencies.select("term", df.alias("df"), total.alias("total")).where("df > 0")
    return vocabulary_of(limit_terms(rest, F.lit(n), settings), n)


def vocabulary_of(terms: DataFrame, n: int) -> Vocabulary:
    """From ``term, df``; checked before it is gathered whole."""
    found = terms.select("term", "df").limit(MOST_TERMS + 1).toArrow().sort_by("term")
    if found.num_rows > MOST_TERMS:
        raise VocabularyTooLarge(f"more than {MOST_TERMS} terms: raise min_df or set max_features")
    df = found.column("df").to_numpy()
    names = found.column("term").combine_chunks()
    names = names if isinstance(names, pa.Array) else pa.array([], pa.string())
    return Vocabulary(names, np.log((1 + n) / (1 + df)) + 1)


def weigh(row: np.ndarray, index: np.ndarray, tf: np.ndarray, n: int, vocabulary: Vocabulary,
          settings: TermSettings) -> np.ndarray:
    """Weights of known terms: TF-IDF with rows of length 1, or raw counts."""
    if not settings.tfidf:
        return tf.astype(float)
    raw = ((1 + np.log(tf)) if settings.sublinear else tf) * vocabulary.idf[index]
    return raw / np.sqrt(np.bincount(row, raw * raw, n))[row]


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Values in the order of their rows as one list per row."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _vectors(terms: pa.Array, vocabulary: Vocabulary, settings: TermSettings
             ) -> tuple[pa.Array, pa.Array]:
    """``indices, values`` of each row; terms in order give indices in order."""
    n = len(terms)
    row = np.repeat(np.arange(n), terms.value_lengths().to_numpy(zero_copy_only=False))
    cells = terms.flatten()
    found = pc.index_in(cells.field("term"), value_set=vocabulary.terms).fill_null(-1).to_numpy(
        zero_copy_only=False)
    known = found >= 0
    row, index = row[known], found[known].astype(np.int32)
    tf = cells.field("tf").to_numpy(zero_copy_only=False)[known]
    return _lists(row, index, n), _lists(row, weigh(row, index, tf, n, vocabulary, settings), n)


def vector_rows(table: DataFrame, vocabularies: Mapping[int, Vocabulary], settings: TermSettings,
                keep: Sequence[str] = ("id", "label", "fold"), holdout: int | None = None
                ) -> DataFrame:
    """``part, keep..., indices, values``: every row once per vocabulary, in its own features.

    Rows of the fold ``holdout`` are left out of the parts of other numbers.
    """
    shared = table.sparkSession.sparkContext.broadcast(dict(vocabularies))
    schema = T.StructType([T.StructField("part", T.IntegerType()),
                           *[table.schema[c] for c in keep],
                           *T.StructType.fromDDL("indices array<int>, values array<double>")])
    fold = list(keep).index("fold") if "fold" in keep else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for piece in slices_of(batch, "terms"):
                for part, vocabulary in shared.value.items():
                    own = piece
                    if holdout is not None and part != holdout:
                        own = piece.filter(pc.not_equal(piece.column(fold), holdout))
                    if not own.num_rows:
                        continue
                    indices, values = _vectors(own.column(own.num_columns - 1), vocabulary,
                                               settings)
                    columns = [pa.array([part] * own.num_rows, pa.int32()), *own.columns[:-1],
                               indices, values]
                    yield pa.RecordBatch.from_arrays(
                        [c.cast(f.type) for c, f in zip(columns, target, strict=True)],
                        schema=target)

    ship_package(table.sparkSession)
    return table.select(*keep, "terms").mapInArrow(run, schema)


def written_parts(rows: DataFrame, parts: Sequence[int]) -> dict[int, DataFrame]:
    """Write vector rows once, one folder a part, and read each part back in tasks of a bounded
    number of cells, so that a scan's task holds sums of one part only."""
    spark = rows.sparkSession
    path = new_path(spark, "features")
    wide(rows).partitionBy("part").parquet(path)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "part"])
    stored = spark.read.schema(T.StructType([*schema.fields, T.StructField(
        "part", T.IntegerType())])).parquet(path)
    cells = {r["part"]: r["cells"] for r in stored.groupBy("part").agg(
        F.sum(F.size("indices") + 1).alias("cells")).collect()}
    out = {}
    for part in parts:
        tasks = -(-cells.get(part, 1) // CELLS_PER_TASK)
        if part not in cells:
            out[part] = spark.createDataFrame([], rows.schema)
            continue
        out[part] = spark.read.schema(schema).parquet(f"{path}/part={part}").coalesce(
            tasks).select(F.lit(part).alias("part"), *schema.names)
    return out
