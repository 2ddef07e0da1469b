"""Sparse feature vectors for Spark ML out of weighted terms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.operators.ordering import position_in_order
from gazette.operators.splits import hash_number
from gazette.operators.terms import TermSettings, fit_vocabulary, term_weights
from gazette.sources.scratch import new_path, wide, written

SPARSE = 0  # the tag of a sparse vector in a stored vector column


@dataclass(frozen=True)
class Vectorizer:
    """A fitted vocabulary with a dense index; ``size`` is the vector length."""

    settings: TermSettings
    vocabulary: DataFrame
    size: int


def fit_vectorizer(train_counts: DataFrame, n: int, settings: TermSettings) -> Vectorizer:
    """Learn the vocabulary from training counts and number its terms."""
    vocabulary = fit_vocabulary(train_counts, n, settings)
    keyed = vocabulary.select("term", "idf").withColumn("_key", hash_number(F.col("term"), "index"))
    placed = position_in_order(keyed, "_key", tie="term", position="place", buckets=8)
    indexed = written(placed.select("term", "idf", (F.col("place") - 1).cast("int").alias("index")),
                      "index")
    return Vectorizer(settings, indexed, indexed.count())


def sparse_rows(counts: DataFrame, vectorizer: Vectorizer) -> DataFrame:
    """``id, features`` with the stored layout of a sparse vector, one row per document that
    has a known term. Only one document's terms are ever grouped."""
    weighted = term_weights(counts, vectorizer.vocabulary, vectorizer.settings)
    entries = weighted.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("e"))
    return entries.select("id", _layout(
        F.transform("e", lambda x: x["index"]), F.transform("e", lambda x: x["weight"]),
        vectorizer.size).alias("features"))


def _layout(indices, values, size: int):
    return F.struct(F.lit(SPARSE).cast("byte").alias("type"), F.lit(size).alias("size"),
                    indices.alias("indices"), values.alias("values"))


@dataclass(frozen=True)
class FeatureTable:
    """One written table, read in two ways: ``features`` as vectors for Spark ML, and as the
    plain struct with ``indices`` and ``values``. ``size`` is the vector length."""

    vectors: DataFrame
    arrays: DataFrame
    size: int


def category_index(train: DataFrame, column: str) -> DataFrame:
    """``column, index``: the training categories in order. A category missing here becomes
    the zero vector. Categories are few (years), so numbering them is one small task."""
    order = W.orderBy(column)
    return train.select(column).distinct().withColumn(
        "index", (F.row_number().over(order) - 1).cast("int"))


def one_hot(rows: DataFrame, column: str, index: DataFrame, size: int) -> DataFrame:
    """``id, features`` for the rows whose category is known."""
    known = rows.select("id", column).join(index, column)
    return known.select("id", _layout(F.array("index"), F.array(F.lit(1.0)), size)
                        .alias("features"))


def _shifted(indices, by: int):
    return indices if by == 0 else F.transform(indices, lambda x: x + F.lit(by))


def write_features(rows: DataFrame, parts: Sequence[tuple[DataFrame, int]],
                   keep: Sequence[str]) -> FeatureTable:
    """Write ``keep`` columns of ``rows`` and ``features``: the parts side by side.

    A part is ``(id, features) rows, size``; a row without a part has zeros there. A stored
    vector column is a struct, so Spark reads the vectors without any Python, parts are laid
    side by side by shifting indices, and every fit reads the same table.
    """
    table = rows.select(*dict.fromkeys(["id", *keep]))
    indices, values, width = [], [], 0
    for i, (part, size) in enumerate(parts):
        table = table.join(part.withColumnRenamed("features", f"_part{i}"), "id", "left")
        indices.append(_shifted(
            F.coalesce(F.col(f"_part{i}.indices"), F.array().cast("array<int>")), width))
        values.append(F.coalesce(F.col(f"_part{i}.values"), F.array().cast("array<double>")))
        width += size
    features = _layout(F.concat(*indices), F.concat(*values), width)
    return _stored(table.select(*dict.fromkeys(["id", *keep]), features.alias("features")), width)


def sparse_layout(rows: DataFrame, size: int, keep: Sequence[str]) -> DataFrame:
    """``keep..., features`` from ``indices, values``."""
    return rows.select(*keep, _layout(F.col("indices"), F.col("values"), size).alias("features"))


def stored_features(rows: DataFrame, size: int, keep: Sequence[str]) -> FeatureTable:
    """Write rows that carry their ``indices, values`` already: nothing is joined or moved."""
    return _stored(sparse_layout(rows, size, keep), size)


def _stored(table: DataFrame, width: int) -> FeatureTable:
    spark = table.sparkSession
    path = new_path(spark, "features")
    wide(table).parquet(path)
    schema = T.StructType([
        T.StructField(f.name, VectorUDT() if f.name == "features" else f.dataType)
        for f in table.schema.fields])
    return FeatureTable(spark.read.schema(schema).parquet(path), spark.read.parquet(path), width)
