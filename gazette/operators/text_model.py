"""A fitted text classifier that can be stored, read back and applied to new rows.

A model is one weight per term and an intercept: logistic regression, support vector machine and
naive Bayes alike. Applying it is row-wise: Spark cuts the text into grams, Arrow looks them up in
the broadcast vocabulary, and counts, TF-IDF and the norm are made within the row. No join, no
window and no shuffle, so the same ``transform`` serves tables and streams.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.text import char_ngrams, word_ngrams, word_tokens
from gazette.operators import training
from gazette.operators.candidates import LOG_REG, Candidate, Point
from gazette.operators.linear import slices_of
from gazette.operators.term_rows import Vocabulary, weigh
from gazette.operators.terms import CHAR_WB, TermSettings
from gazette.shipping import ship_package


def grams(text: Column, settings: TermSettings) -> Column:
    """All terms of a text, repeated as often as they occur."""
    if settings.analyzer == CHAR_WB:
        return char_ngrams(text, settings.low, settings.high)
    return word_ngrams(word_tokens(text, settings.stop_words), settings.low, settings.high)


@dataclass(frozen=True)
class TextModel:
    settings: TermSettings
    kind: str
    vocabulary: Vocabulary
    weights: np.ndarray
    intercept: float

    def save(self, spark: SparkSession, path: str) -> None:
        """Two tables below ``path``: the terms, and the rest as one row of JSON."""
        terms = pa.table({"term": self.vocabulary.terms, "idf": self.vocabulary.idf,
                          "weight": self.weights},
                         pa.schema([("term", pa.string()), ("idf", pa.float64()),
                                    ("weight", pa.float64())]))
        spark.createDataFrame(terms).write.mode("overwrite").parquet(f"{path}/terms")
        rest = json.dumps({"settings": asdict(self.settings), "kind": self.kind,
                           "intercept": float(self.intercept).hex()})
        spark.createDataFrame([(rest,)], "model string").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TextModel:
        """The saved model; its vocabulary is bounded like any that was learned."""
        rest = json.loads(spark.read.parquet(f"{path}/model").first()["model"])
        terms = spark.read.parquet(f"{path}/terms").toArrow().sort_by("term")
        settings = rest["settings"]
        if settings["stop_words"] is not None:
            settings["stop_words"] = tuple(settings["stop_words"])
        names = terms.column("term").combine_chunks()
        return TextModel(
            TermSettings(**settings), rest["kind"],
            Vocabulary(names if isinstance(names, pa.Array) else pa.array([], pa.string()),
                       terms.column("idf").to_numpy()),
            terms.column("weight").to_numpy(), float.fromhex(rest["intercept"]))

    def transform(self, rows: DataFrame, text: str = "description") -> DataFrame:
        """``rows`` with ``y_pred`` and ``score``: the probability of class 1 of a logistic
        regression, else the decision value. A NULL text has no terms; a text without a known
        term is decided by the intercept. Works on tables and on streams."""
        others = [c for c in rows.columns if c not in ("y_pred", "score")]
        schema = T.StructType([*[rows.schema[c] for c in others],
                               T.StructField("_z", T.DoubleType())])
        shared = rows.sparkSession.sparkContext.broadcast(self)
        n = len(others)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices_of(batch, "_grams"):
                    yield pa.RecordBatch.from_arrays(
                        [*piece.columns[:n], pa.array(shared.value.decide(piece.column(n)))],
                        names=[*others, "_z"])

        ship_package(rows.sparkSession)
        cut = grams(F.coalesce(F.col(text), F.lit("")), self.settings)
        scored = rows.select(*others, cut.alias("_grams")).mapInArrow(run, schema)
        z = F.col("_z")
        score = F.lit(1.0) / (1 + F.exp(-z)) if self.kind == LOG_REG else z
        return scored.withColumns({"y_pred": (z > 0).cast("int"), "score": score}).drop("_z")

    def decide(self, terms: pa.Array) -> np.ndarray:
        """Decision values of rows given as lists of grams."""
        n, size = len(terms), self.vocabulary.size
        row = np.repeat(np.arange(n), terms.value_lengths().to_numpy(zero_copy_only=False))
        found = pc.index_in(terms.flatten(), value_set=self.vocabulary.terms).fill_null(
            -1).to_numpy(zero_copy_only=False)
        known = found >= 0
        cells, tf = np.unique(row[known] * max(size, 1) + found[known], return_counts=True)
        row, index = np.divmod(cells, max(size, 1))
        weight = weigh(row, index, tf, n, self.vocabulary, self.settings)
        return self.intercept + np.bincount(row, weight * self.weights[index], n)


def fit(data: training.Data, candidate: Candidate, point: Point) -> TextModel:
    """Fit one point of a single-text candidate on all training rows."""
    if len(candidate.fields) != 1 or candidate.degree is not None:
        raise ValueError(f"{candidate.name} has more than the terms of one text")
    counts = training._all_counts(data, candidate, point.settings)
    parts, sizes = training._feature_parts(data, candidate, point.settings, counts, [None])
    model = training.fit_points(data, candidate, [point], [None], parts, sizes)[0, training.HOLDOUT]
    vocabulary = training._vocabulary(data, counts[candidate.fields[0]], point.settings, None)
    return TextModel(point.settings, candidate.kind, vocabulary, model.weights, model.intercept)
