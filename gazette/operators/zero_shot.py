"""Scoring texts against candidate labels without training.

The model behind it is a parameter: either vectors of texts and labels (cosine), or a function
that scores a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.shipping import ship_package

# Candidate labels per target; the first one is the positive label.
CANDIDATE_LABELS = {
    "political": ("political", "not political"),
    "domestic": ("domestic", "international"),
}


def label_pairs(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Every row once per candidate label (an array literal exploded, not a join)."""
    entries = [F.struct(F.lit(i).alias("label_index"), F.lit(name).alias("candidate"))
               for i, name in enumerate(labels)]
    return df.select("*", F.explode(F.array(*entries)).alias("_c")).select(
        *df.columns, "_c.label_index", "_c.candidate")


def best_label(pairs: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """The candidate with the highest score, the first listed on ties."""
    key = F.struct(F.col("score"), -F.col("label_index"))
    return pairs.groupBy(*by).agg(F.max_by("candidate", key).alias("candidate"),
                                  F.max("score").alias("score"))


def label_prototypes(df: DataFrame, vector: str, label: str) -> DataFrame:
    """``label, prototype``: mean vector per label; one partial sum per task and label travels."""
    values = array_to_vector(F.col(vector).cast("array<double>"))
    return df.where(F.col(vector).isNotNull()).groupBy(label).agg(
        vector_to_array(Summarizer.mean(values)).alias("prototype"))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")),
                           F.lit(0.0), lambda s, e: s + e)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_prototype(df: DataFrame, vector: str, prototypes: DataFrame, label: str,
                      by: Sequence[str] = ("id",)) -> DataFrame:
    """``by..., candidate, score``: the label whose prototype is most similar to the vector.

    There is one prototype per candidate label, so all of them travel as one array value; the
    pairs of a row are made and reduced in the task that holds the row.
    """
    listed = prototypes.agg(F.array_sort(F.collect_list(F.struct(label, "prototype")))).scalar()
    best = F.array_max(F.transform("_listed", lambda p, i: F.struct(
        cosine(F.col(vector), p["prototype"]).alias("score"), (-i).alias("order"),
        p[label].alias("candidate"))))
    return df.select(*by, vector, listed.alias("_listed")).select(
        *by, best.alias("_b")).select(*by, "_b.candidate", "_b.score")


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series],
                text: str = "description") -> DataFrame:
    """Score (text, candidate) pairs with a user's batch function; Arrow batches in and out."""

    @F.pandas_udf("double")
    def run(texts: pd.Series, candidates: pd.Series) -> pd.Series:
        return scorer(texts, candidates)

    return pairs.withColumn("score", run(F.col(text), F.col("candidate")))


def score_in_batches(pairs: DataFrame, make_scorer: Callable[[], Callable], batch_size: int = 256,
                     text: str = "description") -> DataFrame:
    """Score (text, candidate) pairs with a model that each Python worker loads once.

    ``make_scorer`` loads the model and returns a function of two arrays, the texts and the
    candidates of up to ``batch_size`` pairs; it may be a heavy import or a large file.
    """
    ship_package(pairs.sparkSession)
    run = predict_batch_udf(make_scorer, return_type=T.DoubleType(), batch_size=batch_size)
    return pairs.withColumn("score", run(F.col(text), F.col("candidate")))


def zero_shot(df: DataFrame, target: str, scorer: Callable[[pd.Series, pd.Series], pd.Series]
              ) -> DataFrame:
    """``id, y_pred``: 1 where the positive label wins."""
    labels = CANDIDATE_LABELS[target]
    scored = score_pairs(label_pairs(df.select("id", "description"), labels), scorer)
    return best_label(scored).select(
        "id", (F.col("candidate") == labels[0]).cast("int").alias("y_pred"))
