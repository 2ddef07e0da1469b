"""Multinomial naive Bayes as aggregates and joins over weighted terms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions.labels import first_argmax
from gazette.sources.scratch import written

CLASSES = (0, 1)


@dataclass(frozen=True)
class NaiveBayes:
    """``terms``: one row per vocabulary term with ``log_prob_<class>``. ``priors``: one row."""

    terms: DataFrame
    priors: DataFrame
    classes: tuple[int, ...]


def term_sums(weighted: DataFrame, labels: DataFrame, classes: Sequence[int] = CLASSES
              ) -> DataFrame:
    """``term, sum_<class>...``: weight mass per class, as a written table of vocabulary size."""
    rows = weighted.select("id", "term", "weight").join(labels.select("id", "label"), "id")
    mass = [F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0.0)).alias(f"sum_{c}")
            for c in classes]
    return written(rows.groupBy("term").agg(*mass), "term-sums")


def log_priors(labels: DataFrame, classes: Sequence[int] = CLASSES) -> DataFrame:
    """Log share of each class, unsmoothed."""
    return labels.agg(*[F.log(F.count_if(F.col("label") == c) / F.count("*")).alias(f"prior_{c}")
                        for c in classes])


def from_sums(sums: DataFrame, priors: DataFrame, alpha: float = 1.0,
              classes: Sequence[int] = CLASSES) -> NaiveBayes:
    """Smooth the sums; several values of ``alpha`` can share one table of sums."""
    whole = sums.agg(F.count("*").alias("terms"),
                     *[F.sum(f"sum_{c}").alias(f"sum_{c}") for c in classes])

    def log_prob(c: int):
        mass = whole.select(F.col(f"sum_{c}") + alpha * F.col("terms")).scalar()
        return F.log(F.col(f"sum_{c}") + F.lit(alpha)) - F.log(mass)

    terms = sums.select("term", *[log_prob(c).alias(f"log_prob_{c}") for c in classes])
    return NaiveBayes(terms, priors, tuple(classes))


def train(weighted: DataFrame, labels: DataFrame, alpha: float = 1.0,
          classes: Sequence[int] = CLASSES) -> NaiveBayes:
    return from_sums(term_sums(weighted, labels, classes), log_priors(labels, classes), alpha,
                     classes)


def predict(model: NaiveBayes, docs: DataFrame, weighted: DataFrame) -> DataFrame:
    """``docs`` with ``y_pred`` and ``score`` (log odds of class 1); no known term: the prior."""
    hits = weighted.select("id", "term", "weight").join(model.terms, "term")
    likelihood = hits.groupBy("id").agg(
        *[F.sum(F.col("weight") * F.col(f"log_prob_{c}")).alias(f"_ll_{c}")
          for c in model.classes])
    joint = [F.coalesce(F.col(f"_ll_{c}"), F.lit(0.0)) + model.priors.select(f"prior_{c}").scalar()
             for c in model.classes]
    rows = docs.join(likelihood, "id", "left").withColumn("_joint", F.array(*joint))
    place = first_argmax(F.col("_joint"))
    y_pred = F.element_at(F.array(*[F.lit(c) for c in model.classes]), place + 1)
    out = rows.withColumn("y_pred", y_pred)
    if len(model.classes) == 2:
        out = out.withColumn("score", F.col("_joint")[1] - F.col("_joint")[0])
    return out.drop("_joint", *[f"_ll_{c}" for c in model.classes])


# --------------------------------------------------------------------------- on stored vectors

def class_sums(rows: DataFrame, sizes: Mapping[int, int]
               ) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Part -> weight mass of every feature in class 0 and class 1.

    ``rows``: ``part, label, indices, values``; one pre-aggregated row per part and feature
    travels, and the bounded vocabulary is gathered.
    """
    cells = rows.select("part", "label", F.explode(F.arrays_zip("indices", "values")).alias("c"))
    one = F.col("label") == 1
    sums = cells.groupBy("part", F.col("c.indices").alias("index")).agg(
        F.sum(F.when(one, 0.0).otherwise(F.col("c.values"))).alias("sum_0"),
        F.sum(F.when(one, F.col("c.values")).otherwise(0.0)).alias("sum_1")).toArrow()
    part, index = sums.column("part").to_numpy(), sums.column("index").to_numpy()
    out = {}
    for p, size in sizes.items():
        both = []
        for name in ("sum_0", "sum_1"):
            mass = np.zeros(size)
            mass[index[part == p]] = sums.column(name).to_numpy()[part == p]
            both.append(mass)
        out[p] = (both[0], both[1])
    return out


def log_odds(sum_0: np.ndarray, sum_1: np.ndarray, class_counts: Mapping[int, int],
             alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """The model as weights and intercept of a linear decision for class 1."""
    def log_probs(mass: np.ndarray) -> np.ndarray:
        return np.log(mass + alpha) - np.log(mass.sum() + alpha * len(mass))

    ones = class_counts.get(1, 0)
    others = sum(class_counts.values()) - ones
    with np.errstate(divide="ignore"):
        prior = float(np.log(ones) - np.log(others))
    return log_probs(sum_1) - log_probs(sum_0), prior
