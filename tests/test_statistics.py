from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.functions import significance as P
from gazette.operators import eda


def test_p_values():
    # One degree of freedom has a closed form; so has Student's t with one or two.
    for chi2 in (0.01, 1.0, 13.44, 80.0):
        assert P.chi_square_p(chi2, 1) == pytest.approx(math.erfc(math.sqrt(chi2 / 2)), rel=1e-10)
        assert P.chi_square_p(chi2, 2) == pytest.approx(math.exp(-chi2 / 2), rel=1e-10)
    for r in (0.1, -0.5, 0.9):
        t = abs(r) / math.sqrt(1 - r * r)
        assert P.correlation_p(r, 3) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-10)
        t = abs(r) * math.sqrt(2 / (1 - r * r))
        assert P.correlation_p(r, 4) == pytest.approx(1 - t / math.sqrt(t * t + 2), rel=1e-10)
    # Large samples approach the normal distribution.
    assert P.correlation_p(0.01, 100_000) == pytest.approx(math.erfc(
        0.01 * math.sqrt(100_000) / math.sqrt(2)), rel=1e-3)
    assert P.correlation_p(1.0, 10) == 0.0 and P.correlation_p(None, 10) is None


def counted(spark, table):
    rows = [(a, b, n) for a, line in enumerate(table) for b, n in enumerate(line)]
    frame = spark.createDataFrame(rows, "a INT, b INT, n INT")
    return frame.select("a", "b", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop("col")


def test_chi_square_with_yates(spark):
    row = eda.chi_square(counted(spark, [[10, 20], [25, 5]]), "a", "b").first()
    assert row["chi2"] == pytest.approx(13.44) and row["dof"] == 1
    assert row["phi"] == pytest.approx(-0.473286, abs=1e-6)
    assert row["p"] == pytest.approx(math.erfc(math.sqrt(13.44 / 2)))


def test_chi_square_of_a_larger_table_and_empty_cells(spark):
    table = np.array([[10, 0, 5], [3, 7, 2]])
    row = eda.chi_square(counted(spark, table.tolist()), "a", "b").first()
    expected = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    assert row["chi2"] == pytest.approx(((table - expected) ** 2 / expected).sum())
    assert row["dof"] == 2
    corner = np.array([[12, 0], [6, 9]])
    expected = corner.sum(1, keepdims=True) * corner.sum(0, keepdims=True) / corner.sum()
    gap = np.abs(corner - expected)
    want = ((gap - np.minimum(0.5, gap)) ** 2 / expected).sum()
    got = eda.chi_square(counted(spark, corner.tolist()), "a", "b").first()["chi2"]
    assert got == pytest.approx(want)


def test_spearman(spark):
    rows = [(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (3.0, 1.0), (4.0, 5.0)]
    frame = spark.createDataFrame(rows, "x DOUBLE, y DOUBLE")
    row = eda.spearman(frame, ["y"], ["x"]).first()
    assert row["spearman_r"] == pytest.approx(0.289474, abs=1e-6) and row["n"] == 5


def test_class_weights(spark):
    frame = spark.range(60).select((F.col("id") < 45).cast("int").alias("y"))
    got = {r["label"]: r["weight"] for r in eda.class_weights(frame, "y").collect()}
    assert got == {1: pytest.approx(2 / 3), 0: 2.0}


def test_box_whiskers(spark):
    rows = [(0, float(v)) for v in [1, 2, 3, 4, 5, 100]] + [(1, 7.0)]
    frame = spark.createDataFrame(rows, "y INT, v DOUBLE")
    got = {r["y"]: r for r in eda.box_stats(frame, "v", "y").collect()}
    assert got[0]["whisker_high"] == 5.0 and got[0]["whisker_low"] == 1.0
    assert got[0]["q1"] == np.quantile([1, 2, 3, 4, 5, 100], 0.25)
    assert got[1]["median"] == 7.0


def test_constant_column_has_no_correlation(spark):
    frame = spark.createDataFrame([(1, 1.0), (1, 2.0)], "y INT, x DOUBLE")
    assert eda.spearman(frame, ["y"], ["x"]).first()["spearman_r"] is None
