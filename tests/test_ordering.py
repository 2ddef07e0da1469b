from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.operators import ordering as O


def frame(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, g STRING, v DOUBLE")


def skewed(seed, n=400):
    """A third of all rows in one value, one group much larger than the other."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        value = 5.0 if rng.random() < 0.34 else round(rng.uniform(-20, 20), 1)
        rows.append((i, "a" if rng.random() < 0.8 else None, value))
    return rows


@pytest.mark.parametrize("buckets", [1, 3, 9])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_against_brute_force(spark, buckets, descending):
    rows = skewed(buckets)
    counts = O.value_counts(frame(spark, rows), "v", ["g"])
    got = O.running_totals(counts, "v", {"upto": F.col("n")}, ["g"], descending, buckets=buckets)
    for r in got.collect():
        same = [x for x in rows if x[1] == r["g"]]
        want = sum((x[2] >= r["v"]) if descending else (x[2] <= r["v"]) for x in same)
        assert r["upto"] == want


@pytest.mark.parametrize("buckets", [1, 5])
def test_positions(spark, buckets):
    rows = skewed(7)
    got = O.position_in_order(frame(spark, rows), "v", "id", ["g"], buckets=buckets).collect()
    for group in ("a", None):
        want = [r[0] for r in sorted((x for x in rows if x[1] == group), key=lambda x: (x[2], x[0]))]
        mine = [r["id"] for r in sorted((r for r in got if r["g"] == group),
                                        key=lambda r: r["position"])]
        assert mine == want


def test_average_ranks(spark):
    rows = [(i, "a", v) for i, v in enumerate([1.0, 1.0, 2.0, 3.0, 4.0])]
    got = {r["v"]: r["avg_rank"] for r in O.average_ranks(frame(spark, rows), "v").collect()}
    assert got == {1.0: 1.5, 2.0: 3.0, 3.0: 4.0, 4.0: 5.0}


@pytest.mark.parametrize("buckets", [1, 6])
def test_exact_quantiles(spark, buckets):
    rows = skewed(11)
    shares = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = O.exact_quantiles(frame(spark, rows), "v", shares, ["g"], buckets).collect()
    for r in got:
        values = [x[2] for x in rows if x[1] == r["g"]]
        for name, share in shares.items():
            assert r[name] == pytest.approx(np.quantile(values, share))
    small = frame(spark, [(i, "a", float(v)) for i, v in enumerate([1, 2, 3, 4])])
    assert O.exact_quantiles(small, "v", {"q": 0.25}).first()["q"] == 1.75


def test_empty_input(spark):
    assert O.average_ranks(frame(spark, []), "v").collect() == []
