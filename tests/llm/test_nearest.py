from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazette.llm import nearest as N

DATA = "/root/testdata/sf0.01/embeddings.parquet"


def brute(rows, k=5, every=50):
    """query id -> [(id, cosine)], over rows (id, vector) of sound vectors with unique ids."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        scores = x @ x[at]
        order = [j for j in np.lexsort((ids, -np.round(scores, 12))) if j != at][:k]
        out[int(ids[at])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def lists(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = total = 0
    for query, expected in want.items():
        total += len(expected)
        # Any vector as near as the last wanted one is a right answer.
        least = expected[-1][1] - 1e-9
        hits += min(len(expected), sum(s >= least for _, s in got.get(query, [])))
    return hits / total


def run(spark, rows, **options):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return lists(N.nearest(frame, F.col("vec_id") % 50 == 0, **options))


def floats(x):
    return [[float(v) for v in row] for row in x.astype(np.float32)]


@pytest.mark.parametrize("block", [8192, 300])
def test_recall_on_random_and_clustered_vectors(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 32))
    x = np.concatenate([rng.standard_normal((1500, 32)),
                        centres[rng.integers(0, 40, 1500)] + 0.3 * rng.standard_normal((1500, 32))])
    rows = list(enumerate(floats(x)))
    got, want = run(spark, rows, block=block), brute(rows)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.95
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    for query, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        for other, score in found:
            assert other != query and abs(unit[query] @ unit[other] - score) < 1e-12


@pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables absent")
def test_recall_on_the_table(spark):
    frame = spark.read.parquet(DATA)
    rows = [(r.vec_id, list(r.embedding)) for r in frame.collect()]
    assert recall(lists(N.nearest(frame, F.col("vec_id") % 50 == 0)), brute(rows)) >= 0.9


def test_copies_tie_to_the_smaller_id(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(i, one) for i in range(400)] + [(1000, [1.0, 2.0, 3.5]), (1050, [-1.0, 0.0, 0.5])]
    got = run(spark, rows, block=100)
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [i for i, _ in got[50]] == [0, 1, 2, 3, 4]
    assert len({s for _, s in got[50]}) == 1
    assert [i for i, _ in got[1000]] == [0, 1, 2, 3, 4]
    assert len(got) == 10


def test_odd_vectors_few_candidates_and_clashing_names(spark):
    rows = [(0, [1.0, 0.0], "x"), (50, None, "x"), (100, [0.0, 0.0], "x"), (150, [1.0, None], "x"),
            (200, [float("nan"), 1.0], "x"), (250, [float("inf"), 1.0], "x"), (300, [], "x"),
            (None, [1.0, 0.0], "x"), (7, [1.0, 1.0], "x"), (8, [0.0, 2.0], "x"),
            (8, [0.0, 2.0], "x"), (9, [1.0, 0.0, 0.0], "x"), (350, [3.0, 0.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id string").select(
        "*", *[F.lit("x").alias(c) for c in ("block", "query", "score", "rank", "ids", "vector")])
    got = lists(N.nearest(frame, F.col("vec_id") % 50 == 0))
    assert {q: [i for i, _ in found] for q, found in got.items()} == {
        0: [350, 7, 8], 350: [0, 7, 8]}
    assert got[0][0][1] == pytest.approx(1) and got[0][2][1] == 0
    empty = frame.where("false")
    assert N.nearest(empty, F.col("vec_id") % 50 == 0).collect() == []
