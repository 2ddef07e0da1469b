from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gazette.operators import ensemble, evaluation as E


def cells(spark, tn, fp, fn, tp):
    """Prediction rows with the given confusion counts, made by Spark."""
    parts = [(0, 0, tn), (0, 1, fp), (1, 0, fn), (1, 1, tp)]
    frame = spark.createDataFrame(parts, "y_true INT, y_pred INT, n INT")
    return frame.select("y_true", "y_pred", F.explode(F.array_repeat(F.lit(1), F.col("n")))).drop(
        "col")


@pytest.mark.parametrize("tn,fp,fn,tp,f1,accuracy", [
    (1727, 300, 340, 1497, 0.823886, 0.834369),
    (896, 199, 112, 2657, 0.944711, 0.919513),
    (1139, 888, 55, 1782, 0.790770, 0.755952),
    (1009, 1018, 35, 1802, 0.773889, 0.727484),
    (1279, 748, 94, 1743, 0.805453, 0.782091),
    (5, 0, 0, 0, 0.0, 1.0)])
def test_published_scores(spark, tn, fp, fn, tp, f1, accuracy):
    row = E.f1_scores(cells(spark, tn, fp, fn, tp)).first()
    assert row["f1"] == pytest.approx(f1, abs=1e-6)
    assert row["accuracy"] == pytest.approx(accuracy, abs=1e-6)
    run = E.run_scores(cells(spark, tn, fp, fn, tp)).first()
    assert run["n_samples"] == tn + fp + fn + tp
    assert run["positive_rate"] == pytest.approx((fn + tp) / (tn + fp + fn + tp))


def test_published_report(spark):
    rows = {r["class"]: r for r in
            E.classification_report(cells(spark, 1727, 300, 340, 1497)).collect()}
    want = {
        "0": (0.835510, 0.851998, 0.843674, 2027), "1": (0.833055, 0.814916, 0.823886, 1837),
        "accuracy": (0.834369,) * 4, "macro avg": (0.834283, 0.833457, 0.833780, 3864),
        "weighted avg": (0.834343, 0.834369, 0.834266, 3864)}
    assert set(rows) == set(want)
    for name, values in want.items():
        got = [rows[name][c] for c in ("precision", "recall", "f1_score", "support")]
        assert got == pytest.approx(values, abs=1e-6)


def test_report_of_more_labels(spark):
    frame = spark.createDataFrame([(0, 0), (2, 1), (2, 2), (1, 1)], "y_true INT, y_pred INT")
    rows = {r["class"]: r for r in E.classification_report(frame).collect()}
    assert rows["2"]["recall"] == 0.5 and rows["1"]["precision"] == 0.5
    assert rows["accuracy"]["support"] == 0.75


RANKED = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.4), (1, 0.3), (0, 0.1)]


def test_published_areas(spark):
    frame = spark.createDataFrame(RANKED, "y_true INT, score DOUBLE")
    assert E.roc_auc(frame).first()[0] == pytest.approx(0.722222, abs=1e-6)
    assert E.average_precision(frame).first()[0] == pytest.approx(0.755556, abs=1e-6)


def scored_rows(seed, n=300):
    rng = random.Random(seed)
    return [(i, int(rng.random() < 0.7), 0.5 if rng.random() < 0.3 else round(rng.random(), 2))
            for i in range(n)]


def brute_auc(rows):
    pos = [s for _, y, s in rows if y == 1]
    neg = [s for _, y, s in rows if y == 0]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [1, 2, 7])
def test_curves_against_brute_force(spark, buckets):
    rows = scored_rows(buckets)
    frame = spark.createDataFrame(rows, "id INT, y_true INT, score DOUBLE")
    assert E.roc_auc(frame, buckets=buckets).first()[0] == pytest.approx(brute_auc(rows))
    full = sorted((r["fpr"], r["tpr"]) for r in
                  E.roc_points(frame, drop_intermediate=False, buckets=buckets).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(full, full[1:]))
    assert area == pytest.approx(brute_auc(rows))
    # Without the points inside straight runs, by the rule on second differences.
    scores = sorted({s for _, _, s in rows}, reverse=True)
    steps = [(sum(y == 1 and s == x for _, y, s in rows), sum(y == 0 and s == x for _, y, s in rows))
             for x in scores]
    keep = [i for i in range(len(steps))
            if i in (0, len(steps) - 1) or steps[i] != steps[i + 1]]
    kept = [r["threshold"] for r in E.roc_points(frame, buckets=buckets).collect()]
    assert sorted(kept, reverse=True) == [float("inf")] + [scores[i] for i in keep]
    points = E.pr_points(frame, buckets=buckets).collect()
    assert len(points) == len(scores) + 1
    ordered = sorted((r for r in points if r["threshold"] is not None),
                     key=lambda r: -r["threshold"])
    ap, last = 0.0, 0.0
    for r in ordered:
        ap += (r["recall"] - last) * r["precision"]
        last = r["recall"]
    assert E.average_precision(frame, buckets=buckets).first()[0] == pytest.approx(ap)


def test_single_class(spark):
    frame = spark.createDataFrame([(1, 1, 0.3), (1, 0, 0.2)], "y_true INT, y_pred INT, score DOUBLE")
    assert E.roc_auc(frame).first()[0] is None
    assert E.balanced_accuracy(frame).first()[0] == 0.5
    assert E.average_precision(frame).first()[0] == 1.0


def test_error_tables(spark):
    rows = [(i, i % 2, 1 - i % 2, i / 10, None, "a  b") for i in range(60)]
    frame = spark.createDataFrame(
        rows, "id INT, y_true INT, y_pred INT, score DOUBLE, headline STRING, description STRING")
    fp = E.error_table(frame, "fp").collect()
    fn = E.error_table(frame, "fn").collect()
    assert [r["id"] for r in fp] == list(range(58, 18, -2))
    assert [r["id"] for r in fn] == list(range(1, 41, 2))
    assert fp[0]["headline_short"] is None and fp[0]["description_short"] == "a b"
    with pytest.raises(ValueError):
        E.error_table(frame, "tp")


def test_published_summaries(spark):
    log = spark.createDataFrame(
        [("a", 0.89), ("a", 0.886616), ("b", 0.739437), (None, 0.1), ("c", None)],
        "model STRING, f1 DOUBLE")
    rows = {r["model"]: r for r in E.score_summary(log).collect()}
    assert rows["b"]["std"] == 0 and rows["b"]["count"] == 1
    assert rows["a"]["std"] == pytest.approx((0.89 - 0.886616) / 2 ** 0.5)
    assert set(rows) == {"a", "b", "c"} and rows["c"]["count"] == 0
    domestic = spark.createDataFrame([("gpt-5.1", x) for x in (0.890098, 0.890098, 0.886616)],
                                     "model STRING, f1 DOUBLE")
    row = E.score_summary(domestic).first()
    assert (row["f1"], row["std"]) == (pytest.approx(0.888937, abs=1e-6),
                                       pytest.approx(0.002010, abs=1e-6))


@pytest.mark.parametrize("f1,best", [((0.942655, 0.958949, 0.957512), 3864),
                                     ((0.844751, 0.854756, 0.857752), 5796)])
def test_best_epoch(spark, f1, best):
    rows = [(1932 * (i + 1), v, None) for i, v in enumerate(f1)]
    rows += [(5796, max(f1), None), (50, None, 0.6)]
    log = spark.createDataFrame(rows, "step INT, eval_f1 DOUBLE, loss DOUBLE")
    assert E.best_epoch(log).first()["best_step"] == best
    assert E.loss_curve(log).count() == 1 and E.eval_curve(log).count() == 4


def votes(spark, columns):
    rows = [(i, 1, f"m{m}", y) for m, ys in enumerate(columns) for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, "id INT, y_true INT, model STRING, y_pred INT")


def test_two_member_vote_is_its_primary(spark):
    got = ensemble.majority_vote(votes(spark, [[1, 0, 1, 0], [1, 0, 0, 1]]), "m0")
    assert [r["y_pred"] for r in got.orderBy("id").collect()] == [1, 0, 1, 0]


def test_three_member_vote(spark):
    got = ensemble.majority_vote(votes(spark, [[1, 0, 0], [1, 0, 1], [0, 1, 1]]), "m0")
    assert [r["y_pred"] for r in got.orderBy("id").collect()] == [1, 0, 1]


def test_member_selection(spark):
    log = spark.createDataFrame(
        [("tfidf_log_reg", 0.82), ("count_linear_svm", 0.77), ("tfidf_naive_bayes", 0.9),
         ("tfidf_linear_svm", 0.81)], "model STRING, f1 DOUBLE")
    two = {r["model"] for r in ensemble.top_linear(log, 7, max_members=2).filter("selected_for_ensemble").collect()}
    assert two == {"tfidf_log_reg", "tfidf_linear_svm"}
    three = ensemble.top_linear(log, 3, max_members=None).filter("selected_for_ensemble")
    assert three.count() == 3
    row = ensemble.ensemble_row(ensemble.top_linear(log, 7, max_members=2)).first()
    assert row["members"] == ["tfidf_log_reg", "tfidf_linear_svm"] and row["top_k_used"] == 2
    unknown = ensemble.unknown_models(log, ["tfidf_log_reg", "bert"])
    assert [r[0] for r in unknown.collect()] == ["bert"]
