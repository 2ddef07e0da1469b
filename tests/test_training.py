from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gazette import shipping
from gazette.operators import candidates as C
from gazette.operators import feature_sets, linear, term_rows, training, vectors
from gazette.operators import terms as T
from gazette.operators import sketch as sketches
from gazette.operators.sketch import sketch_rows

WORDS = T.TermSettings(min_df=0.01, max_df=1.0)


@pytest.fixture(autouse=True)
def few_iterations(monkeypatch, request):
    """The texts are easy; only the test of the optimum needs the solver to finish."""
    if "objective" not in request.node.name:
        monkeypatch.setattr(training, "MAX_ITER", 10)


def news(spark, n=120):
    """Texts whose words tell the label, with some noise, and a split."""
    i = F.col("id")
    label = (F.pmod(F.xxhash64(i), F.lit(3)) > 0).cast("int")
    noise = F.concat(F.lit(" w"), F.pmod(F.xxhash64(i, F.lit(1)), F.lit(9)).cast("string"))
    text = F.concat(F.when(label == 1, "minister votes law").otherwise("goal match team"), noise)
    return spark.range(n).select(
        "id", label.alias("label"), F.when(i % 4 == 0, "test").otherwise("train").alias("split"),
        text.alias("description"), F.lit("headline").alias("headline"),
        F.when(i % 4 == 0, "1999").otherwise("2000").alias("year"))


def points(**kwargs):
    return tuple(C.Point(WORDS, c=c, **kwargs) for c in (0.1, 10.0))


@pytest.mark.parametrize("kind", [C.LOG_REG, C.LINEAR_SVM, C.NAIVE_BAYES])
def test_search_and_refit(spark, kind):
    data = training.prepare(news(spark), k=3)
    trained = training.train(data, C.Candidate("m", kind, points()), seed=1)
    rows = trained.predictions.collect()
    assert len(rows) == 30 and {r["y_pred"] for r in rows} <= {0, 1}
    assert all(r["y_pred"] == r["label"] for r in rows)
    assert trained.cv_f1 == pytest.approx(1.0)
    assert trained.point == trained.point  # the first of the tied points
    log = training.metrics_rows([trained], {"cv": 3}).first()
    assert log["f1"] == 1.0 and log["best_params"]["analyzer"] == "word"


@pytest.mark.parametrize("kind", [C.LOG_REG, C.LINEAR_SVM])
def test_the_stated_objective_has_no_gradient_at_the_solution(spark, kind):
    """0.5 |w|^2 + C sum s_i loss(y z), with the intercept penalised for the squared hinge only."""
    data = training.prepare(news(spark), k=3)
    grid = tuple(C.Point(WORDS, c=c, balanced=b) for c in (0.1, 2.0, 30.0) for b in (False, True))
    model = C.Candidate("m", kind, grid)
    counts = training._all_counts(data, model, WORDS)
    parts, sizes = training._feature_parts(data, model, WORDS, counts, [None, 0, 1, 2])
    fitted = training.fit_points(data, model, grid, [None, 0, 1, 2], parts, sizes, 1e-9)
    assert len(fitted) == 24
    for (i, part), found in fitted.items():
        without = None if part == training.HOLDOUT else part
        rows = parts[part].where(training.train_rows(F.col("fold"), without)).collect()
        x = np.zeros((len(rows), sizes[part]))
        for r, row in enumerate(rows):
            x[r, row["indices"]] = row["values"]
        y = np.array([r["label"] for r in rows])
        weight = np.full(len(y), grid[i].c)
        if grid[i].balanced:
            weight *= len(y) / (2 * np.bincount(y)[y])
        sign = 2 * y - 1
        z = x @ found.weights + found.intercept
        if kind == C.LOG_REG:
            slope, bias = -weight * sign / (1 + np.exp(sign * z)), 0.0
        else:
            slope = -2 * weight * sign * np.maximum(1 - sign * z, 0)
            bias = found.intercept
        assert found.converged
        assert np.abs(found.weights + x.T @ slope).max() < 1e-4
        assert abs(bias + slope.sum()) < 1e-4


def test_features_need_no_exchange_of_terms(spark):
    data = training.prepare(news(spark), k=3)
    model = C.Candidate("m", C.LOG_REG, points()[:1])
    rows = term_rows.term_rows(data.texts, WORDS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == 1 and "term" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line)
    counted = training._counts_of(data, WORDS, "description")
    vocabulary = training._vocabulary(data, counted, WORDS, 0)
    vectors = term_rows.vector_rows(counted.table, {0: vocabulary}, WORDS, holdout=-1)
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()
    folds = {r["fold"] for r in vectors.select("fold").distinct().collect()}
    assert folds == {0, 1, 2}
    table = training.build_features(data, model, WORDS, {"description": counted}, 0)
    assert {r["fold"] for r in table.arrays.select("fold").distinct().collect()} == {0, 1, 2}


@pytest.mark.parametrize("settings", [
    T.TermSettings(low=1, high=2, min_df=0.02, max_df=0.8), T.TermSettings(min_df=0.02, tfidf=False),
    T.TermSettings(min_df=0.02, sublinear=False, max_features=7),
    T.TermSettings(analyzer=T.CHAR_WB, low=3, high=4, min_df=0.05)])
def test_row_wise_weights_equal_the_joined_ones(spark, settings):
    data = training.prepare(news(spark), k=3)
    counted = training._counts_of(data, settings, "description")
    for without in (None, 1):
        learn = training.train_rows(F.col("fold"), without)
        long = T.term_counts(data.texts, settings).join(data.marks.select("id", "fold"), "id")
        vocabulary = T.fit_vocabulary(long.where(learn).drop("fold"), data.train_size(without),
                                      settings)
        want = {(r["id"], r["term"]): r["weight"] for r in T.term_weights(
            long.drop("fold"), vocabulary, settings).collect()}
        found = training._vocabulary(data, counted, settings, without)
        names = found.terms.to_pylist()
        part = -1 if without is None else without
        got = {(r["id"], names[i]): v for r in term_rows.vector_rows(
            counted.table, {part: found}, settings).collect()
            for i, v in zip(r["indices"], r["values"])}
        assert set(got) == set(want) and len(got) > 100
        assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_a_vocabulary_too_large_to_broadcast_is_joined(spark, monkeypatch):
    data = training.prepare(news(spark), k=3)
    model = C.Candidate("m", C.LINEAR_SVM, points())
    want = training.grid_scores(data, model)
    monkeypatch.setattr(term_rows, "MOST_TERMS", 3)
    with pytest.raises(term_rows.VocabularyTooLarge):
        training._vocabulary(data, training._counts_of(data, WORDS, "description"), WORDS, None)
    assert training.grid_scores(data, model) == want
    rows = training.fit_predict(data, model, model.grid[1]).collect()
    assert len(rows) == 30 and all(r["y_pred"] == r["label"] for r in rows)


def test_year_and_two_texts_lie_side_by_side(spark):
    data = training.prepare(news(spark), k=3)
    model = C.Candidate("m", C.LOG_REG, (C.Point(WORDS),), ("description", "headline", "year"))
    counts = {t: training._counts_of(data, WORDS, t) for t in ("description", "headline")}
    table = training.build_features(data, model, WORDS, counts, None)
    assert table.size == 6 + 9 + 1 + 1
    rows = {r["id"]: r["features"] for r in table.vectors.collect()}
    # Three text words, one noise word, the headline; the test rows' year was never seen.
    assert rows[1].numNonzeros() == 6 and rows[0].numNonzeros() == 5
    assert rows[1][16] == 1.0 and rows[1][15] == 1.0


@pytest.mark.parametrize("degree", [2, 4])
def test_sketch_approximates_the_polynomial_kernel(degree):
    rng = np.random.default_rng(0)
    dense = rng.random((6, 40)) / 6
    indices = [np.arange(40)] * 6
    got = sketch_rows(indices, list(dense), 40, degree, components=8192)
    want = (dense @ dense.T + 1.0) ** degree
    assert np.abs(got @ got.T - want).max() < 0.15 * want.max()
    again = sketch_rows(indices, list(dense), 40, degree, components=8192)
    assert np.array_equal(got, again)


def test_sketch_of_degree_one_keeps_mass():
    got = sketch_rows([np.array([0, 2]), np.array([], dtype=int)],
                      [np.array([3.0, 4.0]), np.array([])], 3, 1, components=64)
    assert got.shape == (2, 64)
    assert np.isclose((got[1] ** 2).sum(), 1.0)


def test_poly_candidate(spark):
    data = training.prepare(news(spark), k=3)
    model = C.Candidate("p", C.LOG_REG, (C.Point(WORDS, balanced=True),), degree=2, components=256)
    rows = training.fit_predict(data, model, model.grid[0]).collect()
    assert sum(r["y_pred"] == r["label"] for r in rows) >= 28


def test_regression_on_sketches_never_stores_them(spark, monkeypatch):
    """Dense rows take 64 KB each, and Spark ML keeps those it learns from."""
    def dense(*_, **__):
        raise AssertionError("dense rows were made")

    monkeypatch.setattr(training, "polynomial_sketch", dense)
    data = training.prepare(news(spark), k=3)
    model = C.Candidate("p", C.LOG_REG, (C.Point(WORDS, balanced=True),), degree=2, components=256)
    assert training.fit_predict(data, model, model.grid[0]).count() == 30


@pytest.mark.parametrize("components", [64, 65])
def test_spectral_regression_finds_the_objective_of_dense_sketches(spark, components):
    rng = np.random.default_rng(3)
    dense = rng.random((40, 12)) * (rng.random((40, 12)) < 0.4)
    label = (dense[:, 0] + 0.3 * rng.random(40) > 0.25).astype(int)
    rows = [(int(y), (np.flatnonzero(x).tolist(), x[x != 0].tolist()))
            for x, y in zip(dense, label)]
    arrays = spark.createDataFrame(
        rows, "label int, features struct<indices: array<int>, values: array<double>>")
    weight = {0: 2.0 * 40 / 3 / 40, 1: 0.7}
    sketch = sketches.Sketch(12, 3, components)
    model = sketches.fit_log_reg(arrays, sketch, weight, 40, 0.01, 1e-9, 500)
    x = sketch_rows([r[1][0] for r in rows], [r[1][1] for r in rows], 12, 3, components)
    sign = np.where(label == 1, 1.0, -1.0)
    w = np.array([weight[y] for y in label])
    z = x @ model.weights[:-1] + model.weights[-1]
    slant = -w * sign / (1 + np.exp(sign * z)) / 40
    slope = np.append(x.T @ slant + 0.01 * model.weights[:-1], slant.sum())
    assert model.converged and np.abs(slope).max() < 1e-4
    told = sketches.decisions(arrays.coalesce(1), model, "z").collect()
    assert np.allclose([r["z"] for r in told], z)


def test_labels_beyond_two_classes_still_learn_on_sketches(spark):
    more = F.when(F.col("id") % 10 == 3, 2).otherwise(F.col("label"))
    data = training.prepare(news(spark).withColumn("label", more), k=3)
    model = C.Candidate("p", C.LOG_REG, (C.Point(WORDS),), degree=2, components=64)
    assert training.fit_predict(data, model, model.grid[0]).count() == 30


def test_terms_of_documents_are_never_broadcast(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(term_rows, "written", lambda df, *_, **__: taken.append(df) or df)
    data = training.prepare(news(spark), k=3)
    rows = term_rows.marked_terms(data.texts, data.marks, WORDS)
    assert len(rows.collect()) == 120
    assert "BroadcastHashJoin" not in taken[-1]._jdf.queryExecution().executedPlan().toString()


def test_long_rows_are_stored_in_small_row_groups(spark, tmp_path):
    """Readers take up to 4,096 rows of a row group at once."""
    table = spark.range(0, 1500, 1, 1).select(
        "id", F.lit(0).alias("label"), F.lit(0).alias("fold"), F.lit(1).alias("part"),
        F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: i.cast("int")).alias("indices"),
        F.transform(F.sequence(F.lit(1), F.lit(3000)),
                    lambda i: F.rand(1) + i).alias("values"))
    parts = term_rows.written_parts(table, [1])
    stored = vectors.stored_features(table, 3001, ["id", "label", "fold"]).arrays
    for frame in (parts[1], stored):
        for file in frame.inputFiles():
            meta = pq.ParquetFile(file.removeprefix("file://")).metadata
            assert max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 600


def test_ensemble_run(spark):
    models = [C.Candidate("tfidf_log_reg", C.LOG_REG, points()[1:]),
              C.Candidate("count_linear_svm", C.LINEAR_SVM, points()[1:]),
              C.Candidate("tfidf_naive_bayes", C.NAIVE_BAYES, points()[1:])]
    summary, members, voted = training.run_ensemble(news(spark), models, k=3)
    row = summary.first()
    assert row["ensemble_f1"] == 1.0 and len(row["members"]) == 2
    assert members.count() == 3 and voted.count() == 30


def test_candidates():
    sizes = {c.name: len(c.grid) for c in C.candidates()}
    assert sizes == {
        "tfidf_log_reg": 26, "tfidf_log_reg_desc_headline_year": 1, "tfidf_linear_svm": 26,
        "tfidf_naive_bayes": 8, "tfidf_log_reg_poly2": 1, "tfidf_log_reg_poly4": 1,
        "tfidf_log_reg_poly5": 1, "count_log_reg": 24, "count_linear_svm": 24}
    chosen, unknown = C.select(["count_log_reg", "bert"])
    assert [c.name for c in chosen] == ["count_log_reg"] and unknown == ["bert"]
    with pytest.raises(ValueError):
        C.select(["bert"])


def test_best_point_takes_the_first_of_a_tie():
    assert training.best_point([(1, 0, 0.5), (1, 1, 0.7), (0, 0, 0.7), (0, 1, 0.5), (2, 0, 0.1)])[
        0] == 0


def test_feature_sets(spark):
    i = F.col("id")
    view = spark.range(200).select(
        "id", (i % 2).cast("int").alias("political"), (i % 3 == 0).cast("int").alias("domestic"),
        F.lit(2000).alias("year"), (i % 2 * 10 + i % 5).alias("desc_tokens"),
        F.pmod(F.xxhash64(i), F.lit(7)).cast("int").alias("headline_tokens"))
    rows = {r["features"]: r for r in feature_sets.eval_feature_sets(view, "political").collect()}
    assert len(rows) == 6
    assert rows["desc_tokens"]["roc_auc_mean"] == pytest.approx(1.0)
    assert rows["year"]["roc_auc_mean"] == pytest.approx(0.5)
    assert rows[feature_sets.BASELINE]["bacc_mean"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        feature_sets.feature_sets("sports")


def test_queries_search_whole_grids(spark, monkeypatch):
    import __spark_entry__ as entry
    from gazette.plans import models

    searched = []

    def grid_scores(data, candidate, **_):
        searched.append((candidate.name, len(candidate.grid)))
        raise InterruptedError

    def run_ensemble(rows, candidates, **_):
        searched.extend((c.name, len(c.grid)) for c in candidates)
        raise InterruptedError

    monkeypatch.setattr(models.training, "prepare", lambda *_: None)
    monkeypatch.setattr(models, "training_table", lambda *_: None)
    monkeypatch.setattr(models.training, "grid_scores", grid_scores)
    monkeypatch.setattr(models.training, "run_ensemble", run_ensemble)
    queries = entry.queries()
    for name, want in (
            ("tfidf_log_reg", [("tfidf_log_reg", 26)]), ("tfidf_svm", [("tfidf_linear_svm", 26)]),
            ("tfidf_naive_bayes", [("tfidf_naive_bayes", 8)]),
            ("count_log_reg", [("count_log_reg", 24)]), ("count_svm", [("count_linear_svm", 24)]),
            ("grid_best", [("count_log_reg", 24)]),
            ("linear_vote_run", [(c.name, len(c.grid)) for c in models.C.candidates()])):
        searched.clear()
        with pytest.raises(InterruptedError):
            queries[name](spark, "")
        assert searched == want, name
    assert len(models.C.candidates()) == 9 and "tfidf_log_reg_point" in queries


def test_products_of_cells_add_up_in_their_order(monkeypatch):
    monkeypatch.setattr(linear, "STRETCH", 7, raising=False)
    rng = np.random.default_rng(1)
    lists = [sorted(rng.choice(30, n, replace=False).tolist()) for n in (0, 20, 3, 0, 1, 9, 5, 0)]
    cells = linear.Cells(pa.array(lists, pa.list_(pa.int32())),
                         pa.array([rng.random(len(x)).tolist() for x in lists],
                                  pa.list_(pa.float64())))
    row = np.repeat(np.arange(8), [len(x) for x in lists])
    index = np.concatenate(lists).astype(int)
    value, weights, per_row = cells.value, rng.random(31), rng.random(8)
    assert (cells.times(weights) == weights[-1] + np.bincount(
        row, value * weights[index], 8)).all()
    for squared, v in ((False, value), (True, value * value)):
        got = cells.back(per_row, 30, squared)
        assert (got[:-1] == np.bincount(index, v * per_row[row], 30)).all()
        assert got[-1] == per_row.sum()
    nothing = linear.Cells(pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.float64())))
    assert not len(nothing.times(weights)) and not nothing.back(np.zeros(0), 30).any()


def test_threads_ship_the_package_once(monkeypatch):
    sent = []

    def add(path):
        time.sleep(0.2)
        sent.append(path)

    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="one", addPyFile=add))
    monkeypatch.setattr(shipping, "_shipped", set())
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(shipping.ship_package, [session] * 4))
    assert len(sent) == 1


def _sparse(spark, part: int, n: int, seed: int):
    rng = np.random.default_rng(seed)
    rows = [(part, int(rng.random() < 0.4 + 0.2 * (i % 2)), [i % 5, 5 + i % 3],
             [1.0 + i % 4, float(rng.random())]) for i in range(n)]
    return spark.createDataFrame(
        rows, "part int, label int, indices array<int>, values array<double>").coalesce(1)


def test_parts_of_one_task_stay_apart(spark):
    frames = [_sparse(spark, part, 40, part) for part in range(3)]
    rows = training._union(frames)
    assert rows.rdd.getNumPartitions() == 3
    assert rows.schema == frames[0].schema
    assert rows.groupBy("part").count().count() == 3 and rows.count() == 120


def test_problems_dealt_over_tasks_have_the_same_directions(spark):
    rows = training._union([_sparse(spark, part, 60, part) for part in range(2)])
    problems = [linear.Problem(part, 8, linear.LOG, c) for part in range(2) for c in (0.1, 1.0)]
    asked = {i: (p, linear.DIRECTION, np.zeros(9), np.arange(9.0) + i, 60.0, 0.03, False)
             for i, p in enumerate(problems)}
    together = linear._scan(rows, asked, rows.rdd.getNumPartitions())
    for i, ask in asked.items():
        alone = linear._scan(rows, {i: ask})[i]
        assert np.array_equal(together[i][linear.VECTOR], alone[linear.VECTOR])


def test_a_direction_works_on_the_rows_with_curvature_alone(monkeypatch):
    rng = np.random.default_rng(2)
    n = 200
    indices = pa.array([[i % 7, 7 + i % 5] for i in range(n)], pa.list_(pa.int32()))
    values = pa.array([[1.0, float(x)] for x in rng.random(n)], pa.list_(pa.float64()))
    cells, label = linear.Cells(indices, values), np.arange(n) % 2
    problem = linear.Problem(0, 12, linear.SQUARED_HINGE, 1.0)
    point = rng.standard_normal(13) * 3
    sign, weight = linear._signs(label, problem)
    _, slant, bend = linear.losses(problem.loss, sign * cells.times(point))
    slope = cells.back(weight * slant * sign, 12) + problem.penalty * point
    assert 0 < (bend != 0).sum() < n
    seen, whole = [], linear._newton
    monkeypatch.setattr(linear, "_newton", lambda c, curved, *rest: (
        seen.append(c.n), whole(c, curved, *rest))[1])
    got = linear._direction(cells, label, problem, point, slope, n, 0.03, False)
    assert seen == [(bend != 0).sum()]
    scale = problem.penalty + linear.SCALING * (np.maximum(
        cells.back(weight * bend, 12, squared=True) + problem.penalty, 1e-12) - problem.penalty)
    over_all = whole(cells, weight * bend, problem.penalty, scale, slope, np.zeros(13),
                     0.03 * float(np.linalg.norm(slope)))
    assert np.array_equal(got[linear.VECTOR], over_all)


def test_tasks_that_share_a_problem_solve_it_as_one_does(spark):
    """Each row has a feature of its own: no task sees what the others' rows do to the solution."""
    rng = np.random.default_rng(5)
    rows = [(0, int(rng.random() < 0.3 + 0.4 * (i % 2)), [i % 4, 4 + i // 2 % 20, 24 + i],
             [float(x) for x in rng.random(3) * 3]) for i in range(240)]
    frame = spark.createDataFrame(
        rows, "part int, label int, indices array<int>, values array<double>")
    problems = [linear.Problem(0, 264, loss, c) for loss in (linear.LOG, linear.SQUARED_HINGE)
                for c in (0.5, 20.0)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    one, many = (linear.solve(frame.repartition(k), problems) for k in (1, 6))
    for a, b, p in zip(one, many, problems, strict=True):
        assert a.converged and b.converged and b.steps <= a.steps + 2
        assert abs(a.objective - b.objective) < 1e-5 * a.objective
        left = linear.gradient(frame.repartition(3), p, b)
        assert np.allclose(np.abs(left).max(), b.gradient, rtol=1e-6)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_decision_values_added_up_in_pairs_are_the_same(monkeypatch):
    monkeypatch.setattr(linear, "STRETCH", 7)
    rng = np.random.default_rng(1)
    lists = [sorted(rng.choice(30, n, replace=False).tolist()) for n in (0, 20, 3, 0, 1, 9, 5, 0)]
    cells = linear.Cells(pa.array(lists, pa.list_(pa.int32())),
                         pa.array([rng.random(len(x)).tolist() for x in lists],
                                  pa.list_(pa.float64())))
    weights = rng.random(31)
    assert np.allclose(cells.near(weights), cells.times(weights), rtol=1e-14)
    kept = np.array([True, False, True, True, False, True, False, True])
    assert np.array_equal(cells.of(kept).near(weights), cells.near(weights)[kept])


def test_naive_bayes_stores_no_features(spark, monkeypatch):
    stored = []
    write = training.written_parts
    monkeypatch.setattr(training, "written_parts", lambda rows, parts: stored.append(parts) or
                        write(rows, parts))
    data = training.prepare(news(spark), k=3)
    model = C.Candidate("m", C.NAIVE_BAYES, tuple(C.Point(WORDS, alpha=a) for a in (0.1, 1.0)))
    counts = training._all_counts(data, model, WORDS)
    folds = [None, 0, 1, 2]
    parts, sizes = training._feature_parts(data, model, WORDS, counts, folds)
    assert not stored
    kept, kept_sizes = training._feature_parts(
        data, C.Candidate("m", C.LOG_REG, model.grid), WORDS, counts, folds)
    assert stored and sizes == kept_sizes
    both = [{(r.part, r.id): r for r in training._learning_rows(
        [(f, p[training._part(f)]) for f in folds]).collect()} for p in (parts, kept)]
    assert both[0] == both[1] and {part for part, _ in both[0]} == {-1, 0, 1, 2}
    for f in folds:
        part = training._part(f)
        for rows in (training.train_rows(F.col("fold"), f), F.col("fold") == part):
            a, b = ({r.id: r for r in p[part].where(rows).collect()} for p in (parts, kept))
            assert a == b and a


def test_gradients_of_many_problems_take_one_scan(spark, monkeypatch):
    rows = training._union([_sparse(spark, part, 60, part) for part in range(2)])
    asked = [(linear.Problem(part, 8, linear.LOG, c), linear.Solution(
        np.arange(8.0) * c, 0.5, 0.0, 0.0, 0, 0, True)) for part in range(2) for c in (0.1, 1.0)]
    alone = [linear.gradient(rows, *one) for one in asked]
    scans, scan = [], linear._scan
    monkeypatch.setattr(linear, "_scan", lambda *a: scans.append(a) or scan(*a))
    together = linear.gradients(rows, asked)
    assert len(scans) == 1 and all(map(np.array_equal, alone, together))


def test_the_refit_counts_no_terms_again(spark, monkeypatch):
    counted, count = [], training._all_counts
    monkeypatch.setattr(training, "_all_counts", lambda *a: counted.append(a[2].counting) or
                        count(*a))
    data = training.prepare(news(spark), k=3)
    grid = tuple(C.Point(T.TermSettings(high=high, min_df=0.01, max_df=1.0), alpha=a)
                 for high in (1, 2) for a in (0.1, 1.0))
    trained = training.train(data, C.Candidate("m", C.NAIVE_BAYES, grid))
    assert trained.predictions.count() == 30 and len(counted) == len(set(counted)) == 2
