"""Training, grid search and prediction.

A grid is grouped by what its points share. Texts are counted once per tokenisation, the document
frequencies of all folds come from one pass, and a vocabulary is learned per fold and setting from
that fold's training rows only. All classifiers of a setting, in all folds, are fitted together:
each of their solver's scans serves every C, class weight and fold (see ``linear``). Polynomial
sketches are dense: every scan of their solver makes them anew (see ``sketch``).
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import scores as S
from gazette.operators import linear, naive_bayes
from gazette.operators.candidates import (
    LINEAR_SVM,
    LOG_REG,
    NAIVE_BAYES,
    YEAR,
    Candidate,
    Point,
)
from gazette.operators.sketch import (
    Sketch,
    SketchModel,
    decisions,
    fit_log_reg,
    polynomial_sketch,
)
from gazette.operators.splits import hash_folds, stratified_folds
from gazette.operators.term_rows import (
    Vocabulary,
    VocabularyTooLarge,
    fold_frequencies,
    fold_vocabulary,
    marked_terms,
    vector_rows,
    written_parts,
)
from gazette.operators.terms import TermSettings
from gazette.operators.vectors import (
    FeatureTable,
    category_index,
    fit_vectorizer,
    one_hot,
    sparse_layout,
    sparse_rows,
    stored_features,
    write_features,
)
from gazette.sources.scratch import written

HOLDOUT = -1  # the fold number of test rows
# Solvers stop by tolerance; the limit only ends a solver that never would.
MAX_ITER = 10_000
TOLERANCE = 1e-4


@dataclass(frozen=True)
class Data:
    """``texts``: ``id`` and the feature columns, read only to count terms. ``marks``: a written
    table of ``id, label, fold``, with fold HOLDOUT for test rows."""

    texts: DataFrame
    marks: DataFrame
    label_counts: dict[int, dict[int, int]]

    def train_size(self, without: int | None = None) -> int:
        return sum(sum(c.values()) for f, c in self.label_counts.items()
                   if f != HOLDOUT and f != without)

    def class_counts(self, without: int | None = None) -> dict[int, int]:
        out: dict[int, int] = {}
        for fold, counts in self.label_counts.items():
            if fold != HOLDOUT and fold != without:
                for label, n in counts.items():
                    out[label] = out.get(label, 0) + n
        return out


def prepare(rows: DataFrame, k: int = 5, exact_folds: bool = True) -> Data:
    """From ``id, label, split`` and texts: number the folds of the training rows.

    ``exact_folds=False`` takes hash folds, which need no ordering of the table.
    """
    train = rows.filter(F.col("split") == "train").select("id", "label")
    folds = (stratified_folds(train, "label", k).select("id", "fold") if exact_folds
             else hash_folds(train, k).select("id", "fold"))
    fold = F.when(F.col("split") == "train", F.col("fold")).otherwise(HOLDOUT)
    marks = written(rows.select("id", "label", "split").join(folds, "id", "left")
                    .select("id", "label", fold.alias("fold")), "marks")
    # (fold, label) pairs number folds x classes.
    counts: dict[int, dict[int, int]] = {}
    for row in marks.groupBy("fold", "label").count().collect():
        counts.setdefault(row["fold"], {})[row["label"]] = row["count"]
    return Data(rows.drop("label", "split"), marks, counts)


def train_rows(fold: Column, without: int | None) -> Column:
    """Rows to learn from: training rows outside the fold ``without``."""
    inside = fold != HOLDOUT
    return inside if without is None else inside & (fold != without)


def estimator(point: Point, kind: str, n: int):
    """Spark ML's logistic regression with the objective 0.5 |w|^2 + C x sum of weighted losses,
    for dense sketches.

    Spark divides the losses by the sum of the weights, which is ``n``, so its regularisation
    is 1 / (C n).
    """
    if kind != LOG_REG:
        raise ValueError(f"no estimator for {kind} on sketches")
    return LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="weight", elasticNetParam=0.0,
        regParam=1.0 / (point.c * n), standardization=False, maxIter=MAX_ITER, tol=TOLERANCE)


def row_weight(label: Column, counts: dict[int, int], balanced: bool) -> Column:
    """1, or rows / (classes x rows of the class)."""
    weight = F.lit(1.0)
    for value, w in class_weights(counts, balanced).items():
        weight = F.when(label == value, F.lit(w)).otherwise(weight)
    return weight


def fit_classifier(features: DataFrame, point: Point, kind: str, counts: dict[int, int]
                   ) -> Transformer:
    weighted = features.withColumns({
        "weight": row_weight(F.col("label"), counts, point.balanced),
        "label": F.col("label").cast("double")})
    return estimator(point, kind, sum(counts.values())).fit(weighted)


def predict(model: Transformer, features: DataFrame, keep: Sequence[str] = ("id", "label")
            ) -> DataFrame:
    """``keep..., y_pred, score``: probability of class 1, or the decision value."""
    scored = model.transform(features)
    column = "probability" if "probability" in scored.columns else "rawPrediction"
    return scored.select(*keep, F.col("prediction").cast("int").alias("y_pred"),
                         vector_to_array(F.col(column))[1].alias("score"))


# --------------------------------------------------------------------------- features

@dataclass(frozen=True)
class Counted:
    """``id, label, fold, terms`` of one text column, and its document frequencies per fold."""

    table: DataFrame
    frequencies: DataFrame


def _counts_of(data: Data, settings: TermSettings, text: str) -> Counted:
    """Written, because every fold and every limit reads it."""
    table = marked_terms(data.texts, data.marks, settings, text)
    folds = sorted(f for f in data.label_counts if f != HOLDOUT)
    return Counted(table, fold_frequencies(table, train_rows(F.col("fold"), None), folds))


def _all_counts(data: Data, candidate: Candidate, settings: TermSettings) -> dict[str, Counted]:
    return {text: _counts_of(data, settings, text) for text in candidate.fields if text != YEAR}


def _vocabulary(data: Data, counted: Counted, settings: TermSettings, without: int | None
                ) -> Vocabulary:
    return fold_vocabulary(counted.frequencies, data.train_size(without), settings, without)


def _part(without: int | None) -> int:
    """Parts of stored features are named by the fold they leave out."""
    return HOLDOUT if without is None else without


def _vocabularies(data: Data, counted: Counted, settings: TermSettings,
                  left_out: Sequence[int | None]) -> dict[int, Vocabulary]:
    return {_part(f): _vocabulary(data, counted, settings, f) for f in left_out}


def _text_vectors(data: Data, counted: Counted, settings: TermSettings,
                  left_out: Sequence[int | None]) -> tuple[DataFrame, dict[int, int]]:
    """(``part, id, label, fold, indices, values``, part -> vector length) of one text."""
    try:
        vocabularies = _vocabularies(data, counted, settings, left_out)
    except VocabularyTooLarge:
        return _joined_vectors(data, counted, settings, left_out)
    return (vector_rows(counted.table, vocabularies, settings, holdout=HOLDOUT),
            {part: v.size for part, v in vocabularies.items()})


def _joined_vectors(data: Data, counted: Counted, settings: TermSettings,
                    left_out: Sequence[int | None]) -> tuple[DataFrame, dict[int, int]]:
    """The same with a vocabulary that is joined, where it is too large to be broadcast."""
    long = counted.table.select("id", "fold", F.explode("terms").alias("t")).select(
        "id", "fold", "t.*")
    frames, sizes = [], {}
    for f in left_out:
        learn = train_rows(F.col("fold"), f)
        vectorizer = fit_vectorizer(long.where(learn).drop("fold"), data.train_size(f), settings)
        marks = data.marks if f is None else data.marks.where(F.col("fold") != HOLDOUT)
        rows = marks.join(sparse_rows(long.drop("fold"), vectorizer), "id", "left")
        frames.append(rows.select(
            F.lit(_part(f)).alias("part"), "id", "label", "fold",
            F.coalesce("features.indices", F.array().cast("array<int>")).alias("indices"),
            F.coalesce("features.values", F.array().cast("array<double>")).alias("values")))
        sizes[_part(f)] = vectorizer.size
    return _union(frames), sizes


def build_features(data: Data, candidate: Candidate, settings: TermSettings,
                   counts: dict[str, Counted], without: int | None) -> FeatureTable:
    """Vectors learned without the fold ``without``; the year comes last.

    Of all rows, or without the test rows if a fold is left out: nothing scores them then.
    """
    part, marks = _part(without), data.marks
    if without is not None:
        marks = marks.where(F.col("fold") != HOLDOUT)
    parts = []
    for counted in counts.values():
        rows, size = _text_vectors(data, counted, settings, [without])
        if len(candidate.fields) == 1:
            return stored_features(rows, size[part], ["id", "label", "fold"])
        parts.append((sparse_layout(rows, size[part], ["id"]), size[part]))
    if YEAR in candidate.fields:
        learn = train_rows(F.col("fold"), without)
        known = data.texts.select("id", YEAR).join(data.marks.filter(learn).select("id"), "id")
        years = written(category_index(known, YEAR), "years")
        size = years.count()
        parts.append((one_hot(data.texts, YEAR, years, size), size))
    return write_features(marks, parts, ["id", "label", "fold"])


@dataclass(frozen=True)
class _MadeAnew:
    """Features of one part that each scan makes from the terms, of the rows it asks for alone."""

    table: DataFrame
    part: int
    vocabulary: Vocabulary
    settings: TermSettings

    def where(self, condition: Column) -> DataFrame:
        return vector_rows(self.table.where(condition), {self.part: self.vocabulary},
                           self.settings, holdout=HOLDOUT)


def _learning_rows(frames: Sequence[tuple[int | None, DataFrame | _MadeAnew]]) -> DataFrame:
    """The rows that each part learns from; features that are made anew take one pass in all."""
    if not all(isinstance(frame, _MadeAnew) for _, frame in frames):
        return _union(frame.where(train_rows(F.col("fold"), f)) for f, frame in frames)
    one, part = frames[0][1], F.col("part")
    rows = vector_rows(one.table.where(train_rows(F.col("fold"), None)),
                       {x.part: x.vocabulary for _, x in frames}, one.settings, holdout=HOLDOUT)
    return rows.where((part == HOLDOUT) | (F.col("fold") != part))


def _feature_parts(data: Data, candidate: Candidate, settings: TermSettings,
                   counts: dict[str, Counted], left_out: Sequence[int | None]
                   ) -> tuple[dict[int, DataFrame | _MadeAnew], dict[int, int]]:
    """(part -> ``part, id, label, fold, indices, values``, part -> vector length): the features
    of every fold left out, made in one pass over the terms where there is one text.

    Naive Bayes scans them twice, to add up and to predict: both scans make them anew, row by row,
    and nothing is stored.
    """
    if len(candidate.fields) == 1:
        if candidate.kind == NAIVE_BAYES:
            counted = counts[candidate.fields[0]]
            try:
                known = _vocabularies(data, counted, settings, left_out)
            except VocabularyTooLarge:
                known = {}
            if known:
                return ({part: _MadeAnew(counted.table, part, v, settings)
                         for part, v in known.items()}, {part: v.size for part, v in known.items()})
        rows, sizes = _text_vectors(data, counts[candidate.fields[0]], settings, left_out)
        return written_parts(rows, list(sizes)), sizes
    tables = {_part(f): build_features(data, candidate, settings, counts, f) for f in left_out}
    return ({part: t.arrays.select(F.lit(part).alias("part"), "id", "label", "fold",
                                   "features.indices", "features.values")
             for part, t in tables.items()}, {part: t.size for part, t in tables.items()})


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    """Side by side, the tasks of every frame kept."""
    return linear.apart(frames)


def final_features(table: FeatureTable, candidate: Candidate, seed: int) -> DataFrame:
    """``id, label, fold, features`` as the classifier wants them."""
    if candidate.degree is None:
        return table.vectors
    return polynomial_sketch(table.arrays, table.size, candidate.degree,
                             components=candidate.components, seed=seed)


# --------------------------------------------------------------------------- fitting

@dataclass(frozen=True)
class LinearModel:
    """Weights of the features of one part; ``steps`` is None where nothing was iterated."""

    weights: np.ndarray
    intercept: float
    steps: int | None = None
    converged: bool | None = None


LOSSES = {LOG_REG: linear.LOG, LINEAR_SVM: linear.SQUARED_HINGE}


def class_weights(counts: dict[int, int], balanced: bool) -> dict[int, float]:
    """Nothing, or rows / (classes x rows of the class)."""
    total = sum(counts.values())
    return {label: total / (len(counts) * n) for label, n in counts.items()} if balanced else {}


def fit_points(data: Data, candidate: Candidate, points: Sequence[Point], left_out: Sequence[
        int | None], parts: dict[int, DataFrame | _MadeAnew], sizes: dict[int, int],
        tolerance: float | None = None) -> dict[tuple[int, int], LinearModel]:
    """(place of the point, part) -> model, all of them fitted together.

    The points share their features; the parts are the folds left out.
    """
    learn = _learning_rows([(f, parts[_part(f)]) for f in left_out])
    keys = [(i, f) for f in left_out for i in range(len(points))]
    if candidate.kind == NAIVE_BAYES:
        sums = naive_bayes.class_sums(learn, sizes)
        return {(i, _part(f)): LinearModel(*naive_bayes.log_odds(
            *sums[_part(f)], data.class_counts(f), points[i].alpha)) for i, f in keys}
    problems = [linear.Problem(
        _part(f), sizes[_part(f)], LOSSES[candidate.kind], points[i].c,
        class_weights(data.class_counts(f), points[i].balanced)) for i, f in keys]
    found = linear.solve(learn, problems, TOLERANCE if tolerance is None else tolerance)
    return {(i, _part(f)): LinearModel(s.weights, s.intercept, s.steps, s.converged)
            for (i, f), s in zip(keys, found, strict=True)}


def linear_predictions(rows: DataFrame, model: LinearModel, kind: str) -> DataFrame:
    """``id, label, y_pred, score``: probability of class 1, or the decision value."""
    scored = linear.decisions(rows.select("id", "label", "indices", "values"), model.weights,
                              model.intercept, "_z")
    z = F.col("_z")
    score = F.lit(1.0) / (1 + F.exp(-z)) if kind == LOG_REG else z
    return scored.select("id", "label", (z > 0).cast("int").alias("y_pred"), score.alias("score"))


# --------------------------------------------------------------------------- search

@dataclass(frozen=True)
class Trained:
    """A trained candidate: its best point and its predictions for the test rows."""

    name: str
    point: Point
    cv_f1: float | None
    fit_time_s: float
    predictions: DataFrame
    iterations: int | None = None
    converged: bool | None = None


def _f1_of(predictions: DataFrame) -> float:
    y, p = F.col("label"), F.col("y_pred")
    return predictions.agg(S.f1(F.count_if((y == 1) & (p == 1)), F.count_if((y != 1) & (p == 1)),
                                F.count_if((y == 1) & (p != 1)))).first()[0]


def _f1(tp: int, fp: int, fn: int) -> float:
    return 2.0 * tp / (2.0 * tp + fp + fn) if tp else 0.0


def _in_threads(run, items: Sequence, parallelism: int) -> list:
    """Independent Spark jobs a few at a time, results in order."""
    spark = SparkSession.active()
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), items))


def _score_setting(data: Data, candidate: Candidate, settings: TermSettings,
                   points: Sequence[Point], counts: dict[str, Counted], folds: Sequence[int],
                   seed: int) -> dict[tuple[int, int], float]:
    """(place of the point, fold) -> F1 on the fold, for points that share their features."""
    if candidate.degree is not None:
        return {(i, f): _sketch_score(data, candidate, settings, p, counts, f, seed)
                for f in folds for i, p in enumerate(points)}
    parts, sizes = _feature_parts(data, candidate, settings, counts, folds)
    models = fit_points(data, candidate, points, folds, parts, sizes)
    held_out = _union(parts[f].where(F.col("fold") == f) for f in folds)
    keys = list(models)
    cells = linear.confusions(held_out, [(part, models[i, part].weights, models[i, part].intercept)
                                         for i, part in keys])
    return {key: _f1(*c) for key, c in zip(keys, cells, strict=True)}


def _sketch_score(data: Data, candidate: Candidate, settings: TermSettings, point: Point,
                  counts: dict[str, Counted], fold: int, seed: int) -> float:
    return _f1_of(_sketch_predictions(data, candidate, settings, point, counts, fold, seed)[0])


def _sketch_predictions(data: Data, candidate: Candidate, settings: TermSettings, point: Point,
                        counts: dict[str, Counted], without: int | None, seed: int
                        ) -> tuple[DataFrame, int, bool]:
    """Predictions for the fold ``without`` (None: the test rows), the solver's steps and whether
    it converged.

    Only two classes, 0 and 1, have a solver on sketches that are made anew; other labels, or one
    class alone, go to Spark ML, which keeps the dense rows.
    """
    table = build_features(data, candidate, settings, counts, without)
    known, tested = data.class_counts(without), F.col("fold") == _part(without)
    learn = train_rows(F.col("fold"), without)
    if set(known) != {0, 1} or candidate.kind != LOG_REG:
        features = final_features(table, candidate, seed)
        model = fit_classifier(features.filter(learn), point, candidate.kind, known)
        steps = iterations_of(model)
        return predict(model, features.filter(tested)), steps, steps < MAX_ITER
    n = sum(known.values())
    sketch = Sketch(table.size, candidate.degree, candidate.components, seed=seed)
    model = fit_log_reg(table.arrays.where(learn), sketch, class_weights(known, point.balanced), n,
                        1.0 / (point.c * n), TOLERANCE, MAX_ITER)
    return sketch_predictions(table.arrays.where(tested), model), model.steps, model.converged


def sketch_predictions(arrays: DataFrame, model: SketchModel) -> DataFrame:
    """``id, label, y_pred, score``: the probability of class 1."""
    z = F.col("_z")
    return decisions(arrays.select("id", "label", "features"), model, "_z").select(
        "id", "label", (z > 0).cast("int").alias("y_pred"),
        (F.lit(1.0) / (1 + F.exp(-z))).alias("score"))


def grid_scores(data: Data, candidate: Candidate, folds: Sequence[int] | None = None,
                parallelism: int = 4, seed: int = 42, kept: dict | None = None
                ) -> list[tuple[int, int, float]]:
    """(grid index, fold, F1) for every point and fold. ``kept`` takes the counted terms, by
    ``TermSettings.counting``."""
    folds = sorted(f for f in data.label_counts if f != HOLDOUT) if folds is None else folds
    by_counting: dict[tuple, dict[TermSettings, list[int]]] = {}
    for i, point in enumerate(candidate.grid):
        group = by_counting.setdefault(point.settings.counting, {})
        group.setdefault(point.settings, []).append(i)

    def count(group: dict[TermSettings, list[int]]) -> dict[str, Counted]:
        return _all_counts(data, candidate, next(iter(group)))

    groups = list(by_counting.values())
    counted = _in_threads(count, groups, parallelism)
    if kept is not None:
        kept.update(zip(by_counting, counted, strict=True))
    work = [(settings, indices, counts) for group, counts in zip(groups, counted, strict=True)
            for settings, indices in group.items()]

    def run(item) -> list[tuple[int, int, float]]:
        settings, indices, counts = item
        scores = _score_setting(data, candidate, settings, [candidate.grid[i] for i in indices],
                                counts, folds, seed)
        return [(indices[i], fold, f1) for (i, fold), f1 in scores.items()]

    found = [row for rows in _in_threads(run, work, parallelism) for row in rows]
    return sorted(found, key=lambda row: (row[0], row[1]))


def best_point(scores: Sequence[tuple[int, int, float]]) -> tuple[int, float]:
    """Grid index with the best mean F1 over the folds, the first on ties."""
    by_index: dict[int, list[float]] = {}
    for i, _, f1 in scores:
        by_index.setdefault(i, []).append(f1)
    means = {i: sum(v) / len(v) for i, v in by_index.items()}
    best = min(means, key=lambda i: (-means[i], i))
    return best, means[best]


def iterations_of(model: Transformer) -> int:
    """How many steps the solver of a linear model took."""
    summary = model.summary() if callable(model.summary) else model.summary
    return summary.totalIterations


def fit_predict(data: Data, candidate: Candidate, point: Point, seed: int = 42) -> DataFrame:
    """Fit one point on all training rows; ``id, label, y_pred, score`` of the test rows."""
    return fit_final(data, candidate, point, seed)[0]


def fit_final(data: Data, candidate: Candidate, point: Point, seed: int = 42,
              counts: dict[str, Counted] | None = None
              ) -> tuple[DataFrame, int | None, bool | None]:
    """The predictions of ``fit_predict``, the solver's iterations and whether it converged
    (None without a solver). ``counts``: the terms, where they were counted before."""
    counts = counts or _all_counts(data, candidate, point.settings)
    if candidate.degree is not None:
        return _sketch_predictions(data, candidate, point.settings, point, counts, None, seed)
    parts, sizes = _feature_parts(data, candidate, point.settings, counts, [None])
    model = fit_points(data, candidate, [point], [None], parts, sizes)[0, HOLDOUT]
    predictions = linear_predictions(parts[HOLDOUT].where(F.col("fold") == HOLDOUT), model,
                                     candidate.kind)
    return predictions, model.steps, model.converged


def train(data: Data, candidate: Candidate, parallelism: int = 4, seed: int = 42) -> Trained:
    """Search the grid if it has more than one point, refit the best, predict the test rows."""
    start = time.perf_counter()
    index, cv_f1, counted = 0, None, {}
    if len(candidate.grid) > 1:
        index, cv_f1 = best_point(grid_scores(data, candidate, parallelism=parallelism, seed=seed,
                                              kept=counted))
    point = candidate.grid[index]
    predictions, iterations, converged = fit_final(data, candidate, point, seed,
                                                   counted.get(point.settings.counting))
    predictions = written(predictions, "predictions")
    return Trained(candidate.name, point, cv_f1, time.perf_counter() - start, predictions,
                   iterations, converged)


def metrics_rows(trained: Sequence[Trained], parameters: dict[str, object]) -> DataFrame:
    """``model, f1, cv_f1, best_params, fit_time_s, iterations, converged`` and the run's
    parameters, best F1 first."""
    spark = trained[0].predictions.sparkSession
    rows = []
    for t in trained:
        params = {k: str(v) for k, v in t.point.params().items() if v is not None}
        rows.append((t.name, _f1_of(t.predictions), t.cv_f1, params, t.fit_time_s, t.iterations,
                     t.converged))
    log = spark.createDataFrame(
        rows, "model STRING, f1 DOUBLE, cv_f1 DOUBLE, best_params MAP<STRING, STRING>, "
              "fit_time_s DOUBLE, iterations INT, converged BOOLEAN")
    return log.withColumns({k: F.lit(v) for k, v in parameters.items()}).orderBy(
        F.desc("f1"), "model")


def run_baselines(rows: DataFrame, candidates: Sequence[Candidate], k: int = 5,
                  parallelism: int = 4, seed: int = 42, exact_folds: bool = True,
                  parameters: dict[str, object] | None = None) -> DataFrame:
    """Train every candidate on ``id, label, split`` and texts; the metrics table."""
    data = prepare(rows, k, exact_folds)
    trained = [train(data, c, parallelism, seed) for c in candidates]
    return metrics_rows(trained, {"cv": k, **(parameters or {})})


def run_ensemble(rows: DataFrame, candidates: Sequence[Candidate], top_k: int = 2, k: int = 5,
                 parallelism: int = 4, seed: int = 42, rank_by: str = "f1",
                 max_members: int | None = None, test_size: float = 0.2
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ensemble row, member rows, voted predictions) of the best linear candidates.

    ``rank_by="cv_f1"`` ranks the members without looking at the test rows. ``test_size`` is only
    recorded: ``rows`` come with their split.
    """
    from gazette.operators import ensemble
    from gazette.operators.evaluation import f1_scores

    data = prepare(rows, k)
    trained = [train(data, c, parallelism, seed) for c in candidates]
    log = written(metrics_rows(trained, {"cv": k}), "members")
    members = ensemble.top_linear(log, top_k, rank_by, max_members)
    # At most as many rows as there are candidates.
    chosen = [r["model"] for r in members.filter("selected_for_ensemble").orderBy("rank").collect()]
    if not chosen:
        raise ValueError("a vote needs at least one linear candidate")
    stacked = None
    for t in trained:
        if t.name in chosen:
            part = t.predictions.select("id", F.col("label").alias("y_true"), "y_pred",
                                        F.lit(t.name).alias("model"))
            stacked = part if stacked is None else stacked.unionByName(part)
    voted = ensemble.majority_vote(stacked, chosen[0])
    summary = ensemble.ensemble_row(members, rank_by).join(
        f1_scores(voted).select(F.col("f1").alias("ensemble_f1"),
                                F.lit("linear_vote").alias("model")), "model")
    summary = summary.withColumns({"top_k_requested": F.lit(top_k),
                                   "n_candidates_trained": F.lit(len(trained)),
                                   "n_linear_candidates": F.lit(members.where("is_linear").count()),
                                   "test_size": F.lit(test_size), "random_state": F.lit(seed)})
    return summary, members, voted


def single_point(candidate: Candidate, index: int = 0) -> Candidate:
    """The candidate without its search."""
    return replace(candidate, grid=(candidate.grid[index],))
