"""Stored models on tables and streams, keyed streaming state, batched inference."""

from __future__ import annotations

import subprocess
import sys

import numpy as np
import pytest
from pyspark import SparkFiles
from pyspark.sql import functions as F

from gazette.operators import candidates as C
from gazette.operators import evaluation, splits, text_model, training, zero_shot
from gazette.operators import terms as T
from gazette.shipping import ship_package
from gazette.streaming import incremental
from test_training import news

SETTINGS = [T.TermSettings(low=1, high=2, min_df=0.02, stop_words=("votes",)),
            T.TermSettings(min_df=0.02, tfidf=False),
            T.TermSettings(analyzer=T.CHAR_WB, low=3, high=5, min_df=0.02)]


@pytest.mark.parametrize("kind", [C.LOG_REG, C.LINEAR_SVM, C.NAIVE_BAYES])
@pytest.mark.parametrize("settings", SETTINGS)
def test_a_reloaded_model_predicts_as_the_fitted_one(spark, tmp_path, kind, settings):
    data = training.prepare(news(spark), k=3)
    model = C.Candidate("m", kind, (C.Point(settings, c=2.0, balanced=True),))
    want = {r["id"]: r for r in training.fit_predict(data, model, model.grid[0]).collect()}
    text_model.fit(data, model, model.grid[0]).save(spark, str(tmp_path))
    again = text_model.TextModel.load(spark, str(tmp_path))
    assert again.settings == settings
    rows = news(spark).where("split = 'test'").withColumn("score", F.lit("old"))
    got = again.transform(rows).collect()
    assert len(got) == len(want) and "headline" in got[0].asDict()
    for r in got:
        assert r["y_pred"] == want[r["id"]]["y_pred"]
        assert r["score"] == pytest.approx(want[r["id"]]["score"], abs=1e-6)


def test_texts_without_known_terms_and_empty_tables(spark):
    data = training.prepare(news(spark), k=3)
    model = C.Candidate("m", C.LOG_REG, (C.Point(SETTINGS[0]),))
    fitted = text_model.fit(data, model, model.grid[0])
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "zzz yyy")], "id long, description string")
    scores = {round(r["score"], 12) for r in fitted.transform(rows).collect()}
    assert scores == {round(float(1 / (1 + np.exp(-fitted.intercept))), 12)}
    assert fitted.transform(rows.where("false")).collect() == []
    with pytest.raises(ValueError):
        text_model.fit(data, C.Candidate("m", C.LOG_REG, model.grid, ("description", "headline")),
                       model.grid[0])


def test_no_vocabulary_leaves_the_intercept(spark):
    data = training.prepare(news(spark).withColumn("description", F.lit("")), k=3)
    model = C.Candidate("m", C.LOG_REG, (C.Point(SETTINGS[0]),))
    rows = training.fit_predict(data, model, model.grid[0]).collect()
    share = data.class_counts()[1] / data.train_size()
    assert len(rows) == 30 and all(r["score"] == pytest.approx(share, abs=1e-4) for r in rows)


def test_the_state_store_knows_ids_of_earlier_batches(spark, tmp_path):
    source, out, point = (str(tmp_path / n) for n in ("in", "out", "check"))

    def deliver(rows):
        spark.createDataFrame(rows, "id bigint, y_true int, y_pred int").coalesce(1).write.mode(
            "append").parquet(source)
        stream = incremental.read_replies(spark, source, "id bigint, y_true int, y_pred int", 1)
        incremental.score_stream(stream, "political", out, point, lambda r: r,
                                 horizon_hours=1).awaitTermination()
        return sorted(((r["id"], r["y_true"], r["y_pred"]) for r in spark.read.schema(
            "id bigint, y_true int, y_pred int, batch bigint").parquet(out).collect()), key=repr)

    first = [(1, 1, 1), (2, 0, 0), (3, None, 1)]
    assert deliver([(1, 1, 1), (2, 0, 1), (2, 0, 0), (3, None, 1), (3, 1, 0)]) == first
    assert deliver([(1, 0, 0), (4, 1, 1)]) == [*first, (4, 1, 1)]
    assert deliver([(i, 0, 0) for i in range(1, 6)])[-1] == (5, 0, 0)


def test_a_batch_does_not_read_what_is_stored(spark, tmp_path):
    rows = spark.readStream.schema("id bigint, y_true int, y_pred int").parquet(str(tmp_path))
    kept = incremental.first_of_each_id(rows, 1)
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert "FlatMapGroupsInPandasWithState" in plan and "Join" not in plan


def test_batched_inference_loads_its_model_once_per_worker(spark):
    def load():
        seen = []

        def score(texts, names):
            seen.append(len(texts))
            return np.array([float(len(t) + len(seen) * 0) for t in texts]) + (names == "b")

        return score

    rows = spark.createDataFrame([(i, "x" * i) for i in range(50)], "id long, description string")
    scored = zero_shot.score_in_batches(zero_shot.label_pairs(rows, ("a", "b")), load, batch_size=7)
    got = {(r["id"], r["candidate"]): r["score"] for r in scored.collect()}
    assert got == {(i, c): i + float(c == "b") for i in range(50) for c in "ab"}


def test_the_plans_can_be_imported_from_the_shipped_archive(spark, tmp_path):
    ship_package(spark)
    archive = SparkFiles.get("gazette.zip")
    # A worker whose folder is not the repository's has nothing but the archive.
    code = "import sys; sys.path.insert(0, sys.argv[1]); from gazette.plans import serving; " \
           "print(serving.__file__)"
    done = subprocess.run([sys.executable, "-I", "-c", code, archive], cwd=tmp_path,
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.startswith(archive)


def test_three_way_split_keeps_the_test_rows(spark):
    rows = spark.range(2000)
    two = {r["id"] for r in splits.with_split(rows).where("split = 'test'").collect()}
    three = splits.with_three_way_split(rows)
    assert {r["id"] for r in three.where("split = 'test'").collect()} == two
    counts = {r["split"]: r["count"] for r in three.groupBy("split").count().collect()}
    assert 130 < counts["validation"] < 270 and sum(counts.values()) == 2000


def test_labels_outside_the_classes_count_as_rows(spark):
    rows = spark.createDataFrame([(1, 1), (0, 1), (2, 2), (2, 1)], "y_true int, y_pred int")
    got = evaluation.f1_scores(rows).first()
    assert (got["n"], got["accuracy"]) == (4, 0.5)
    assert evaluation.run_scores(rows).first()["n_samples"] == 4
