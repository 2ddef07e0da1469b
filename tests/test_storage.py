from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gazette.sources import articles as A
from gazette.sources import metrics_log as M
from gazette.sources import predictions as P
from gazette.sources import scratch


def test_article_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,description,date,headline,political,domestic\n'
                    '668586.0,"line one\nsays ""hi"", ok",31/12/2005,h,1,0.0\n'
                    ',text,01/01/2004,,0,1\n2.0,x,05/06/2004,h,99,1\n')
    rows = A.clean_articles(A.read_csv(spark, str(path))).collect()
    assert [r["id"] for r in rows] == [668586, None]
    assert rows[0]["description"] == 'line one\nsays "hi", ok'


def test_bad_prediction_lines(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("row_index,y_true,y_pred\n1,1,1\n2,0\n3,1,x\n4,0,0\n5,1,1,9,9\n")
    kept = P.read_predictions_csv(spark, str(path))
    assert sorted(r["row_index"] for r in kept.collect()) == [1, 4]
    good, bad = P.split_bad_lines(spark, str(path))
    assert sorted(r["row_index"] for r in good.select("row_index").collect()) == [1, 4]
    assert bad.count() == 3
    old = tmp_path / "old.csv"
    old.write_text("y_true,y_pred\n0,0\n1,1\n1,0\n")
    from gazette.operators.evaluation import f1_scores

    rows = P.read_predictions_csv(spark, str(old), "y_true INT, y_pred INT")
    assert f1_scores(rows).first()["f1"] == pytest.approx(2 / 3)


def test_runs_are_folders(spark, tmp_path):
    path = str(tmp_path / "runs")
    rows = spark.createDataFrame([(1, 1, 0, "political", "a/b", 42, "test"),
                                  (2, 1, 1, "political", "c", 42, "all")],
                                 "id BIGINT, y_true INT, y_pred INT, target STRING, model STRING, "
                                 "seed INT, scope STRING")
    P.append_predictions(rows, path)
    P.append_predictions(rows.withColumn("id", F.col("id") + 10), path)
    run = P.read_run(spark, path, target="political", model="a/b", scope="test")
    assert sorted(r["id"] for r in run.collect()) == [1, 11]
    assert "PartitionFilters: [isnotnull(target" in run._jdf.queryExecution().toString()
    name = rows.select(P.run_name(F.col("target"), F.col("model"), F.col("seed"), F.col("scope"),
                                  F.lit(3)).alias("n")).orderBy("id")
    assert [r["n"] for r in name.collect()] == [
        "predictions_political_a_b_seed42_n3", "predictions_political_c_seed42_all_n3"]


def test_metrics_grow_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    assert M.read_metrics(spark, path, "model STRING, f1 DOUBLE").count() == 0
    M.append_metrics(spark.createDataFrame([("a", 0.5)], "model STRING, f1 DOUBLE"), path)
    M.append_metrics(spark.createDataFrame([("b", 0.6, 42)], "model STRING, f1 DOUBLE, seed INT"),
                     path)
    rows = {r["model"]: r["seed"] for r in M.read_metrics(spark, path, "model STRING").collect()}
    assert rows == {"a": None, "b": 42}


def test_ragged_metrics_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("model,f1\ngpt-5,0.79\ngpt-5.1,0.80,42,test\n")
    schema = "model STRING, f1 DOUBLE, seed INT, scope STRING"
    rows = [tuple(r) for r in M.read_metrics_csv(spark, str(path), schema).collect()]
    assert rows == [("gpt-5", 0.79, None, None), ("gpt-5.1", 0.80, 42, "test")]
    assert M.read_metrics_csv(spark, str(tmp_path / "none.csv"), schema).count() == 0


def test_report_file(spark, tmp_path):
    path = str(tmp_path / "report")
    frame = spark.createDataFrame([("m", {"b": 1.0, "a": 2.0}, ["x"])],
                                  "model STRING, best MAP<STRING, DOUBLE>, members ARRAY<STRING>")
    M.write_report(frame, path)
    row = spark.read.options(header=True, escape='"').csv(path).first()
    assert row["members"] == '["x"]' and row["best"] == '{"a":2.0,"b":1.0}'


def test_scratch_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch.new_path(spark, "x")
    assert folder is None or path.startswith(folder)
    back = scratch.written(spark.range(3), "x")
    assert back.count() == 3 and back.dtypes == [("id", "bigint")]
