from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gazette.operators import labelling as lab
from gazette.operators import zero_shot as Z
from gazette.streaming import incremental

CASES = [
    ('{"political": 1}', "stop", 1, "ok"), ('{"political": "0"}', "stop", 0, "ok"),
    ('Sure: {"political": 0} ok', "stop", 0, "ok"), ('{"label": 1}', "stop", 1, "ok"),
    ('{"a": 1, "b": 0}', "stop", None, "missing_key"), ('{"political": 7}', "stop", None, "bad_value"),
    ("", "length", None, "retry_longer"), ("", "stop", None, "empty"),
    (None, "stop", None, "empty"), (" \n", "length", None, "retry_longer"),
    ('{"political": ', "length", None, "retry_longer"), ("no idea", "stop", None, "retry_longer"),
    ('{"political": true}', "stop", 1, "ok"), ('{"political": 0.7}', "stop", None, "bad_value"),
    ('{"political": null, "x": 1}', "stop", None, "bad_value"), ("{}", "stop", None, "missing_key"),
    ('{"political": "yes"}', "stop", None, "bad_value"), ("[1]", "stop", None, "retry_longer"),
    ('```json\n{"political": 1}\n```', "stop", 1, "ok"),
]


def test_replies(spark):
    rows = [(i, r, f) for i, (r, f, _, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "id BIGINT, reply STRING, finish_reason STRING")
    got = {r["id"]: (r["y_pred"], r["status"]) for r in
           lab.parse_replies(frame, "political").collect()}
    for i, case in enumerate(CASES):
        assert got[i] == case[2:], case
    retry = lab.retry_table(lab.parse_replies(frame, "political").withColumn(
        "max_tokens", F.lit(1500)))
    assert {r["next_max_tokens"] for r in retry.collect()} == {2048}
    with pytest.raises(ValueError):
        lab.parse_replies(frame, "sports")


def test_prompts(spark):
    long = "w " * 50_000
    frame = spark.createDataFrame([(1, long), (2, "{txt} {x}")], "id BIGINT, description STRING")
    got = {r["id"]: r["prompt"] for r in lab.prompt_table(frame, "domestic").collect()}
    assert got[1].endswith(long) and '{"domestic": 1}' in got[2]
    with pytest.raises(ValueError):
        lab.prompt_table(frame, "domestic", " ")


def test_resume(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(6)], "id BIGINT, y_true INT")
    done = spark.createDataFrame([(4, 0), (1, 0), (9, 1)], "id BIGINT, y_true INT")
    assert sorted(r["id"] for r in lab.todo(rows, done).collect()) == [0, 2, 3, 5]
    assert tuple(lab.resume_check(rows, done).first()) == (1, 1, 1)
    assert tuple(lab.progress(rows, done).first()) == (2, 4)


def test_zero_shot_with_a_user_model(spark):
    frame = spark.createDataFrame([(1, "a vote"), (2, "a goal"), (3, "tie")],
                                  "id BIGINT, description STRING")

    def scorer(texts: pd.Series, labels: pd.Series) -> pd.Series:
        return pd.Series([1.0 if ("vote" in t) == (c == "political") and t != "tie" else 0.0
                          for t, c in zip(texts, labels)])

    got = {r["id"]: r["y_pred"] for r in Z.zero_shot(frame, "political", scorer).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def reply_file(spark, path, rows):
    spark.createDataFrame(rows, incremental.REPLY_SCHEMA).coalesce(1).write.mode("append").parquet(
        path)


def test_stream_stores_every_id_once(spark, tmp_path):
    source, out, point = (str(tmp_path / n) for n in ("in", "out", "check"))
    reply_file(spark, source, [(1, 1, '{"political": 1}', "stop"), (2, 0, "", "length")])

    def run():
        stream = incremental.read_replies(spark, source, files_per_batch=1)
        incremental.score_stream(stream, "political", out, point).awaitTermination()
        return sorted((r["id"], r["y_pred"]) for r in spark.read.parquet(out).collect())

    assert run() == [(1, 1)]
    # A second run brings the retried reply, and id 1 again with another answer.
    reply_file(spark, source, [(2, 0, '{"political": 0}', "stop"), (1, 1, '{"political": 0}', "stop"),
                               (3, 1, '{"political": 1}', "stop"), (3, 1, '{"political": 1}', "stop")])
    assert run() == [(1, 1), (2, 0), (3, 1)]
    assert run() == [(1, 1), (2, 0), (3, 1)]


def test_a_repeated_batch_leaves_no_duplicate(spark, tmp_path):
    out = str(tmp_path / "out")
    first = spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "id BIGINT, y_true INT, y_pred INT")
    incremental.append_new(first, 0, out)
    incremental.append_new(first, 0, out)
    incremental.append_new(first.union(first.withColumn("id", F.col("id") + 1)), 1, out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
