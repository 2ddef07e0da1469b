from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check_queries import TABLES, rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("clean_labels", "article_features", "exact_split", "stratified_folds", "describe_tokens",
          "spearman", "chi2_phi", "char_wb_headlines", "tfidf_weights", "nb_predict",
          "classification_report", "roc_points", "average_precision", "majority_vote",
          "metrics_union", "best_epoch", "parse_replies", "resume_check", "zero_shot_label",
          "year_one_hot", "csv_articles", "incremental_scores")

needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables absent")


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) > 80


def test_nothing_is_looked_up_beside_the_installed_spark(monkeypatch, tmp_path):
    import pyspark

    from gazette.functions.text import english_stop_words
    from gazette.operators.candidates import candidates

    monkeypatch.setattr(pyspark, "__file__", str(tmp_path / "pyspark" / "__init__.py"))
    assert len(english_stop_words()) == 181
    assert candidates() and entry.queries() and entry.oracle_sql()


@needs_data
def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["id", "y_true", "y_pred", "score"] and frame.count() > 0


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = rows_of(entry.queries()[name](spark, FOLDER).toPandas())
    assert got == rows_of(db.execute(entry.oracle_sql()[name]).df())
    assert got[1]


@needs_data
@pytest.mark.parametrize("name", ["exact_split", "roc_points", "tfidf_weights"])
def test_results_do_not_depend_on_partitions(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(rows_of(entry.queries()[name](spark, FOLDER).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
