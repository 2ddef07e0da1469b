from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gazette.functions import text as X
from gazette.operators import eda, splits
from gazette.sources import articles as A

SCHEMA = "id STRING, description STRING, date STRING, headline STRING, political STRING, domestic STRING"
ROWS = [
    ("1.0", "De regering  beslist vandaag", "31/12/2005", "Regering", "1", "1"),
    ("2.0", None, "01/02/2006", None, "0", "1"),
    ("3.0", "x", "05/06/2004", "h", "99", "1"),
    ("4.0", "x", "05/06/2004", "h", "n/a", "0"),
    ("5.0", "x", "05/06/2004", "h", "1", None),
    ("6.0", "x", "not a date", "h", "1.0", "0.0"),
    ("7.0", "x", "05/06/2004", "h", "2", "1"),
    ("8.0", "x", "05/06/2004", "h", "nan", "1"),
    ("9007199254740993", "x", "5-6-2004", "h", " 1 ", "0"),
]


@pytest.fixture(scope="module")
def cleaned(spark):
    return A.clean_articles(spark.createDataFrame(ROWS, SCHEMA))


def test_rows_lost_for_one_target_are_lost_for_both(cleaned):
    got = {r["id"]: (r["political"], r["domestic"]) for r in cleaned.collect()}
    assert got == {1: (1, 1), 2: (0, 1), 6: (1, 0), 7: (2, 1), 9007199254740993: (1, 0)}


def test_features_and_view(cleaned):
    rows = {r["id"]: r for r in A.with_features(cleaned).collect()}
    assert rows[2]["description"] == "" and rows[2]["headline"] == ""
    assert {i: r["year"] for i, r in rows.items()} == {
        1: "2005", 2: "2006", 6: "-1", 7: "2004", 9007199254740993: "2004"}
    view = {r["id"]: r for r in eda.article_view(cleaned).collect()}
    assert view[1]["desc_tokens"] == 4 and view[2]["desc_tokens"] == 0
    assert view[2]["date_dt"].month == 2
    assert view[1]["desc_tokens_log1p"] == pytest.approx(math.log(5))


def test_absent_columns(spark):
    bare = spark.createDataFrame([(1, "a")], "id BIGINT, description STRING")
    assert A.with_features(bare).first().asDict() == {
        "id": 1, "description": "a", "headline": "", "year": "-1"}
    with pytest.raises(KeyError):
        A.clean_articles(bare)
    with pytest.raises(KeyError):
        A.clean_articles(bare.drop("description"))
    with pytest.raises(ValueError):
        A.target_rows(bare, "sports")


def test_date_assertion_fails_the_job(cleaned):
    assert eda.date_check(cleaned).first()["unreadable"] == 1
    eda.require_dates(cleaned.filter("id < 6")).collect()
    with pytest.raises(Exception, match="some dates failed"):
        eda.require_dates(cleaned).collect()


def test_label_domain_shows_unexpected_values(cleaned):
    rows = {(r["label"], r["value"]): r["n"] for r in eda.label_domain(cleaned).collect()}
    assert rows[("political", "2")] == 1


def test_null_profile(spark):
    rows = {r["column"]: (r["type"], r["nulls"], r["n"])
            for r in eda.null_profile(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert rows["headline"] == ("string", 1, 9) and rows["id"] == ("string", 0, 9)


@pytest.mark.parametrize("text,tokens", [
    ("a b", 2), ("", 0), ("  \n\t ", 0), ("a b c", 3), ("a\x1cb", 2), ("x", 1),
    ("　a　", 1), ("a​b", 1)])
def test_token_count_is_python_split(spark, text, tokens):
    assert len(text.split()) == tokens
    row = spark.createDataFrame([(text,)], "t STRING").select(
        X.token_count(F.col("t")).alias("n"), X.collapse_spaces(F.col("t")).alias("flat")).first()
    assert row["n"] == tokens and row["flat"] == " ".join(text.split())


def test_every_space_character(spark):
    chars = [chr(i) for i in range(1, 0x3100)] + ["\ufeff", "\U0001f600"]
    rows = [(f"x{c}y", len(f"x{c}y".split())) for c in chars]
    frame = spark.createDataFrame(rows, "t STRING, n INT")
    assert frame.filter(X.token_count(F.col("t")) != F.col("n")).count() == 0


def test_short_text(spark):
    texts = ["x" * 181, "x" * 180, "a \n b", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    got = [r["s"] for r in frame.select("i", X.short_text(F.col("t")).alias("s")).orderBy("i")
           .collect()]
    assert got == ["x" * 177 + "...", "x" * 180, "a b", None]


def test_split_is_stable_under_partitioning(spark):
    ids = spark.range(2000)
    one = {r["id"]: r["split"] for r in splits.with_split(ids.coalesce(1)).collect()}
    many = {r["id"]: r["split"] for r in splits.with_split(ids.repartition(7)).collect()}
    assert one == many
    share = sum(v == "test" for v in one.values()) / 2000
    assert 0.15 < share < 0.25


@pytest.mark.parametrize("n,size", [(1, 0.2), (7, 0.2), (100, 0.25), (19319, 0.2)])
def test_exact_split_size(spark, n, size):
    got = splits.exact_split(spark.range(n), test_size=size).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got}.get("test") == math.ceil(size * n)


def deal(labels, k):
    """Stratified folds by dealing sorted labels in turn; classes in order of appearance."""
    order = list(dict.fromkeys(labels))
    ranked = sorted(order.index(x) for x in labels)
    share = [[sum(1 for i in range(f, len(ranked), k) if ranked[i] == c) for f in range(k)]
             for c in range(len(order))]
    queue = {c: [f for f in range(k) for _ in range(share[c][f])] for c in range(len(order))}
    return [queue[order.index(x)].pop(0) for x in labels]


@pytest.mark.parametrize("labels,k", [
    ([1, 0, 0, 1, 1, 1, 0, 1, 1, 1, 1, 0], 5),
    ([0] * 7 + [1] * 5, 5), ([0] * 6 + [1] * 6, 5), ([1, 0, 2, 2, 1, 0, 0, 0, 1, 1, 2], 3),
    ([1] * 40 + [0] * 3, 4)])
def test_folds_match_dealing(spark, labels, k):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "id BIGINT, y INT")
    got = {r["id"]: r["fold"] for r in splits.stratified_folds(frame, "y", k).collect()}
    assert [got[i] for i in range(len(labels))] == deal(labels, k)


def test_shuffled_folds_keep_class_shares(spark):
    frame = spark.range(500).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    folds = splits.stratified_folds(frame, "y", 5, seed=1)
    sizes = [r["count"] for r in folds.groupBy("y", "fold").count().collect()]
    assert sorted(sizes) == [33, 33, 33, 34, 34] + [66, 66, 67, 67, 67]
    assert folds.filter("id < 100").select("fold").distinct().count() == 5


def test_scope(spark):
    rows = splits.with_split(spark.range(10))
    assert splits.scope_rows(rows, "all").count() == 10
    with pytest.raises(ValueError):
        splits.scope_rows(rows, "train")
