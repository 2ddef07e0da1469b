from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gazette.functions import text as X
from gazette.operators import naive_bayes as NB
from gazette.operators import terms as T


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)],
                                 "id BIGINT, description STRING")


def tokens_of(spark, text, stops=None):
    return docs(spark, [text]).select(X.word_tokens(F.col("description"), stops)).first()[0]


def test_word_tokens(spark):
    assert tokens_of(spark, "De a regering's EU-top 2005_x") == [
        "de", "regering", "eu", "top", "2005_x"]


@pytest.mark.parametrize("text,low,high,stops,want", [
    ("eu top nu", 1, 2, None, ["eu", "top", "nu", "eu top", "top nu"]),
    ("eu top nu", 1, 2, ["top"], ["eu", "nu", "eu nu"]),
    ("eu", 1, 2, None, ["eu"]), ("", 1, 3, None, []),
    ("aa bb cc dd", 2, 3, None, ["aa bb", "bb cc", "cc dd", "aa bb cc", "bb cc dd"])])
def test_word_ngrams(spark, text, low, high, stops, want):
    tokens = X.word_tokens(F.col("description"), stops)
    assert docs(spark, [text]).select(X.word_ngrams(tokens, low, high)).first()[0] == want


def char_grams(text, low=3, high=5):
    """The rule on plain strings: slide over padded words; a short word is one gram."""
    out = {}
    for word in text.lower().split():
        padded = f" {word} "
        for n in range(low, high + 1):
            grams = [padded[i:i + n] for i in range(len(padded) - n + 1)] or (
                [padded] if n == low else [])
            for g in grams:
                out[g] = out.get(g, 0) + 1
    return out


@pytest.mark.parametrize("low,high", [(3, 5), (5, 6)])
def test_char_grams(spark, low, high):
    rng = random.Random(3)
    texts = ["a", "ab", "abc", "Aan AAN aan é", " \n ", ""] + [
        " ".join("".join(rng.choice("abé") for _ in range(rng.randint(1, 9))) for _ in range(20))
        for _ in range(15)]
    settings = T.TermSettings(analyzer=T.CHAR_WB, low=low, high=high)
    got: dict = {}
    for r in T.term_counts(docs(spark, texts), settings).collect():
        got.setdefault(r["id"], {})[r["term"]] = r["tf"]
    assert [got.get(i, {}) for i in range(len(texts))] == [char_grams(t, low, high) for t in texts]
    if low == 3:
        assert got[2] == {" ab": 1, "abc": 1, "bc ": 1, " abc": 1, "abc ": 1, " abc ": 1}


def test_df_limits(spark):
    counts = T.term_counts(docs(spark, ["aa bb cc", "aa bb", "aa dd", "aa"]), T.TermSettings())
    kept = T.fit_vocabulary(counts, 4, T.TermSettings(min_df=0.5, max_df=0.9))
    assert [r["term"] for r in kept.collect()] == ["bb"]
    top = T.fit_vocabulary(counts, 4, T.TermSettings(min_df=0.1, max_df=1.0, max_features=3))
    assert sorted(r["term"] for r in top.collect()) == ["aa", "bb", "cc"]


def test_tfidf(spark):
    counts = T.term_counts(docs(spark, ["aa bb bb", "aa cc", ""]).filter("id < 2"),
                           T.TermSettings())
    settings = T.TermSettings(min_df=0.0, max_df=1.0)
    vocabulary = T.fit_vocabulary(counts, 2, settings)
    got = {(r["id"], r["term"]): r["weight"]
           for r in T.term_weights(counts, vocabulary, settings).collect()}
    assert got == {(0, "aa"): pytest.approx(0.387411, abs=1e-6),
                   (0, "bb"): pytest.approx(0.921907, abs=1e-6),
                   (1, "aa"): pytest.approx(0.579739, abs=1e-6),
                   (1, "cc"): pytest.approx(0.814802, abs=1e-6)}


def test_naive_bayes(spark):
    table = docs(spark, ["aa bb", "aa aa", "cc", "zz"])
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "id BIGINT, label INT")
    settings = T.TermSettings(min_df=0.0, max_df=1.0, tfidf=False)
    counts = T.term_counts(table, settings)
    vocabulary = T.fit_vocabulary(counts.filter("id < 3"), 3, settings)
    weights = T.term_weights(counts, vocabulary, settings)
    model = NB.train(weights.filter("id < 3"), labels)
    priors = model.priors.first()
    assert priors["prior_1"] == pytest.approx(math.log(2 / 3))
    assert priors["prior_0"] == pytest.approx(math.log(1 / 3))
    got = {r["term"]: (r["log_prob_0"], r["log_prob_1"]) for r in model.terms.collect()}
    assert got == {"aa": (pytest.approx(-1.386294, abs=1e-6), pytest.approx(-0.559616, abs=1e-6)),
                   "bb": (pytest.approx(-1.386294, abs=1e-6), pytest.approx(-1.252763, abs=1e-6)),
                   "cc": (pytest.approx(-0.693147, abs=1e-6), pytest.approx(-1.945910, abs=1e-6))}
    out = {r["id"]: r for r in NB.predict(model, table.select("id"), weights).collect()}
    assert [out[i]["y_pred"] for i in range(4)] == [1, 1, 0, 1]
    # A document without known terms falls back on the priors.
    assert out[3]["score"] == pytest.approx(math.log(2))


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    assert X.english_stop_words() == StopWordsRemover.loadDefaultStopWords("english")


def test_names(spark):
    assert X.name_list("a, b,,c ") == ["a", "b", "c"]
    row = spark.createDataFrame([("a, b,,c ", "x/y")], "n STRING, p STRING").select(
        X.split_names(F.col("n")), X.safe_name(F.col("p")),
        X.truncate_tokens(F.col("n"), 2)).first()
    assert tuple(row) == (["a", "b", "c"], "x_y", "a, b,,c")


def test_python_word_rule(spark):
    text = "L'élève_1 naïve x yy Ünïcode ½a 漢字 a1 ² ٣٤"
    assert tokens_of(spark, text) == re.findall(r"\b\w\w+\b", text.lower())


def test_text_shuffles_once(spark):
    """Counting, norms and grouping per document reuse the partitioning by document."""
    settings = T.TermSettings(analyzer=T.CHAR_WB, low=3, high=5)
    plan = T.term_counts(docs(spark, ["a b"]), settings)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning") == 1


def test_more_text_is_counted_in_more_parts(spark, monkeypatch):
    rows = docs(spark, ["aa bb aa cc"] * 60 + [None, ""])
    want = {(i, t): n for i in range(60) for t, n in (("aa", 2), ("bb", 1), ("cc", 1))}
    monkeypatch.setattr(T, "PART_CHARS", 66, raising=False)
    counts = T.term_counts(rows, T.TermSettings())
    assert counts.rdd.getNumPartitions() == 11
    assert {(r["id"], r["term"]): r["tf"] for r in counts.collect()} == want


def test_character_grams_are_counted_in_smaller_parts_than_words(spark, monkeypatch):
    monkeypatch.setattr(T, "PART_CHARS", 200)
    docs = spark.createDataFrame([(i, "some words here") for i in range(100)],
                                 "id int, description string")
    parts = {a: T.term_counts(docs, T.TermSettings(analyzer=a, low=3, high=5)).rdd
             .getNumPartitions() for a in (T.WORD, T.CHAR_WB)}
    assert parts == {T.WORD: 1 + 1500 // 200, T.CHAR_WB: 1 + 1500 // 50}
