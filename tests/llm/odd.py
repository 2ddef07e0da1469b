"""Rows that every operator on documents must survive."""

from __future__ import annotations

LONG = "lorem ipsum dolor " * 4000
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, "
          "ids string, spans string, component_id string, word string, label string, s string")


def odd_documents(spark, rows=()):
    """NULLs, empty, blank, very long, repeated and tied rows, and columns with clashing names."""
    texts = [(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "same words in two rows, twice"),
             (5, "same words in two rows, twice"), (6, "same words in two rows, twice"),
             (None, "a row without an id"), (None, None), (7, "one"), *rows]
    return spark.createDataFrame(
        [(i, t, "en", None, None, "x", "x", "x", "x", "x", "x") for i, t in texts], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
