"""Term counts, vocabularies and weights in long form ``(id, term, ...)``.

Scale: the text is shuffled once, by document, and its terms are counted there. What travels next
is one pre-aggregated row per term and task. ``term_weights`` joins the vocabulary and takes the
norm in a window per document, which exchanges the known terms again where they were written in
between: training keeps a document's terms in one row instead (see ``term_rows``).

A vocabulary is bounded whatever the corpus size: every kept term is in at least
``min_df`` x n documents, so it has at most (mean distinct terms per document) / ``min_df``
terms. It is written once, and Catalyst broadcasts it if the written size allows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.functions.text import SPACE_RUN, word_ngrams, word_tokens
from gazette.sources.scratch import written

WORD = "word"
CHAR_WB = "char_wb"
# Characters whose terms one task counts at a time, and how many times fewer where every
# character begins several grams.
PART_CHARS = 4 << 20
CHAR_WB_SHARE = 4


@dataclass(frozen=True)
class TermSettings:
    """How texts become weighted terms. ``min_df`` and ``max_df`` are shares of documents."""

    analyzer: str = WORD
    low: int = 1
    high: int = 1
    min_df: float = 0.001
    max_df: float = 0.9
    max_features: int | None = None
    stop_words: tuple[str, ...] | None = None
    tfidf: bool = True
    sublinear: bool = True

    @property
    def counting(self) -> tuple:
        """Settings with equal counting share one table of term counts."""
        return self.analyzer, self.low, self.high, self.stop_words


def term_counts(docs: DataFrame, settings: TermSettings, text: str = "description") -> DataFrame:
    """``id, term, tf`` for every document that has terms."""
    part_chars = PART_CHARS // CHAR_WB_SHARE if settings.analyzer == CHAR_WB else PART_CHARS
    by_document = _dealt(docs.select("id", text), text, part_chars)
    if settings.analyzer == WORD:
        tokens = word_tokens(F.col(text), settings.stop_words)
        grams = by_document.select(
            "id", F.explode(word_ngrams(tokens, settings.low, settings.high)).alias("term"))
        return grams.groupBy("id", "term").agg(F.count("*").alias("tf"))
    if settings.analyzer == CHAR_WB:
        return _char_counts(by_document, text, settings.low, settings.high)
    raise ValueError(f"unknown analyzer {settings.analyzer!r}")


def _dealt(docs: DataFrame, text: str, part_chars: int) -> DataFrame:
    """Documents by id, in more parts than a shuffle has by default where texts are many: what a
    task holds while it counts then stays the same, however large the table is."""
    chars = docs.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    parts = 1 + chars // part_chars
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(parts, "id") if parts > usual else docs.repartition(F.col("id"))


def _char_counts(docs: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """Character n-grams inside space-padded words.

    Words of a document are counted first, so a word that comes back costs its grams once. A
    padded word shorter than ``low`` is itself the only gram.
    """
    words = (docs.select("id", F.explode(F.split(F.lower(F.col(text)), SPACE_RUN)).alias("word"))
             .filter(F.col("word") != "")
             .groupBy("id", "word").agg(F.count("*").alias("times")))
    padded = words.select("id", "times", F.concat(F.lit(" "), "word", F.lit(" ")).alias("padded"))
    sizes = padded.select("*", F.explode(F.array(*[F.lit(n) for n in range(low, high + 1)]))
                          .alias("size"))
    length = F.length("padded")
    fits = (F.col("size") <= length) | (F.col("size") == low)
    spots = sizes.filter(fits).select(
        "id", "times", "padded", "size",
        F.explode(F.sequence(F.lit(1), F.greatest(length - F.col("size") + 1, F.lit(1))))
        .alias("spot"))
    return (spots.select("id", "times", F.expr("substring(padded, spot, size)").alias("term"))
            .groupBy("id", "term").agg(F.sum("times").alias("tf")))


def document_frequency(counts: DataFrame) -> DataFrame:
    """``term, df, total``: documents holding the term, and its occurrences."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def limit_terms(frequencies: DataFrame, n: Column, settings: TermSettings) -> DataFrame:
    """Terms within the document-frequency limits, then the most frequent ``max_features``."""
    kept = frequencies.filter((F.col("df") >= F.lit(settings.min_df) * n)
                              & (F.col("df") <= F.lit(settings.max_df) * n))
    if settings.max_features is not None:
        kept = kept.orderBy(F.desc("total"), "term").limit(settings.max_features)
    return kept


def fit_vocabulary(counts: DataFrame, n: Column | int, settings: TermSettings) -> DataFrame:
    """``term, df, total, idf`` learned from training counts; a written table.

    ``n`` is the number of training documents, those without any term included.
    """
    n = F.lit(n) if isinstance(n, int) else n
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    vocabulary = limit_terms(document_frequency(counts), n, settings).withColumn("idf", idf)
    return written(vocabulary, "vocabulary")


def document_count(docs: DataFrame) -> Column:
    """The number of documents as a scalar subquery."""
    return docs.agg(F.count("*")).scalar()


def term_weights(counts: DataFrame, vocabulary: DataFrame, settings: TermSettings) -> DataFrame:
    """The known terms of ``counts`` with ``weight``: TF-IDF rows of length 1, or raw counts.

    Other columns of the vocabulary (an index) come along.
    """
    known = counts.join(vocabulary.drop("df", "total"), "term")
    if not settings.tfidf:
        return known.withColumn("weight", F.col("tf").cast("double")).drop("idf")
    tf = F.col("tf").cast("double")
    raw = ((1 + F.log(tf)) if settings.sublinear else tf) * F.col("idf")
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(W.partitionBy("id")))
    return (known.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / norm)
            .drop("_raw", "idf"))
