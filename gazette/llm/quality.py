"""Importance resampling of documents towards a target, by hashed n-gram models and Gumbel top-k.

Two bag-of-n-grams models share ``BUCKETS`` hash buckets of byte n-grams (one to three bytes), and
one bucket for a word that repeats the word before it: *target*, from labelled good documents, and
*raw*, from all documents. A document's weight is the mean over its n-grams of
``ln P(target) - ln P(raw)``, times ``SCALE``, so texts of any length are on one scale. Sampling
without replacement in proportion to ``exp(weight)`` is taking the ``k`` largest of
``weight + Gumbel noise``; the noise comes from the hash of the id, so a rerun draws the same.

``k`` is the number of documents whose weight reaches a cut between labelled good and bad
documents: the middle of the range that separates them best. Without labels of both kinds nothing
is rejected.

The target model and the cut use a bounded sample of labelled rows, the ``LABELLED`` smallest by
the hash of the id; the raw model and all weights cover every document. NULL and empty texts have
no n-grams and weight 0. Rows without an id are judged as others are. Rows whose keys tie with the
k-th all stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import slices, with_results
from gazette.shipping import ship_package
from gazette.sources.scratch import written

BUCKETS = 1 << 14
SCALE = 1000.0
LABELLED = 50_000
# A repeated word weighs as much as the bytes it stands for.
REPEAT_WEIGHT = 8
SMOOTHING = 1.0


def gram_counts(text: str) -> np.ndarray:
    """Counts per bucket; the last bucket is for repeated words."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    parts, code = [], raw
    for n in (1, 2, 3):
        if len(raw) < n:
            break
        if n > 1:
            code = code[:-1] * np.uint32(257) + raw[n - 1:]
        parts.append((code + np.uint32(7919 * n)) * np.uint32(2654435761) >> np.uint32(18))
    counts = np.zeros(BUCKETS + 1)
    if parts:
        counts[:BUCKETS] = np.bincount(np.concatenate(parts), minlength=BUCKETS)
        words = text.split()
        counts[BUCKETS] = REPEAT_WEIGHT * sum(map(str.__eq__, words, words[1:]))
    return counts


def sampled_labels(labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids with one label each (the smallest of several)."""
    named = labels.select(F.col(id_col).cast("bigint").alias("id"),
                          F.col(label_col).cast("int").alias("label")).dropna()
    return named.groupBy("id").agg(F.min("label").alias("label")).orderBy(
        F.xxhash64("id"), "id").limit(bound)


def log_ratios(docs: DataFrame, text_col: str, good: Column) -> np.ndarray:
    """``ln P(target) - ln P(raw)`` per bucket. One row per bucket and partition is shuffled."""

    def run(batches):
        total = np.zeros((2, BUCKETS + 1))
        for part in slices(batches):
            marks = part.column(1).to_pylist()
            for text, mark in zip(part.column(0).to_pylist(), marks, strict=True):
                counts = gram_counts(text or "")
                total[0] += counts
                if mark:
                    total[1] += counts
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])],
            ["bucket", "raw", "target"])

    ship_package(docs.sparkSession)
    counted = docs.select(F.col(text_col), F.coalesce(good, F.lit(False))).mapInArrow(
        run, "bucket bigint, raw double, target double")
    rows = counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for bucket, r, t in rows:
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(BUCKETS + 1)
    share = [np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * len(c))) for c in (target, raw)]
    return share[0] - share[1]


def gumbel(id_: Column, seed: int) -> Column:
    """Standard Gumbel noise from the hash of an id."""
    uniform = (F.shiftrightunsigned(F.xxhash64(id_, F.lit(seed)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def best_cut(scored: DataFrame) -> float | None:
    """The middle of the range of weights that tells labels 1 from 0 best (balanced accuracy).

    Works on one row per whole weight between -10,000 and 10,000.
    """
    whole = F.round(F.greatest(F.lit(-1e4), F.least(F.lit(1e4), "weight"))).cast("int")
    rows = scored.where("label IS NOT NULL").groupBy(whole.alias("w")).agg(
        F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("label") > 0, 0).otherwise(1)).alias("bad")).orderBy("w").collect()
    good, bad = sum(r.good for r in rows), sum(r.bad for r in rows)
    if not good or not bad:
        return None
    below_good = below_bad = 0
    best, cut = -1.0, None
    for row, following in zip(rows, rows[1:]):
        below_good += row.good
        below_bad += row.bad
        accuracy = (good - below_good) / good + below_bad / bad
        if accuracy > best:
            best, cut = accuracy, (row.w + following.w) / 2
    return cut


def kth_largest(frame: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest value: bins are counted and refined until a bin is small."""
    value, above = F.col(column), 0
    while True:
        low, high, n = frame.agg(F.min(value), F.max(value), F.count(value)).first()
        if low == high or n <= 10_000:
            last = frame.select(value).orderBy(value.desc()).limit(k - above).agg(
                F.min(value)).first()[0]
            return low if low == high else last
        at = F.least(F.lit(511), F.floor((value - low) * (512 / (high - low)))).cast("int")
        bins = frame.groupBy(at.alias("bin")).agg(
            F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
        ).orderBy(F.desc("bin")).collect()
        for b in bins:
            if above + b.n >= k:
                frame = frame.where((value >= b.low) & (value <= b.high))
                break
            above += b.n


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", labelled: int = LABELLED, seed: int = 11
              ) -> DataFrame:
    """All rows and columns of ``docs`` plus ``log_weight``, ``sample_key`` and ``selected``."""
    sample = written(sampled_labels(labels, id_col, label_col, labelled), "labels")
    # At most ``labelled`` rows of 12 bytes.
    docs = docs.drop("log_weight", "sample_key", "selected")
    marked = docs.withColumn("_sample_id", F.col(id_col).cast("bigint")).join(
        F.broadcast(sample.toDF("_sample_id", "_sample_label")), "_sample_id", "left")
    ratio = docs.sparkSession.sparkContext.broadcast(
        log_ratios(marked, text_col, F.col("_sample_label") > 0))

    def work(texts: list[str]) -> dict[str, list]:
        out = []
        for text in texts:
            counts = gram_counts(text)
            out.append(SCALE * float(counts @ ratio.value) / max(1.0, counts.sum()))
        return {"log_weight": out}

    weighed = with_results(marked, work, "log_weight double", text_col).withColumn(
        "sample_key", F.col("log_weight") + gumbel(F.col("_sample_id"), seed))
    scored = written(weighed.select(F.col("log_weight").alias("weight"),
                                    F.col("_sample_label").alias("label"), "sample_key"), "weights")
    cut = best_cut(scored)
    k = scored.where(F.col("weight") >= cut).count() if cut is not None else 0
    floor = kth_largest(scored, "sample_key", k) if k else float("-inf")
    return weighed.withColumn("selected", F.col("sample_key") >= F.lit(floor)).select(
        *docs.columns, "log_weight", "sample_key", "selected")
