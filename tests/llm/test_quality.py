from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from gazette.llm import quality
from odd import no_documents, odd_documents


def corpus(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioutrnsl") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = []
    for i in range(10, 210):
        picked = [rng.choice(words) for _ in range(120)]
        rows.append((i, " ".join(picked) if i % 5 else "%%% ".join(picked)))
    labels = spark.createDataFrame(
        [(i, int(i % 5 > 0)) for i in range(10, 110)] + [(12, None), (None, 1), (10, 0)],
        "doc_id bigint, quality int")
    return odd_documents(spark, rows), labels


def test_junk_is_rejected_and_clean_documents_stay(spark):
    docs, labels = corpus(spark)
    out = quality.resampled(docs, labels)
    assert out.columns == [*docs.columns, "log_weight", "sample_key", "selected"]
    got = {r.doc_id: r.selected for r in out.where("doc_id >= 10").collect()}
    # Held out are those without a label.
    assert all(got[i] == (i % 5 > 0) for i in range(110, 210))
    assert out.count() == docs.count()


def test_without_labels_nothing_is_rejected(spark):
    docs, labels = corpus(spark)
    assert quality.resampled(docs, labels.limit(0)).where("NOT selected").count() == 0
    assert quality.resampled(no_documents(spark), labels).count() == 0


def test_gumbel_top_k_draws_in_proportion(spark):
    ids = spark.range(40_000)
    weight = F.when(F.col("id") % 2 == 0, F.log(F.lit(3.0))).otherwise(F.lit(0.0))
    keyed = ids.select("id", (weight + quality.gumbel(F.col("id"), 3)).alias("key"))
    cut = quality.kth_largest(keyed, "key", 400)
    drawn = keyed.where(F.col("key") >= cut)
    assert drawn.count() == 400
    assert abs(drawn.where("id % 2 = 0").count() / 400 - 0.75) < 0.07


def test_kth_largest_is_exact(spark):
    values = np.random.default_rng(1).normal(size=30_000).round(3)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in (1, 17, 15_000, 30_000):
        assert quality.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]
