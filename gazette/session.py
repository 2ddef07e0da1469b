"""Session settings the jobs are tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Cutting texts into n-grams makes far more than was shuffled: keep small shuffles spread over
    # all cores. Large ones are sized by the total over the cluster's parallelism anyway.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # Vocabularies and per-class weights are bounded tables (see operators/terms.py); let a
    # written one of up to 64 MB be broadcast, anything larger falls back to a shuffle join.
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "gazette", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; on a cluster leave ``master`` to spark-submit.

    ``conf`` keys use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions="4000"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
