"""Incremental labelling: new reply files become stored predictions, each id once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gazette.functions.replies import OK
from gazette.operators.labelling import parse_replies
from gazette.shipping import ship_package
from gazette.sources.metrics_log import is_absent

EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
REPLY_SCHEMA = "id BIGINT, y_true INT, reply STRING, finish_reason STRING"


def read_replies(spark: SparkSession, path: str, schema: str = REPLY_SCHEMA,
                 files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of raw replies as a stream."""
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return None


def append_new(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write the ids of a batch that are not stored yet.

    Every batch owns the folder ``batch=<id>``, and writing a batch again replaces only that
    folder: after a crash the repeated batch leaves no duplicate. Ids stored by other batches
    are removed by an anti join.
    """
    spark = batch.sparkSession
    # Of several rows with one id the smallest stays, whatever the order of the tasks.
    others = [c for c in batch.columns if c != "id"]
    fresh = batch.groupBy("id").agg(F.min(F.struct(*others)).alias("row")).select("id", "row.*")
    stored = _stored(spark, path)
    if stored is not None:
        earlier = stored.filter(F.col("batch") != batch_id).select("id")
        fresh = fresh.join(earlier, "id", "left_anti")
    append_batch(fresh, batch_id, path)


def first_of_each_id(rows: DataFrame, horizon_hours: float) -> DataFrame:
    """Of a stream, the first row of every id; later ones within the horizon are dropped.

    The state store keeps one mark per id, keyed by it, so a batch looks up its own ids only,
    however many were stored before. A mark ends ``horizon_hours`` after the last row of its id;
    an id that comes back later counts as new. Of several rows with one id in a batch the smallest
    stays (NULLs first). An id with very many rows is read as a stream, one row held.
    """
    columns = rows.columns
    others = [c for c in columns if c != "id"]
    wait = int(horizon_hours * 3_600_000)

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState
             ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = None
        for frame in frames:
            if not state.exists:
                both = frame if best is None else pd.concat([best, frame])
                best = both.sort_values(others, na_position="first").head(1)
        state.update((True,))
        state.setTimeoutDuration(wait)
        if best is not None:
            yield best[columns]

    ship_package(rows.sparkSession)
    return rows.groupBy("id").applyInPandasWithState(
        keep, rows.schema, "seen boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def append_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch of rows that are new already; a repeated batch replaces its own folder."""
    (batch.withColumn("batch", F.lit(batch_id).cast("bigint")).write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(path))


def score_stream(replies: DataFrame, target: str, out: str, checkpoint: str,
                 transform: Callable[[DataFrame], DataFrame] | None = None,
                 horizon_hours: float | None = None) -> StreamingQuery:
    """Parse all available replies, append ``id, y_true, y_pred``; the checkpoint is the resume.

    Replies that need a retry are left out, so a later file can still bring their id.
    ``transform`` replaces the parser, e.g. by a fitted model's ``transform``. With
    ``horizon_hours`` ids are known from the state store, and the work of a batch depends on the
    batch alone (see ``first_of_each_id``). Without it they are known for ever, from what is
    stored, which every batch joins with.
    """
    if transform is None:
        parsed = parse_replies(replies, target).filter(F.col("status") == OK)
        rows = parsed.select("id", "y_true", "y_pred")
    else:
        rows = transform(replies)
    append = append_new
    if horizon_hours is not None:
        rows, append = first_of_each_id(rows, horizon_hours), append_batch
    conf = rows.sparkSession.conf
    before = conf.get(EMPTY_BATCHES)
    # Marks end with later data. Batches made for that alone would keep the query from ending.
    conf.set(EMPTY_BATCHES, "false")
    try:
        return (rows.writeStream
                .foreachBatch(lambda batch, batch_id: append(batch, batch_id, out))
                .option("checkpointLocation", checkpoint)
                .trigger(availableNow=True)
                .start())
    finally:
        conf.set(EMPTY_BATCHES, before)
