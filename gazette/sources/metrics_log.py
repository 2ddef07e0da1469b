"""Metric rows: a log whose columns may grow, and readers that survive broken files."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 16 columns of a wide training log.
TRAINING_LOG_SCHEMA = (
    "loss DOUBLE, grad_norm DOUBLE, learning_rate DOUBLE, epoch DOUBLE, step BIGINT, "
    "eval_loss DOUBLE, eval_f1 DOUBLE, eval_accuracy DOUBLE, eval_runtime DOUBLE, "
    "eval_samples_per_second DOUBLE, eval_steps_per_second DOUBLE, train_runtime DOUBLE, "
    "train_samples_per_second DOUBLE, train_steps_per_second DOUBLE, total_flos DOUBLE, "
    "train_loss DOUBLE"
)


def union_logs(*logs: DataFrame) -> DataFrame:
    """Rows of several logs; a column one log lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def json_cell(value: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def flat_cells(df: DataFrame) -> DataFrame:
    """Nested cells as JSON, so the row fits a CSV file."""
    cells = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.MapType):
            cells[field.name] = json_cell(F.col(field.name))
        elif isinstance(field.dataType, T.ArrayType | T.StructType):
            cells[field.name] = F.to_json(F.col(field.name))
    return df.withColumns(cells) if cells else df


def append_metrics(df: DataFrame, path: str) -> None:
    """Append rows; new columns are welcome because readers merge the schemas."""
    df.write.mode("append").parquet(path)


def is_absent(error: AnalysisException) -> bool:
    """Whether a read failed because there is nothing yet, and for no other reason."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The whole log with all columns it ever had; an absent log is empty with ``schema``."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return spark.createDataFrame([], schema)


def read_metrics_csv(spark: SparkSession, path: str, schema: str, too_long: str | None = None
                     ) -> DataFrame:
    """A metrics CSV whose later rows may have more fields than the header.

    ``schema`` names the fields of the longest row. Short rows get NULLs. A row that is longer
    still keeps its first fields; the column ``too_long``, if named, holds its whole line, so that
    nothing is lost. An absent file gives an empty table.
    """
    wanted = T.StructType.fromDDL(schema)
    shown = T.StructType(list(wanted.fields))
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
    if too_long is not None:
        shown, texts = (t.add(too_long, T.StringType()) for t in (shown, texts))
    try:
        # Whole lines are read, whichever columns a query goes on to use.
        lines = spark.read.options(
            header=False, escape='"', mode="PERMISSIVE", columnPruning=False,
            columnNameOfCorruptRecord=too_long or "_corrupt_record").schema(texts).csv(path)
    except AnalysisException as error:
        if not is_absent(error):
            raise
        return spark.createDataFrame([], shown)
    first, line = wanted.fields[0].name, F.col(too_long) if too_long else F.lit(None)
    body = lines.filter(F.col(first).isNull() | (F.col(first) != first))
    # A short row is no damage: only a line with fields to spare is told.
    spare = F.size(F.split(line, ",")) > len(wanted.fields)
    return body.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields],
        *([F.when(spare, line).alias(too_long)] if too_long else []))


def write_report(df: DataFrame, path: str) -> None:
    """A report of a few rows as one CSV file with header (never for data-sized tables)."""
    flat_cells(df).coalesce(1).write.mode("overwrite").csv(path, header=True,
                                                                escape='"')


def write_training_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
