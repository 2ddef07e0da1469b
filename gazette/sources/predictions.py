"""Stored predictions: partitioned tables, and the CSV files of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions.text import safe_name

# Columns of a prediction row, and what tells runs apart.
PREDICTION_SCHEMA = "row_index INT, y_true INT, y_pred INT"
RUN_COLUMNS = ("target", "model", "seed", "scope")
CORRUPT = "_corrupt_record"


def split_bad_lines(spark: SparkSession, path: str,
                    schema: str = PREDICTION_SCHEMA) -> tuple[DataFrame, DataFrame]:
    """(good rows, the text of lines that do not fit), for callers who want to see the latter.

    Whole lines are judged, whichever columns a query goes on to use: the number of fields by
    the parser, the values by the condition below.
    """
    wanted = T.StructType.fromDDL(schema)
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted.fields])
    rows = (spark.read.schema(texts.add(CORRUPT, T.StringType()))
            .options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
                     columnPruning=False).csv(path))
    fits = F.col(CORRUPT).isNull()
    for f in wanted.fields:
        fits = fits & (F.col(f.name).isNull() | F.col(f.name).try_cast(f.dataType).isNotNull())
    good = rows.filter(fits).select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted.fields])
    line = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *wanted.names))
    return good, rows.filter(~fits).select(line.alias("line"))


def read_predictions_csv(spark: SparkSession, path: str,
                         schema: str = PREDICTION_SCHEMA) -> DataFrame:
    """Prediction rows of a CSV file; lines that do not fit are skipped.

    Older files have no ``row_index``: pass ``schema="y_true INT, y_pred INT"``.
    """
    return split_bad_lines(spark, path, schema)[0]


def append_predictions(df: DataFrame, path: str) -> None:
    """Append rows; the run columns are folders, so reading one run prunes the others."""
    df.write.mode("append").partitionBy(*RUN_COLUMNS).parquet(path)


def read_run(spark: SparkSession, path: str, **run: object) -> DataFrame:
    """The rows of one run, e.g. ``read_run(spark, path, target="political", seed=42)``."""
    df = spark.read.parquet(path)
    for column, value in run.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def run_name(target: Column, model: Column, seed: Column, scope: Column,
             max_samples: Column | None = None) -> Column:
    """One readable name per run, safe to stand in a path."""
    parts = [F.lit("predictions_"), target, F.lit("_"), model, F.lit("_seed"),
             seed.cast("string"), F.when(scope == "all", "_all").otherwise("")]
    if max_samples is not None:
        parts.append(F.coalesce(F.concat(F.lit("_n"), max_samples.cast("string")), F.lit("")))
    return safe_name(F.concat(*parts))
