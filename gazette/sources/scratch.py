"""Intermediate tables in the folder the cluster shares.

A written table cuts the lineage, survives lost executors, and carries exact size statistics,
so Catalyst broadcasts it only if it really is small.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import types as T

# Spark reads 4,096 rows of a row group at once, however long they are. Rows with long arrays go into
# row groups of about this many bytes, which bounds what a reader holds and lets scans be split.
WIDE_ROW_GROUP = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="gazette-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/gazette/{label}-{uuid.uuid4().hex}"


def wide(df: DataFrame) -> DataFrameWriter:
    """A writer for rows with long arrays."""
    return df.write.option("parquet.block.size", WIDE_ROW_GROUP)


def written(df: DataFrame, label: str, read_as: T.StructType | None = None,
            long_rows: bool = False) -> DataFrame:
    """Write ``df`` once and read it back, with another schema for the same columns if given."""
    spark = df.sparkSession
    path = new_path(spark, label)
    (wide(df) if long_rows else df.write).parquet(path)
    return spark.read.schema(read_as or df.schema).parquet(path)
