"""The article table: reading, required columns, cleaning."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazette.functions import labels as L

# The columns of the article file and the two targets.
ARTICLE_COLUMNS = ("id", "description", "date", "headline", "political", "domestic")
TARGETS = ("political", "domestic")


def read_csv(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Articles from CSV, all columns as strings; types are given by ``clean_articles``.

    Without ``columns`` the header names them (that reads the first line only). Quoted texts
    may span lines, so one file is one task: deliver a large corpus as many files.
    """
    reader = spark.read.options(header=True, multiLine=True, escape='"')
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Fail before any job runs when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"the table lacks {missing}")
    return df


def clean_label(column: str) -> Callable[[DataFrame], DataFrame]:
    """Keep the rows whose label is a number other than the sentinel; the label becomes INT.

    A number beyond the range of INT is unreadable too.
    """

    def run(df: DataFrame) -> DataFrame:
        require_columns(df, [column])
        number = L.label_number(F.col(column))
        return (
            df.filter(number.try_cast("int").isNotNull() & (number != L.SENTINEL))
            .withColumn(column, number.try_cast("int"))
        )

    return run


def clean_articles(df: DataFrame) -> DataFrame:
    """Both labels cleaned (a row lost for one target is lost for both), text never NULL."""
    require_columns(df, ["description"])
    df = df.transform(clean_label("political")).transform(clean_label("domestic"))
    if "id" in df.columns and not isinstance(df.schema["id"].dataType, T.LongType):
        # Ids may be written as 668586.0; text that is a plain integer keeps every digit.
        text = F.trim(F.col("id").cast("string"))
        df = df.withColumn("id", F.coalesce(text.try_cast("bigint"),
                                            text.try_cast("double").try_cast("bigint")))
    return df.withColumn("description", L.text_or_empty(F.col("description")))


def with_features(df: DataFrame) -> DataFrame:
    """``description``, ``headline`` and ``year`` for the models, with defaults where absent."""
    headline = L.text_or_empty(F.col("headline")) if "headline" in df.columns else F.lit("")
    year = L.year_category(F.col("date")) if "date" in df.columns else F.lit(str(L.NO_YEAR))
    return df.withColumns({
        "description": L.text_or_empty(F.col("description")),
        "headline": headline,
        "year": year,
    })


def target_rows(df: DataFrame, target: str, *columns: str) -> DataFrame:
    """``id``, the chosen target as ``label``, and the columns a model needs, nothing else."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    return df.select("id", F.col(target).alias("label"), *columns)
