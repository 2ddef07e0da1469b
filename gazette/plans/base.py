"""The registry of queries and the article data they run on.

The driver tables hold no news articles, so one view stands in: ``documents`` left-joined with
``labels``. ``quality`` plays the political label and ``toxic`` the domestic one; texts too
short to code carry the sentinel, two sources carry unreadable values, and documents without a
label row have none. Every query reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.sources.articles import clean_articles

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str | Callable[[], str]] = {}

# Names of stand-in models whose scores derive from ids and labels.
MODELS = ("tfidf_log_reg", "count_linear_svm", "tfidf_naive_bayes")
EPOCHS = (1, 2, 3)


def query(name: str, sql: str | Callable[[], str] | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its check."""

    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The space characters as SQL's regular expressions write them.
SQL_SPACES = (r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
              r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
SQL_SPACE_RUN = f"[{SQL_SPACES}]+"
SQL_SPACE_FREE_RUN = f"[^{SQL_SPACES}]+"


def r6(column) -> object:
    """Six digits: sums may differ in the last bits between engines."""
    return F.round(column, 6)


# --------------------------------------------------------------------------- articles

def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text, source = F.col("text"), F.col("source")
    day = F.date_add(F.lit("1999-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int"))
    return documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        text.alias("description"),
        F.when(F.contains(text, F.lit("\n")), F.substring_index(text, "\n", 1))
        .alias("headline"),
        F.when(source == "src5", "n.d.").otherwise(F.date_format(day, "dd/MM/yyyy")).alias("date"),
        F.when(F.col("n_chars") < 250, "99").when(source == "src7", "n/a")
        .otherwise(F.col("quality").cast("string")).alias("political"),
        F.when((source == "src11") & (F.col("toxic") == 1), "99")
        .otherwise(F.col("toxic").cast("string")).alias("domestic"),
        "lang", "source", "n_chars",
    )


RAW_SQL = """raw AS (
  SELECT d.doc_id AS id, d.text AS description,
    CASE WHEN contains(d.text, chr(10)) THEN split_part(d.text, chr(10), 1) END AS headline,
    CASE WHEN d.source = 'src5' THEN 'n.d.' ELSE
      strftime(DATE '1999-01-01' + CAST(d.doc_id % 3650 AS INTEGER), '%d/%m/%Y') END AS date,
    CASE WHEN d.n_chars < 250 THEN '99' WHEN d.source = 'src7' THEN 'n/a'
      ELSE CAST(l.quality AS VARCHAR) END AS political,
    CASE WHEN d.source = 'src11' AND l.toxic = 1 THEN '99'
      ELSE CAST(l.toxic AS VARCHAR) END AS domestic,
    d.lang, d.source, d.n_chars
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_articles(raw_articles(spark, sf_dir))


ARTICLES_SQL = RAW_SQL + """, art AS (
  SELECT id, coalesce(description, '') AS description, headline, date,
    CAST(trunc(TRY_CAST(trim(political) AS DOUBLE)) AS INTEGER) AS political,
    CAST(trunc(TRY_CAST(trim(domestic) AS DOUBLE)) AS INTEGER) AS domestic,
    lang, source, n_chars
  FROM raw
  WHERE TRY_CAST(trim(political) AS DOUBLE) <> 99 AND TRY_CAST(trim(domestic) AS DOUBLE) <> 99)"""

SPLIT_SQL = ARTICLES_SQL + """, spl AS (
  SELECT *, CASE WHEN substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 8) < '33333333'
    THEN 'test' ELSE 'train' END AS split FROM art)"""


# --------------------------------------------------------------------------- predictions

def scored(df: DataFrame, label: str, seed) -> DataFrame:
    """A score per row: 0.6 x hash share + 0.4 x label, in thousandths, so ties occur."""
    share = F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(":"), seed)), 1, 8),
                   16, 10).cast("bigint")
    thousandths = F.shiftright(share * 600, 32) + 400 * F.col(label)
    return df.withColumn("score", thousandths / F.lit(1000.0)).withColumn(
        "y_pred", (F.col("score") >= 0.5).cast("int"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, model, y_true, y_pred, score`` of three stand-in models, with lang and source."""
    rows = articles(spark, sf_dir).select(
        "id", F.col("political").alias("y_true"), "lang", "source", "n_chars",
        F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))
    return scored(rows, "y_true", F.col("model"))


PREDICTIONS_SQL = ARTICLES_SQL + """, pr0 AS (
  SELECT art.id, art.political AS y_true, art.lang, art.source, art.n_chars, m.model,
    (((('0x' || substr(md5(CAST(art.id AS VARCHAR) || ':' || m.model), 1, 8))::BIGINT * 600) >> 32)
      + 400 * art.political) / CAST(1000 AS DOUBLE) AS score
  FROM art, (VALUES ('tfidf_log_reg'), ('count_linear_svm'), ('tfidf_naive_bayes')) m(model)),
pred AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM pr0)"""


def f1_sql(y: str = "y_true", p: str = "y_pred") -> str:
    tp = f"count(*) FILTER (WHERE {y} = 1 AND {p} = 1)"
    wrong = f"count(*) FILTER (WHERE {y} = 0 AND {p} = 1) + count(*) FILTER (WHERE {y} = 1 AND {p} = 0)"
    return f"coalesce(2.0 * {tp} / nullif(2.0 * {tp} + {wrong}, 0), 0)::DOUBLE"


def oracle_sql() -> dict[str, str]:
    return {name: sql() if callable(sql) else sql for name, sql in ORACLE.items()}
