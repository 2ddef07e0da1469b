"""Cleaning, features, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions.text import safe_name, short_text, split_names, token_count, truncate_tokens
from gazette.operators import eda, splits
from gazette.plans.base import (
    ARTICLES_SQL,
    RAW_SQL,
    SPLIT_SQL,
    SQL_SPACE_FREE_RUN,
    SQL_SPACE_RUN,
    articles,
    query,
    r6,
    raw_articles,
)
from gazette.sources.articles import target_rows, with_features
from gazette.sources.predictions import run_name

DATE_SQL = "TRY_CAST(try_strptime(date, '%d/%m/%Y') AS DATE)"
YEAR_SQL = f"coalesce(year({DATE_SQL}), -1)"


def tokens_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{SQL_SPACE_FREE_RUN}'))::INTEGER"


def short_sql(text: str) -> str:
    flat = f"trim(regexp_replace({text}, '{SQL_SPACE_RUN}', ' ', 'g'))"
    return (f"CASE WHEN length({flat}) > 180 THEN substr({flat}, 1, 177) || '...' "
            f"ELSE {flat} END")


@query("clean_labels", f"WITH {ARTICLES_SQL} SELECT id, political, domestic FROM art")
def clean_labels(spark, sf_dir):
    return articles(spark, sf_dir).select("id", "political", "domestic")


@query("dirty_label_profile", f"""WITH {RAW_SQL}
  SELECT 'political' AS label, political AS value, count(*) AS n FROM raw GROUP BY ALL
  UNION ALL
  SELECT 'domestic' AS label, domestic AS value, count(*) AS n FROM raw GROUP BY ALL""")
def dirty_label_profile(spark, sf_dir):
    return eda.label_domain(raw_articles(spark, sf_dir))


NULL_COLUMNS = ("id", "description", "headline", "date", "political", "domestic")


@query("null_counts", f"WITH {RAW_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{'bigint' if c == 'id' else 'string'}' AS type, "
    f"count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS n FROM raw"
    for c in NULL_COLUMNS))
def null_counts(spark, sf_dir):
    return eda.null_profile(raw_articles(spark, sf_dir).select(*NULL_COLUMNS))


@query("article_features", f"""WITH {ARTICLES_SQL}
  SELECT id, coalesce(headline, '') AS headline, CAST({YEAR_SQL} AS VARCHAR) AS year,
    {tokens_sql("description")} AS desc_tokens,
    {tokens_sql("coalesce(headline, '')")} AS headline_tokens,
    length(description)::INTEGER AS n_text,
    round(ln(1 + {tokens_sql("description")}), 6) AS desc_tokens_log1p
  FROM art""")
def article_features(spark, sf_dir):
    rows = with_features(articles(spark, sf_dir))
    tokens = token_count(F.col("description"))
    return rows.select("id", "headline", "year", tokens.alias("desc_tokens"),
                       token_count(F.col("headline")).alias("headline_tokens"),
                       F.length("description").alias("n_text"),
                       r6(F.log1p(tokens)).alias("desc_tokens_log1p"))


@query("default_columns", f"""WITH {ARTICLES_SQL}
  SELECT id, length(description)::INTEGER AS n_text, '' AS headline, '-1' AS year FROM art""")
def default_columns(spark, sf_dir):
    bare = articles(spark, sf_dir).select("id", "description")
    return with_features(bare).select("id", F.length("description").alias("n_text"), "headline",
                                      "year")


@query("article_view", f"""WITH {ARTICLES_SQL}
  SELECT id, {DATE_SQL} AS date_dt, {YEAR_SQL}::INTEGER AS year, political, domestic,
    {tokens_sql("description")} AS desc_tokens,
    {tokens_sql("coalesce(headline, '')")} AS headline_tokens,
    round(ln(1 + {tokens_sql("coalesce(headline, '')")}), 6) AS headline_tokens_log1p
  FROM art""")
def article_view(spark, sf_dir):
    return eda.article_view(articles(spark, sf_dir)).select(
        "id", "date_dt", "year", "political", "domestic", "desc_tokens", "headline_tokens",
        r6(F.col("headline_tokens_log1p")).alias("headline_tokens_log1p"))


@query("date_check", f"""WITH {ARTICLES_SQL}
  SELECT count(*) AS n, count(*) FILTER (WHERE {DATE_SQL} IS NULL) AS unreadable FROM art""")
def date_check(spark, sf_dir):
    return eda.date_check(articles(spark, sf_dir))


@query("preview", f"""WITH {ARTICLES_SQL}
  SELECT id, {YEAR_SQL}::INTEGER AS year, headline, political, domestic,
    {tokens_sql("description")} AS desc_tokens,
    {tokens_sql("coalesce(headline, '')")} AS headline_tokens
  FROM art ORDER BY id LIMIT 3""")
def preview(spark, sf_dir):
    return eda.preview(eda.article_view(articles(spark, sf_dir)))


@query("split_assign", f"WITH {SPLIT_SQL} SELECT id, split FROM spl")
def split_assign(spark, sf_dir):
    return splits.with_split(articles(spark, sf_dir)).select("id", "split")


@query("split_counts", f"""WITH {SPLIT_SQL}
  SELECT count(*) AS n, count(*) FILTER (WHERE split = 'train') AS n_train,
    count(*) FILTER (WHERE split = 'test') AS n_test FROM spl""")
def split_counts(spark, sf_dir):
    rows = splits.with_split(articles(spark, sf_dir))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("n_train"),
                    F.count_if(F.col("split") == "test").alias("n_test"))


HASH13 = "('0x' || substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 13))::BIGINT"


@query("exact_split", f"""WITH {ARTICLES_SQL}
  SELECT id, CASE WHEN row_number() OVER (ORDER BY {HASH13}, id)
      <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
  FROM art""")
def exact_split(spark, sf_dir):
    return splits.exact_split(articles(spark, sf_dir).select("id", "political")).select(
        "id", "split")


def folds_sql(order: str) -> str:
    return f"""WITH {ARTICLES_SQL},
  sizes AS (SELECT political, count(*) AS size, min(id) AS first FROM art GROUP BY political),
  starts AS (SELECT political, coalesce(sum(size) OVER (ORDER BY first
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes),
  dealt AS (SELECT s.political, (s.start + p.i) % 5 AS fold,
      row_number() OVER (PARTITION BY s.political ORDER BY (s.start + p.i) % 5, p.i) AS place
    FROM starts s JOIN (SELECT political, row_number() OVER (PARTITION BY political ORDER BY id) - 1
      AS i FROM art) p USING (political)),
  placed AS (SELECT id, political,
      row_number() OVER (PARTITION BY political ORDER BY {order}) AS place FROM art)
  SELECT id, political, CAST(fold AS INTEGER) AS fold
  FROM placed JOIN dealt USING (political, place)"""


@query("stratified_folds", folds_sql("id"))
def stratified_folds(spark, sf_dir):
    return splits.stratified_folds(articles(spark, sf_dir), "political", 5)


@query("shuffled_folds", folds_sql(f"{HASH13}, id"))
def shuffled_folds(spark, sf_dir):
    return splits.stratified_folds(articles(spark, sf_dir), "political", 5, seed=42)


@query("hash_folds", f"""WITH {ARTICLES_SQL}
  SELECT id, CAST({HASH13} % 5 AS INTEGER) AS fold FROM art""")
def hash_folds(spark, sf_dir):
    return splits.hash_folds(articles(spark, sf_dir), 5).select("id", "fold")


@query("scope_rows", f"""WITH {SPLIT_SQL}
  SELECT 'test' AS scope, id, political AS label FROM spl WHERE split = 'test'
  UNION ALL SELECT 'all' AS scope, id, political AS label FROM spl""")
def scope_rows(spark, sf_dir):
    rows = splits.with_split(articles(spark, sf_dir))

    def scope(name):
        return target_rows(splits.scope_rows(rows, name), "political").select(
            F.lit(name).alias("scope"), "id", "label")

    return scope("test").unionByName(scope("all"))


@query("all_scope_sample", f"""WITH {ARTICLES_SQL}
  SELECT id, political FROM art ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id LIMIT 50""")
def all_scope_sample(spark, sf_dir):
    return splits.first_rows(articles(spark, sf_dir), 50).select("id", "political")


@query("short_text", f"""WITH {RAW_SQL}
  SELECT id, {short_sql("headline")} AS headline_short, {short_sql("description")}
    AS description_short FROM raw""")
def short_texts(spark, sf_dir):
    return raw_articles(spark, sf_dir).select(
        "id", short_text(F.col("headline")).alias("headline_short"),
        short_text(F.col("description")).alias("description_short"))


@query("truncate_tokens", f"""SELECT doc_id AS id,
  array_to_string(list_slice(regexp_extract_all(text, '{SQL_SPACE_FREE_RUN}'), 1, 256), ' ')
    AS shortened FROM documents""")
def truncated(spark, sf_dir):
    return raw_articles(spark, sf_dir).select(
        "id", truncate_tokens(F.col("description"), 256).alias("shortened"))


@query("name_list", """SELECT source || ' , ' || lang || ',,' AS names,
  list_filter(list_transform(string_split(source || ' , ' || lang || ',,', ','),
    lambda x: trim(x)), lambda x: x <> '')[2] AS second, count(*) AS n
  FROM documents GROUP BY source, lang""")
def name_lists(spark, sf_dir):
    names = F.concat("source", F.lit(" , "), "lang", F.lit(",,"))
    return (raw_articles(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"))
            .select(names.alias("names"), split_names(names)[1].alias("second"), "n"))


@query("safe_names", f"""WITH {ARTICLES_SQL}
  SELECT replace(source || '/' || lang, '/', '_') AS safe,
    replace('predictions_political_' || source || '/' || lang || '_seed42_all_n'
      || count(*)::VARCHAR, '/', '_') AS run_name
  FROM art GROUP BY source, lang""")
def safe_names(spark, sf_dir):
    path = F.concat("source", F.lit("/"), "lang")
    groups = articles(spark, sf_dir).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return groups.select(
        safe_name(path).alias("safe"),
        run_name(F.lit("political"), path, F.lit(42), F.lit("all"), F.col("n")).alias("run_name"))
