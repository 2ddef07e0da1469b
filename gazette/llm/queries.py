"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from gazette.llm import (
    bpe, decontamination, embeddings, language_model, merkle, near_dup, nearest, phrases, pii,
    quality, secrets, url_filter, warc)
from gazette.llm.checks import merkle_sql, phrases_sql
from gazette.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"


def ranks_path() -> str:
    return public_tokenizers.path(RANKS)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(table(spark, sf_dir, "documents"), ranks_path(),
                                 public_tokenizers.PATTERN)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"), ranks_path(),
                           public_tokenizers.PATTERN)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
                             ).select("doc_id", "log_weight", "sample_key", "selected")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained(table(spark, sf_dir, "documents"),
                                     table(spark, sf_dir, "benchmark"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups(table(spark, sf_dir, "documents"), n=2)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), ranks_path(), public_tokenizers.PATTERN)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"),
                             url_filter.has_listed_word(F.col("key")))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampering_check(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_lm_scores, op2_secrets, op3_pii, op4_quality, op5_decontamination, op6_embedding_dedup,
    op7_near_dedup, op8_bpe, op9_warc, op10_url_filter, op11_nearest,
    op12_merkle, op13_phrases)}

WORD_SPLIT = r"list_filter(string_split_regex(lower({text}), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def shingle_sql(text: str, n: int) -> str:
    """The runs of ``n`` words of a text, or all its words if they are fewer."""
    return f"""(SELECT CASE WHEN len(w) >= {n}
      THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END
      FROM (SELECT {WORD_SPLIT.format(text=text)} AS w))"""


ORACLE = {
    "op5_decontamination": f"""
    WITH items AS (SELECT DISTINCT item_id, unnest({shingle_sql("text", 5)}) AS s FROM benchmark),
    docs AS (SELECT DISTINCT doc_id, unnest({shingle_sql("text", 5)}) AS s FROM documents),
    sizes AS (SELECT item_id, count(*) AS n_item FROM items GROUP BY item_id)
    SELECT doc_id, item_id, count(*) AS n_shared, n_item,
      count(*) / CAST(n_item AS DOUBLE) AS containment
    FROM docs JOIN items USING (s) JOIN sizes USING (item_id)
    GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item""",
    "op10_url_filter": f"""
    WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://')
        THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parts AS (SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}')
          AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
    rules(h, p, v) AS (VALUES {", ".join(str(r) for r in url_filter.RULES)}),
    best AS (SELECT page_id, arg_max(h || p, len(h || p)) AS rule, arg_max(v, len(h || p)) AS v
      FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
      GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(v, CASE WHEN list_has_any(
        string_split_regex(host, '[.-]'), {list(url_filter.LISTED_WORDS)})
      THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts LEFT JOIN best USING (page_id)""",
    "op12_merkle": merkle_sql(),
    "op13_phrases": phrases_sql(),
}
