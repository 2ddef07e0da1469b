"""Prompts, replies, resume, candidate labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions import replies as R
from gazette.operators import labelling as lab
from gazette.operators import splits, zero_shot
from gazette.plans.base import ARTICLES_SQL, SPLIT_SQL, articles, query, table
from gazette.plans.exploration import rounded


def sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query("prompt_table", lambda: f"""WITH {ARTICLES_SQL}
  SELECT id, 'political' AS target, 'political' AS json_key,
    replace({sql_text(lab.PROMPTS['political'])}, '{lab.SLOT}', description) AS prompt FROM art""")
def prompt_table(spark, sf_dir):
    return lab.prompt_table(articles(spark, sf_dir), "political")


@query("prompt_fill", lambda: f"""WITH {ARTICLES_SQL}
  SELECT id, md5('Code 0 or 1: ' || description) AS prompt_md5,
    length('Code 0 or 1: ' || description)::INTEGER AS prompt_length FROM art""")
def prompt_fill(spark, sf_dir):
    prompts = lab.prompt_table(articles(spark, sf_dir), "domestic", "Code 0 or 1: {txt}")
    return prompts.select("id", F.md5("prompt").alias("prompt_md5"),
                          F.length("prompt").alias("prompt_length"))


# Replies of every shape the parser must handle, by the first hex digit of a hash of the id.
REPLY_SHAPES = {
    "0": ('{"political": 1}', "stop"), "1": ('{"political": 0}', "stop"),
    "2": ('{"political": "0"}', "stop"), "3": ('Sure: {"political": 0} ok', "stop"),
    "4": ('{"label": 1}', "stop"), "5": ('{"a": 1, "b": 0}', "stop"),
    "6": ('{"political": 7}', "stop"), "7": ("", "length"), "8": ("  \n", "stop"),
    "9": ('{"political": ', "length"), "a": ("no idea", "stop"),
    "b": ('{"political": true}', "stop"), "c": ('{"political": 1, "why": "vote"}', "stop"),
    "d": ('{"political": 0.7}', "stop"), "e": ('Answer {"other": 1.0}', "stop"),
    "f": ('{"political": null}', "stop"),
}


def replies(spark, sf_dir):
    rows = articles(spark, sf_dir).select("id", F.col("political").alias("y_true"))
    digit = F.substring(splits.seeded_hash(F.col("id"), "reply"), 1, 1)

    def shape(pick: int):
        cells = [F.lit(x) for key, pair in REPLY_SHAPES.items() for x in (key, pair[pick])]
        return F.element_at(F.create_map(*cells), digit)

    return rows.select("id", "y_true", shape(0).alias("reply"), shape(1).alias("finish_reason"))


def _case(pick: int) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {sql_text(v[pick])}" for k, v in REPLY_SHAPES.items())
    return f"CASE substr(md5(CAST(id AS VARCHAR) || ':reply'), 1, 1) {arms} END"


REPLIES_SQL = ARTICLES_SQL + f""", rp AS (
  SELECT id, political AS y_true, {_case(0)} AS reply, {_case(1)} AS finish_reason FROM art),
js AS (SELECT *, CASE WHEN json_type(TRY_CAST(reply AS JSON)) = 'OBJECT'
    THEN TRY_CAST(reply AS JSON) END AS strict,
  TRY_CAST(nullif(regexp_extract(reply, '(?s)\\{{.*\\}}'), '') AS JSON) AS embedded FROM rp),
ob AS (SELECT *, coalesce(strict, embedded) AS o FROM js),
va AS (SELECT *, CASE WHEN list_contains(json_keys(o), 'political') THEN o->>'political'
    WHEN len(json_keys(o)) = 1 THEN o->>(json_keys(o)[1]) END AS v FROM ob),
nu AS (SELECT *, CASE WHEN v = 'true' THEN 1 WHEN v = 'false' THEN 0
    WHEN regexp_matches(v, '^\\s*[+-]?[0-9]+(\\.0*)?\\s*$') THEN TRY_CAST(trim(v) AS INTEGER) END AS num
  FROM va),
pa AS (SELECT *, CASE WHEN num IN (0, 1) THEN num END AS label FROM nu),
st AS (SELECT *, CASE
    WHEN NOT regexp_matches(reply, '\\S') AND finish_reason = 'length' THEN 'retry_longer'
    WHEN NOT regexp_matches(reply, '\\S') THEN 'empty'
    WHEN o IS NULL THEN 'retry_longer'
    WHEN NOT (list_contains(json_keys(o), 'political') OR len(json_keys(o)) = 1)
      THEN 'missing_key'
    WHEN label IS NULL THEN 'bad_value' ELSE 'ok' END AS status FROM pa)"""


@query("json_strict", f"WITH {REPLIES_SQL} SELECT id, strict->>'political' AS value FROM js")
def json_strict(spark, sf_dir):
    return replies(spark, sf_dir).select(
        "id", F.element_at(R.strict_object(F.col("reply")), "political").alias("value"))


@query("json_fallback", f"""WITH {REPLIES_SQL}
  SELECT id, o IS NOT NULL AS is_object, coalesce(len(json_keys(o)), 0)::INTEGER AS n_keys FROM ob""")
def json_fallback(spark, sf_dir):
    fields = R.reply_object(F.col("reply"))
    return replies(spark, sf_dir).select("id", fields.isNotNull().alias("is_object"),
                                         F.coalesce(F.size(F.map_keys(fields)), F.lit(0)).alias("n_keys"))


@query("json_sole_value", f"WITH {REPLIES_SQL} SELECT id, v AS value FROM va")
def json_sole_value(spark, sf_dir):
    value = R.keyed_value(R.reply_object(F.col("reply")), "political")
    return replies(spark, sf_dir).select("id", value.alias("value"))


@query("parse_replies", f"WITH {REPLIES_SQL} SELECT id, y_true, coalesce(label, -1) AS y_pred, status FROM st")
def parse_replies(spark, sf_dir):
    parsed = lab.parse_replies(replies(spark, sf_dir), "political")
    return parsed.select("id", "y_true", F.coalesce("y_pred", F.lit(-1)).alias("y_pred"), "status")


@query("retry_status", f"""WITH {REPLIES_SQL}
  SELECT status, finish_reason, count(*) AS n FROM st GROUP BY ALL""")
def retry_status(spark, sf_dir):
    parsed = lab.parse_replies(replies(spark, sf_dir), "political")
    return parsed.groupBy("status", "finish_reason").agg(F.count("*").alias("n"))


@query("retry_rows", f"""WITH {REPLIES_SQL}
  SELECT id, 1024 AS next_max_tokens FROM st WHERE status = 'retry_longer'""")
def retry_rows(spark, sf_dir):
    parsed = lab.parse_replies(replies(spark, sf_dir), "political")
    return lab.retry_table(parsed).select("id", "next_max_tokens")


# The stored run: the usable replies of the whole table; the run to do: the test rows.
def _run(spark, sf_dir):
    rows = splits.with_split(articles(spark, sf_dir))
    return splits.scope_rows(rows, "test").select("id", F.col("political").alias("y_true"))


def _done(spark, sf_dir):
    parsed = lab.parse_replies(replies(spark, sf_dir), "political")
    return parsed.filter(F.col("status") == R.OK).select("id", "y_true", "y_pred")


RUN_SQL = REPLIES_SQL + """, run AS (
  SELECT id, political AS y_true FROM art
  WHERE substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 8) < '33333333'),
done AS (SELECT id, y_true, label AS y_pred FROM st WHERE status = 'ok')"""


@query("resume_todo", f"""WITH {RUN_SQL}
  SELECT id, y_true FROM run WHERE id NOT IN (SELECT id FROM done)""")
def resume_todo(spark, sf_dir):
    return lab.todo(_run(spark, sf_dir), _done(spark, sf_dir))


@query("resume_check", f"""WITH {RUN_SQL}
  SELECT count(*) FILTER (WHERE run.id IS NOT NULL AND run.y_true = done.y_pred) AS matching,
    count(*) FILTER (WHERE run.id IS NOT NULL AND run.y_true <> done.y_pred) AS y_true_differs,
    count(*) FILTER (WHERE run.id IS NULL) AS not_in_split
  FROM done LEFT JOIN run ON run.id = done.id""")
def resume_check(spark, sf_dir):
    # Stored labels that differ from the split: the stand-in stores its predictions as y_true.
    stored = _done(spark, sf_dir).select("id", F.col("y_pred").alias("y_true"))
    return lab.resume_check(_run(spark, sf_dir), stored)


@query("progress", f"""WITH {RUN_SQL}
  SELECT count(*) FILTER (WHERE id IN (SELECT id FROM done)) AS n_done,
    count(*) FILTER (WHERE id NOT IN (SELECT id FROM done)) AS n_left FROM run""")
def progress(spark, sf_dir):
    return lab.progress(_run(spark, sf_dir), _done(spark, sf_dir))


# --------------------------------------------------------------------------- candidate labels

@query("label_pairs", f"""WITH {SPLIT_SQL}
  SELECT id, candidate, score FROM (SELECT id, c.i, c.candidate,
    ('0x' || substr(md5(id || ':' || c.candidate), 1, 8))::BIGINT AS score
    FROM spl, (VALUES (0, 'political'), (1, 'not political')) c(i, candidate)
    WHERE split = 'test')""")
def label_pairs(spark, sf_dir):
    return _scored_pairs(spark, sf_dir).select("id", "candidate", "score")


def _scored_pairs(spark, sf_dir):
    rows = splits.scope_rows(splits.with_split(articles(spark, sf_dir)), "test").select("id")
    pairs = zero_shot.label_pairs(rows, zero_shot.CANDIDATE_LABELS["political"])
    key = F.md5(F.concat(F.col("id").cast("string"), F.lit(":"), "candidate"))
    return pairs.withColumn("score", F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"))


@query("candidate_argmax", f"""WITH {SPLIT_SQL}, c AS (SELECT id,
    ('0x' || substr(md5(id || ':political'), 1, 8))::BIGINT AS a,
    ('0x' || substr(md5(id || ':not political'), 1, 8))::BIGINT AS b
    FROM spl WHERE split = 'test')
  SELECT id, CASE WHEN a >= b THEN 1 ELSE 0 END AS y_pred FROM c""")
def candidate_argmax(spark, sf_dir):
    best = zero_shot.best_label(_scored_pairs(spark, sf_dir))
    return best.select("id", (F.col("candidate") == "political").cast("int").alias("y_pred"))


@query("zero_shot_label", """WITH cells AS (
    SELECT vec_id, label, unnest(embedding)::DOUBLE AS value,
      unnest(range(len(embedding))) AS pos FROM embeddings),
  proto AS (SELECT label, pos, avg(value) AS mean FROM cells GROUP BY label, pos),
  norm AS (SELECT label, sqrt(sum(mean * mean)) AS n FROM proto GROUP BY label),
  own AS (SELECT vec_id, sqrt(sum(value * value)) AS n FROM cells GROUP BY vec_id),
  dots AS (SELECT c.vec_id, p.label, sum(c.value * p.mean) AS dot
    FROM cells c JOIN proto p ON p.pos = c.pos GROUP BY c.vec_id, p.label),
  sims AS (SELECT d.vec_id, d.label, dot / (own.n * norm.n) AS score FROM dots d
    JOIN own ON own.vec_id = d.vec_id JOIN norm ON norm.label = d.label),
  best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS k
    FROM sims)
  SELECT vec_id AS id, label AS candidate, round(score, 6) AS score FROM best WHERE k = 1""")
def zero_shot_label(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    prototypes = zero_shot.label_prototypes(vectors, "embedding", "label")
    best = zero_shot.nearest_prototype(vectors.select(F.col("vec_id").alias("id"), "embedding"),
                                       "embedding", prototypes, "label")
    return rounded(best.select("id", "candidate", "score"), "score")
