"""Evaluation of predictions, metric logs, ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.functions.labels import first_argmax
from gazette.functions.text import name_list
from gazette.operators import ensemble, evaluation
from gazette.plans.base import (
    ARTICLES_SQL,
    EPOCHS,
    MODELS,
    PREDICTIONS_SQL,
    articles,
    f1_sql,
    predictions,
    query,
    r6,
    scored,
)
from gazette.plans.cleaning import short_sql
from gazette.plans.exploration import rounded
from gazette.sources.metrics_log import json_cell, union_logs

CELLS_SQL = """count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn,
    count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
    count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn,
    count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp"""


@query("confusion", f"WITH {PREDICTIONS_SQL} SELECT model, {CELLS_SQL} FROM pred GROUP BY model")
def confusion(spark, sf_dir):
    return evaluation.confusion(predictions(spark, sf_dir), ["model"])


@query("predictions_joined", f"""WITH {PREDICTIONS_SQL}
  SELECT pred.model, art.id, art.political AS y_true, pred.y_pred, pred.score,
    length(art.description)::INTEGER AS n_text
  FROM art JOIN pred ON pred.id = art.id""")
def predictions_joined(spark, sf_dir):
    stored = predictions(spark, sf_dir).select("id", "model", "y_pred", "score")
    rows = articles(spark, sf_dir).select("id", F.col("political").alias("y_true"),
                                          F.length("description").alias("n_text"))
    return rows.join(stored, "id").select("model", "id", "y_true", "y_pred", "score", "n_text")


@query("fp_fn_flags", f"""WITH {PREDICTIONS_SQL}
  SELECT id, model, (y_true = 0 AND y_pred = 1) AS is_fp, (y_true = 1 AND y_pred = 0) AS is_fn
  FROM pred""")
def fp_fn_flags(spark, sf_dir):
    return evaluation.with_error_flags(predictions(spark, sf_dir)).select(
        "id", "model", "is_fp", "is_fn")


@query("f1_scores", f"""WITH {PREDICTIONS_SQL}
  SELECT model, round({f1_sql()}, 6) AS f1 FROM pred GROUP BY model""")
def f1_scores(spark, sf_dir):
    scores = evaluation.f1_scores(predictions(spark, sf_dir), ["model"])
    return rounded(scores, "f1").select("model", "f1").orderBy(F.desc("f1"), "model")


@query("accuracy", f"""WITH {PREDICTIONS_SQL}
  SELECT model, round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
    count(*) AS n FROM pred GROUP BY model""")
def accuracy(spark, sf_dir):
    scores = evaluation.f1_scores(predictions(spark, sf_dir), ["model"])
    return rounded(scores, "accuracy").select("model", "accuracy", "n")


@query("best_model", f"""WITH {PREDICTIONS_SQL}
  SELECT model, round({f1_sql()}, 6) AS f1 FROM pred GROUP BY model ORDER BY f1 DESC, model LIMIT 1""")
def best_model(spark, sf_dir):
    scores = evaluation.f1_scores(predictions(spark, sf_dir), ["model"])
    return rounded(evaluation.best_row(scores), "f1").select("model", "f1")


@query("classification_report", f"""WITH {PREDICTIONS_SQL},
  c AS (SELECT model, {CELLS_SQL} FROM pred GROUP BY model),
  k AS (SELECT model, '0' AS class, tn::DOUBLE AS tp, fn::DOUBLE AS fp, fp::DOUBLE AS fn FROM c
    UNION ALL SELECT model, '1', tp, fp, fn FROM c),
  s AS (SELECT model, class, tp, tp + fn AS support,
    coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_score FROM k),
  r AS (SELECT model, class, precision, recall, f1_score, support FROM s
    UNION ALL SELECT model, 'accuracy', sum(tp)/sum(support), sum(tp)/sum(support),
      sum(tp)/sum(support), sum(tp)/sum(support) FROM s GROUP BY model
    UNION ALL SELECT model, 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)
      FROM s GROUP BY model
    UNION ALL SELECT model, 'weighted avg', sum(precision*support)/sum(support),
      sum(recall*support)/sum(support), sum(f1_score*support)/sum(support), sum(support)
      FROM s GROUP BY model)
  SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
    round(f1_score, 6) AS f1_score, round(support, 6) AS support FROM r""")
def classification_report(spark, sf_dir):
    report = evaluation.classification_report(predictions(spark, sf_dir), ["model"])
    return rounded(report, "precision", "recall", "f1_score", "support")


@query("balanced_accuracy", f"""WITH {PREDICTIONS_SQL}
  SELECT model, round((avg(y_pred) FILTER (WHERE y_true = 1)
    + avg(1 - y_pred) FILTER (WHERE y_true = 0)) / 2, 6) AS balanced_accuracy
  FROM pred GROUP BY model""")
def balanced_accuracy(spark, sf_dir):
    return rounded(evaluation.balanced_accuracy(predictions(spark, sf_dir), ["model"]),
                   "balanced_accuracy")


CURVE_SQL = PREDICTIONS_SQL + """, sc AS (
  SELECT model, score, count(*) FILTER (WHERE y_true = 1) AS pos,
    count(*) FILTER (WHERE y_true <> 1) AS neg FROM pred GROUP BY model, score),
cu AS (SELECT model, score, pos, neg,
    (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp,
    lead(pos) OVER (PARTITION BY model ORDER BY score DESC) AS next_pos,
    lead(neg) OVER (PARTITION BY model ORDER BY score DESC) AS next_neg,
    row_number() OVER (PARTITION BY model ORDER BY score DESC) AS place,
    (sum(pos) OVER (PARTITION BY model))::DOUBLE AS p,
    (sum(neg) OVER (PARTITION BY model))::DOUBLE AS n
  FROM sc WINDOW w AS (PARTITION BY model ORDER BY score DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("cumulative_counts", f"WITH {CURVE_SQL} SELECT model, score, pos, neg, tp, fp FROM cu")
def cumulative_counts(spark, sf_dir):
    return evaluation.cumulative_counts(predictions(spark, sf_dir), ["model"])


@query("roc_points", f"""WITH {CURVE_SQL}
  SELECT model, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, score AS threshold FROM cu
  WHERE place = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
  UNION ALL SELECT DISTINCT model, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST('inf' AS DOUBLE)
  FROM cu""")
def roc_points(spark, sf_dir):
    return rounded(evaluation.roc_points(predictions(spark, sf_dir), ["model"]), "fpr", "tpr")


@query("roc_points_all", f"""WITH {CURVE_SQL}
  SELECT model, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, score AS threshold FROM cu
  UNION ALL SELECT DISTINCT model, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST('inf' AS DOUBLE)
  FROM cu""")
def roc_points_all(spark, sf_dir):
    points = evaluation.roc_points(predictions(spark, sf_dir), ["model"], drop_intermediate=False)
    return rounded(points, "fpr", "tpr")


@query("roc_auc", f"""WITH {PREDICTIONS_SQL},
  r AS (SELECT model, y_true, rank() OVER (PARTITION BY model ORDER BY score)
    + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS r FROM pred)
  SELECT model, round((sum(r) FILTER (WHERE y_true = 1)
      - count(*) FILTER (WHERE y_true = 1) * (count(*) FILTER (WHERE y_true = 1) + 1) / 2.0)::DOUBLE
    / (count(*) FILTER (WHERE y_true = 1) * count(*) FILTER (WHERE y_true = 0)), 6) AS roc_auc
  FROM r GROUP BY model""")
def roc_auc(spark, sf_dir):
    return rounded(evaluation.roc_auc(predictions(spark, sf_dir), ["model"]), "roc_auc")


@query("pr_points", f"""WITH {CURVE_SQL}
  SELECT model, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall,
    score AS threshold FROM cu
  UNION ALL SELECT DISTINCT model, CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE)
  FROM cu""")
def pr_points(spark, sf_dir):
    return rounded(evaluation.pr_points(predictions(spark, sf_dir), ["model"]),
                   "precision", "recall")


@query("average_precision", f"""WITH {CURVE_SQL}
  SELECT model, round(sum(pos / p * tp / (tp + fp)), 6) AS average_precision FROM cu
  GROUP BY model""")
def average_precision(spark, sf_dir):
    return rounded(evaluation.average_precision(predictions(spark, sf_dir), ["model"]),
                   "average_precision")


def error_sql(condition: str, direction: str) -> str:
    return f"""WITH {PREDICTIONS_SQL}
  SELECT pred.id, y_true, y_pred, score, {short_sql("art.headline")} AS headline_short,
    {short_sql("art.description")} AS description_short
  FROM pred JOIN art ON art.id = pred.id
  WHERE model = 'tfidf_log_reg' AND {condition} ORDER BY score {direction}, pred.id LIMIT 20"""


def _error_rows(spark, sf_dir):
    texts = articles(spark, sf_dir).select("id", "headline", "description")
    stored = predictions(spark, sf_dir).filter(F.col("model") == "tfidf_log_reg")
    return stored.select("id", "y_true", "y_pred", "score").join(texts, "id")


@query("top_false_positives", error_sql("y_true = 0 AND y_pred = 1", "DESC"))
def top_false_positives(spark, sf_dir):
    return evaluation.error_table(_error_rows(spark, sf_dir), "fp")


@query("top_false_negatives", error_sql("y_true = 1 AND y_pred = 0", "ASC"))
def top_false_negatives(spark, sf_dir):
    return evaluation.error_table(_error_rows(spark, sf_dir), "fn")


# --------------------------------------------------------------------------- votes

@query("member_votes", f"""WITH {PREDICTIONS_SQL}
  SELECT id, y_true, sum(y_pred)::BIGINT AS votes, count(*) AS members FROM pred
  GROUP BY id, y_true""")
def member_votes(spark, sf_dir):
    return ensemble.member_votes(predictions(spark, sf_dir))


@query("majority_vote", f"""WITH {PREDICTIONS_SQL}
  SELECT id, y_true, CASE WHEN 2 * sum(y_pred) > count(*) THEN 1 ELSE 0 END AS y_pred
  FROM pred GROUP BY id, y_true""")
def majority_vote(spark, sf_dir):
    return ensemble.majority_vote(predictions(spark, sf_dir), "tfidf_log_reg")


@query("two_member_vote", f"""WITH {PREDICTIONS_SQL}
  SELECT id, y_true, CASE WHEN 2 * sum(y_pred) > count(*) THEN 1
    WHEN 2 * sum(y_pred) < count(*) THEN 0
    ELSE max(y_pred) FILTER (WHERE model = 'tfidf_log_reg') END AS y_pred
  FROM pred WHERE model IN ('tfidf_log_reg', 'count_linear_svm') GROUP BY id, y_true""")
def two_member_vote(spark, sf_dir):
    pair = predictions(spark, sf_dir).filter(
        F.col("model").isin("tfidf_log_reg", "count_linear_svm"))
    return ensemble.majority_vote(pair, "tfidf_log_reg")


TOP_LINEAR_SQL = PREDICTIONS_SQL + f""", lg AS (
  SELECT model, {f1_sql()} AS f1 FROM pred GROUP BY model),
li AS (SELECT *, contains(model, 'log_reg') OR contains(model, 'linear_svm') AS is_linear FROM lg),
rk AS (SELECT *, CASE WHEN is_linear THEN
    row_number() OVER (PARTITION BY is_linear ORDER BY f1 DESC, model) END AS rank FROM li)"""


@query("top_k_linear", f"""WITH {TOP_LINEAR_SQL}
  SELECT model, round(f1, 6) AS f1, is_linear, coalesce(rank, 0)::INTEGER AS rank,
    coalesce(rank <= 2, false) AS selected_for_ensemble FROM rk""")
def top_k_linear(spark, sf_dir):
    log = evaluation.f1_scores(predictions(spark, sf_dir), ["model"]).select("model", "f1")
    return rounded(ensemble.top_linear(log), "f1").withColumn("rank", F.coalesce("rank", F.lit(0)))


@query("ensemble_row", f"""WITH {TOP_LINEAR_SQL}
  SELECT 'linear_vote' AS model, string_agg(model, ',' ORDER BY rank) AS members,
    max(CASE WHEN rank = 1 THEN round(f1, 6) END) AS primary_f1, count(*)::INTEGER AS top_k_used
  FROM rk WHERE rank <= 2""")
def ensemble_row(spark, sf_dir):
    log = evaluation.f1_scores(predictions(spark, sf_dir), ["model"]).select("model", "f1")
    row = ensemble.ensemble_row(ensemble.top_linear(log))
    first = F.element_at(F.col("member_f1"), F.element_at("members", 1))
    return row.select("model", F.array_join("members", ",").alias("members"),
                      r6(first).alias("primary_f1"), "top_k_used")


# --------------------------------------------------------------------------- metric logs
# One run per language: three models each, and a labelling run of the third model.

def baseline_log(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    scores = evaluation.f1_scores(rows, ["model", "lang"]).select("model", "lang", "f1")
    effort = rows.groupBy("model", "lang").agg((F.sum("n_chars") / 1000.0).alias("fit_time_s"))
    return scores.join(effort, ["model", "lang"])


BASELINE_LOG_SQL = f"""bl AS (SELECT model, lang, {f1_sql()} AS f1,
    sum(n_chars)::DOUBLE / 1000 AS fit_time_s FROM pred GROUP BY model, lang)"""


def labelling_log(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter(F.col("model") == MODELS[2])
    return evaluation.run_scores(rows, ["model", "lang"])


LABELLING_LOG_SQL = f"""al AS (SELECT model, lang, {f1_sql()} AS f1, count(*) AS n_samples,
    avg(y_true) AS positive_rate FROM pred WHERE model = '{MODELS[2]}' GROUP BY model, lang)"""


@query("score_summary", f"""WITH {PREDICTIONS_SQL}, {BASELINE_LOG_SQL}
  SELECT model, round(avg(f1), 6) AS f1, round(coalesce(stddev_samp(f1), 0), 6) AS std,
    count(f1) AS count FROM bl GROUP BY model""")
def score_summary(spark, sf_dir):
    return rounded(evaluation.score_summary(baseline_log(spark, sf_dir)), "f1", "std")


@query("run_scores", f"""WITH {PREDICTIONS_SQL}, {LABELLING_LOG_SQL}
  SELECT model, lang, round(f1, 6) AS f1, n_samples, round(positive_rate, 6) AS positive_rate
  FROM al""")
def run_scores(spark, sf_dir):
    return rounded(labelling_log(spark, sf_dir), "f1", "positive_rate")


@query("metrics_union", f"""WITH {PREDICTIONS_SQL}, {BASELINE_LOG_SQL}, {LABELLING_LOG_SQL}
  SELECT model, lang, round(f1, 6) AS f1, round(fit_time_s, 6) AS fit_time_s,
    n_samples::DOUBLE AS n_samples, round(positive_rate, 6) AS positive_rate FROM
  (SELECT * FROM bl UNION ALL BY NAME SELECT * FROM al)""")
def metrics_union(spark, sf_dir):
    log = union_logs(baseline_log(spark, sf_dir), labelling_log(spark, sf_dir))
    log = log.withColumn("n_samples", F.col("n_samples").cast("double"))
    return rounded(log, "f1", "fit_time_s", "positive_rate")


@query("fit_time_table", f"""WITH {PREDICTIONS_SQL}, {BASELINE_LOG_SQL}
  SELECT model, round(fit_time_s, 6) AS fit_time_s, round(f1, 6) AS f1 FROM bl""")
def fit_time_table(spark, sf_dir):
    return rounded(evaluation.fit_time_table(baseline_log(spark, sf_dir)), "fit_time_s", "f1")


REQUESTED = "tfidf_log_reg, count_linear_svm,, fasttext , tfidf_log_reg_poly3"


@query("known_models", f"""WITH {PREDICTIONS_SQL}, {BASELINE_LOG_SQL}
  SELECT DISTINCT model FROM bl WHERE list_contains(list_transform(
    string_split('{REQUESTED}', ','), lambda x: trim(x)), model)""")
def known_models(spark, sf_dir):
    log = baseline_log(spark, sf_dir)
    return ensemble.known_models(log, name_list(REQUESTED)).select("model").distinct()


@query("unknown_models", f"""WITH {PREDICTIONS_SQL}, {BASELINE_LOG_SQL},
  rq AS (SELECT trim(unnest(string_split('{REQUESTED}', ','))) AS model)
  SELECT model FROM rq WHERE model <> '' EXCEPT SELECT model FROM bl""")
def unknown_models(spark, sf_dir):
    return ensemble.unknown_models(baseline_log(spark, sf_dir), name_list(REQUESTED))


@query("metrics_json", f"""WITH {PREDICTIONS_SQL}
  SELECT model, '{{"fn":' || count(*) FILTER (WHERE y_true = 1 AND y_pred = 0)
    || ',"fp":' || count(*) FILTER (WHERE y_true = 0 AND y_pred = 1)
    || ',"n":' || count(*) || '}}' AS cell FROM pred GROUP BY model""")
def metrics_json(spark, sf_dir):
    cells = evaluation.confusion(predictions(spark, sf_dir), ["model"])
    n = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    unsorted = F.create_map(F.lit("n"), n, F.lit("fp"), F.col("fp"), F.lit("fn"), F.col("fn"))
    return cells.select("model", json_cell(unsorted).alias("cell"))


# --------------------------------------------------------------------------- training log
# One run per language with three epochs. Each epoch has its own scores: training rows carry the
# mean loss per source, evaluation rows the metrics of the epoch.

def training_log(spark, sf_dir):
    rows = articles(spark, sf_dir).select(
        "id", F.col("political").alias("y_true"), "lang", "source",
        F.explode(F.array(*[F.lit(e) for e in EPOCHS])).alias("epoch"))
    rows = scored(rows, "y_true", F.concat(F.lit("epoch"), F.col("epoch").cast("string")))
    p = F.when(F.col("y_true") == 1, F.col("score")).otherwise(1 - F.col("score"))
    rows = rows.withColumn("nll", -F.log(F.greatest(p, F.lit(0.001))))
    step = F.col("epoch") * 100
    position = F.substring("source", 4, 3).cast("int")
    trained = rows.groupBy("lang", "epoch", "source").agg(F.avg("nll").alias("loss")).select(
        "lang", "epoch", (step - 100 + position).alias("step"), "loss")
    scores = evaluation.f1_scores(rows, ["lang", "epoch"])
    losses = rows.groupBy("lang", "epoch").agg(F.avg("nll").alias("eval_loss"))
    held_out = scores.join(losses, ["lang", "epoch"]).select(
        "lang", "epoch", step.alias("step"), F.col("f1").alias("eval_f1"),
        F.col("accuracy").alias("eval_accuracy"), "eval_loss")
    return union_logs(trained, held_out)


TRAINING_LOG_SQL = ARTICLES_SQL + f""", ep0 AS (
  SELECT art.id, art.political AS y_true, art.lang, art.source, e.epoch,
    (((('0x' || substr(md5(art.id || ':epoch' || e.epoch), 1, 8))::BIGINT * 600) >> 32)
      + 400 * art.political) / CAST(1000 AS DOUBLE) AS score
  FROM art, (VALUES (1), (2), (3)) e(epoch)),
ep AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS y_pred,
    -ln(greatest(CASE WHEN y_true = 1 THEN score ELSE 1 - score END, 0.001)) AS nll FROM ep0),
tl AS (
  SELECT lang, epoch, epoch * 100 - 100 + CAST(substr(source, 4) AS INTEGER) AS step,
    avg(nll) AS loss, NULL::DOUBLE AS eval_f1, NULL::DOUBLE AS eval_accuracy,
    NULL::DOUBLE AS eval_loss FROM ep GROUP BY lang, epoch, source
  UNION ALL
  SELECT lang, epoch, epoch * 100, NULL, {f1_sql()},
    avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), avg(nll) FROM ep GROUP BY lang, epoch)"""


@query("training_log", f"""WITH {TRAINING_LOG_SQL}
  SELECT lang, epoch, step, round(loss, 6) AS loss, round(eval_f1, 6) AS eval_f1,
    round(eval_accuracy, 6) AS eval_accuracy, round(eval_loss, 6) AS eval_loss FROM tl""")
def training_rows(spark, sf_dir):
    return rounded(training_log(spark, sf_dir), "loss", "eval_f1", "eval_accuracy", "eval_loss")


@query("loss_curve", f"""WITH {TRAINING_LOG_SQL}
  SELECT lang, step AS x, round(loss, 6) AS loss FROM tl WHERE loss IS NOT NULL""")
def loss_curve(spark, sf_dir):
    return rounded(evaluation.loss_curve(training_log(spark, sf_dir), ["lang"]), "loss")


@query("eval_log_rows", f"""WITH {TRAINING_LOG_SQL}
  SELECT lang, step AS x, round(eval_f1, 6) AS eval_f1, round(eval_loss, 6) AS eval_loss
  FROM tl WHERE eval_f1 IS NOT NULL""")
def eval_log_rows(spark, sf_dir):
    return rounded(evaluation.eval_curve(training_log(spark, sf_dir), ["lang"]),
                   "eval_f1", "eval_loss")


@query("best_epoch", f"""WITH {TRAINING_LOG_SQL}, b AS (
  SELECT lang, step, eval_f1, row_number() OVER (PARTITION BY lang ORDER BY eval_f1 DESC, step) AS k
  FROM tl WHERE eval_f1 IS NOT NULL)
  SELECT lang, step AS best_step, round(eval_f1, 6) AS best_f1 FROM b WHERE k = 1""")
def best_epoch(spark, sf_dir):
    return rounded(evaluation.best_epoch(training_log(spark, sf_dir), ["lang"]), "best_f1")


@query("logit_argmax", """SELECT vec_id AS id, label, (list_position(embedding,
    list_max(embedding)) - 1)::INTEGER AS y_pred FROM embeddings""")
def logit_argmax(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), "label", first_argmax(F.col("embedding")).alias("y_pred"))
