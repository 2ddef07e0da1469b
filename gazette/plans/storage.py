"""Round trips through files: articles as CSV, stored runs, growing logs, the reply stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.plans.base import ARTICLES_SQL, PREDICTIONS_SQL, predictions, query, raw_articles
from gazette.plans.exploration import rounded
from gazette.plans.labelling import REPLIES_SQL, replies
from gazette.plans.scoring import (
    BASELINE_LOG_SQL,
    LABELLING_LOG_SQL,
    baseline_log,
    labelling_log,
)
from gazette.sources import articles as A
from gazette.sources import metrics_log, scratch
from gazette.sources import predictions as P
from gazette.streaming import incremental


@query("csv_articles", f"""WITH {ARTICLES_SQL}
  SELECT id, md5(description) AS text_md5, headline, date, political, domestic FROM art""")
def csv_articles(spark, sf_dir):
    path = scratch.new_path(spark, "articles-csv")
    raw = raw_articles(spark, sf_dir).select(*A.ARTICLE_COLUMNS)
    as_text = raw.withColumn("id", F.concat(F.col("id").cast("string"), F.lit(".0")))
    as_text.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False,
                          ignoreTrailingWhiteSpace=False).csv(path)
    read = A.clean_articles(A.read_csv(spark, path, A.ARTICLE_COLUMNS))
    return read.select("id", F.md5("description").alias("text_md5"), "headline", "date",
                       "political", "domestic")


@query("stored_run", f"""WITH {PREDICTIONS_SQL}
  SELECT id, y_true, y_pred FROM pred WHERE model = 'count_linear_svm'""")
def stored_run(spark, sf_dir):
    path = scratch.new_path(spark, "runs")
    rows = predictions(spark, sf_dir).select(
        "id", "y_true", "y_pred", "model", F.lit("political").alias("target"),
        F.lit(42).alias("seed"), F.lit("all").alias("scope"))
    P.append_predictions(rows, path)
    return P.read_run(spark, path, target="political", model="count_linear_svm", seed=42).select(
        "id", "y_true", "y_pred")


@query("metrics_append", f"""WITH {PREDICTIONS_SQL}, {BASELINE_LOG_SQL}, {LABELLING_LOG_SQL}
  SELECT model, lang, round(f1, 6) AS f1, round(fit_time_s, 6) AS fit_time_s,
    round(positive_rate, 6) AS positive_rate
  FROM (SELECT * FROM bl UNION ALL BY NAME SELECT * FROM al)""")
def metrics_append(spark, sf_dir):
    path = scratch.new_path(spark, "metrics")
    metrics_log.append_metrics(baseline_log(spark, sf_dir), path)
    metrics_log.append_metrics(labelling_log(spark, sf_dir), path)
    log = metrics_log.read_metrics(spark, path, "model STRING, f1 DOUBLE")
    return rounded(log.select("model", "lang", "f1", "fit_time_s", "positive_rate"),
                   "f1", "fit_time_s", "positive_rate")


@query("incremental_scores", f"""WITH {REPLIES_SQL}
  SELECT id, y_true, label AS y_pred FROM st WHERE status = 'ok'""")
def incremental_scores(spark, sf_dir):
    source = scratch.new_path(spark, "replies")
    out = scratch.new_path(spark, "labels")
    checkpoint = scratch.new_path(spark, "stream")
    rows = replies(spark, sf_dir)
    # A third of the ids comes twice, in whichever batches their files fall.
    rows.union(rows.where(F.col("id") % 3 == 0)).repartition(4).write.parquet(source)
    stream = incremental.read_replies(spark, source, files_per_batch=2)
    incremental.score_stream(stream, "political", out, checkpoint,
                             horizon_hours=24).awaitTermination()
    return spark.read.parquet(out).select("id", "y_true", "y_pred")


@query("skipped_lines", f"""WITH {PREDICTIONS_SQL}
  SELECT id::INTEGER AS row_index, y_true, y_pred FROM pred
  WHERE model = 'count_linear_svm' AND id % 7 <> 0""")
def skipped_lines(spark, sf_dir):
    """A stored run as CSV, every seventh line damaged: those are left out."""
    path = scratch.new_path(spark, "predictions-csv")
    rows = predictions(spark, sf_dir).where("model = 'count_linear_svm'")
    shown = F.when(F.col("id") % 7 == 0, "n.d.").otherwise(F.col("y_true").cast("string"))
    rows.select(F.col("id").alias("row_index"), shown.alias("y_true"), "y_pred").write.csv(
        path, header=True)
    return P.read_predictions_csv(spark, path)


RAGGED = "model STRING, f1 DOUBLE, n BIGINT, seed INT"


@query("ragged_metrics", f"""WITH {PREDICTIONS_SQL}
  SELECT model, 0.5::DOUBLE AS f1, id AS n, CASE WHEN id % 3 > 0 THEN 42 END::INTEGER AS seed,
    CASE WHEN id % 3 = 2 THEN model || ',0.5,' || id || ',42,100,all' END AS line
  FROM pred""")
def ragged_metrics(spark, sf_dir):
    """A metrics log whose rows have three, four or six fields under a header of three."""
    path = scratch.new_path(spark, "ragged-csv")
    line = F.concat("model", F.lit(",0.5,"), F.col("id").cast("string"), F.when(
        F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, ",42").otherwise(",42,100,all"))
    header = spark.createDataFrame([("model,f1,n",)], "value string")
    header.union(predictions(spark, sf_dir).select(line)).write.text(path)
    return metrics_log.read_metrics_csv(spark, path, RAGGED, too_long="line")
