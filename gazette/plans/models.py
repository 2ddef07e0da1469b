"""Vectors, trained models, grid search, ensemble."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gazette.operators import candidates as C
from gazette.operators import evaluation, feature_sets, splits, training
from gazette.operators import vectors as V
from gazette.plans.base import SPLIT_SQL, articles, query
from gazette.plans.cleaning import YEAR_SQL
from gazette.plans.exploration import VIEW_SQL, rounded, view
from gazette.plans.texts import CHAR_COUNTS_SQL, COUNTS_SQL, SETTINGS, _counts
from gazette.sources.articles import with_features


def training_table(spark, sf_dir, target="political"):
    """``id, label, split`` and the three feature columns."""
    rows = splits.with_split(with_features(articles(spark, sf_dir)))
    return rows.select("id", F.col(target).alias("label"), "split", "description", "headline",
                       "year")


def candidate(name: str) -> C.Candidate:
    return next(c for c in C.candidates() if c.name == name)


# --------------------------------------------------------------------------- vectors

@query("tfidf_vectors", f"""WITH {COUNTS_SQL}
  SELECT spl.id, count(weight)::INTEGER AS n_terms,
    round(coalesce(sum(weight), 0), 6) AS weight_sum
  FROM spl LEFT JOIN wt ON wt.id = spl.id GROUP BY spl.id""")
def tfidf_vectors(spark, sf_dir):
    rows, counts, _ = _counts(spark, sf_dir)
    train = F.col("split") == splits.TRAIN
    n = rows.filter(train).select("id").count()
    vectorizer = V.fit_vectorizer(counts.filter(train).drop("split"), n, SETTINGS)
    part = V.sparse_rows(counts.drop("split"), vectorizer)
    table = V.write_features(rows, [(part, vectorizer.size)], ["id"])
    values = F.col("features.values")
    return rounded(table.arrays.select(
        "id", F.size(values).alias("n_terms"),
        F.aggregate(values, F.lit(0.0), lambda a, x: a + x).alias("weight_sum")), "weight_sum")


@query("year_one_hot", f"""WITH {SPLIT_SQL},
  y AS (SELECT id, split, CAST({YEAR_SQL} AS VARCHAR) AS year FROM spl),
  ix AS (SELECT year, row_number() OVER (ORDER BY year) - 1 AS i FROM
    (SELECT DISTINCT year FROM y WHERE split = 'train'))
  SELECT id, year, coalesce(i, -1)::INTEGER AS hot, (SELECT count(*) FROM ix)::INTEGER AS width
  FROM y LEFT JOIN ix USING (year)""")
def year_one_hot(spark, sf_dir):
    rows = splits.with_split(with_features(articles(spark, sf_dir))).select("id", "split", "year")
    index = V.category_index(rows.filter(F.col("split") == splits.TRAIN), "year")
    width = index.count()
    table = V.write_features(rows, [(V.one_hot(rows, "year", index, width), width)], ["id", "year"])
    values = vector_to_array(F.col("features"))
    return table.vectors.select("id", "year", (F.array_position(values, F.lit(1.0)) - 1)
                                .cast("int").alias("hot"), F.size(values).alias("width"))


def _vocabulary_size_sql(source: str, text: str) -> str:
    """Known character n-grams per document for one text column."""
    return f"""SELECT id, count(*) AS n FROM (
      WITH src AS (SELECT id, split, {text} AS description FROM {source}), {CHAR_COUNTS_SQL},
      nn AS (SELECT count(*) FILTER (WHERE split = 'train') AS n FROM src),
      ok AS (SELECT term FROM cc JOIN src USING (id), nn WHERE split = 'train' GROUP BY term, n
        HAVING count(*) >= CAST(0.002 AS DOUBLE) * n AND count(*) <= CAST(0.9 AS DOUBLE) * n)
      SELECT cc.id FROM cc JOIN ok USING (term)) GROUP BY id"""


@query("assembled_features", f"""WITH {SPLIT_SQL},
  y AS (SELECT id, split, {YEAR_SQL} AS year FROM spl),
  d AS ({_vocabulary_size_sql("spl", "description")}),
  h AS ({_vocabulary_size_sql("spl", "coalesce(headline, '')")})
  SELECT y.id, (coalesce(d.n, 0) + coalesce(h.n, 0) + CASE WHEN y.year IN
    (SELECT year FROM y WHERE split = 'train') THEN 1 ELSE 0 END)::INTEGER AS n_features
  FROM y LEFT JOIN d ON d.id = y.id LEFT JOIN h ON h.id = y.id""")
def assembled_features(spark, sf_dir):
    model = candidate("tfidf_log_reg_desc_headline_year")
    data = training.prepare(training_table(spark, sf_dir))
    counts = {text: training._counts_of(data, C.CHARS, text) for text in ("description", "headline")}
    table = training.build_features(data, model, C.CHARS, counts, None)
    return table.arrays.select("id", F.size("features.indices").alias("n_features"))


SCALED = ("year", "desc_tokens", "headline_tokens")


@query("scaled_features", f"""WITH {VIEW_SQL} SELECT id, """ + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in SCALED)
    + " FROM v")
def scaled_features(spark, sf_dir):
    rows = view(spark, sf_dir).select("id", *SCALED)
    return rounded(feature_sets.scaled(rows, SCALED, rows), *SCALED)


@query("scaled_vectors")
def scaled_vectors(spark, sf_dir):
    """The same columns as one vector for Spark ML."""
    rows = view(spark, sf_dir).select("id", *SCALED)
    scaled = feature_sets.scaled(rows, SCALED, rows)
    vectors = VectorAssembler(inputCols=list(SCALED), outputCol="features").transform(scaled)
    return vectors.select("id", F.size(vector_to_array("features")).alias("width"))


# --------------------------------------------------------------------------- single models
# Solvers have no SQL form: rows are checked here, properties in the tests.

def test_predictions(spark, sf_dir, model: C.Candidate, index: int = 0, target="political"):
    data = training.prepare(training_table(spark, sf_dir, target))
    predicted = training.fit_predict(data, model, model.grid[index])
    return predicted.select("id", F.col("label").alias("y_true"), "y_pred", "score")


def register_model(name: str, model_name: str, point: int | None = None) -> None:
    """The whole job: search the grid over five folds if it has several points, refit the best.

    ``point`` registers ``<name>_point`` as well, that point of the grid without a search.
    """
    @query(name)
    def run(spark, sf_dir):
        data = training.prepare(training_table(spark, sf_dir))
        return training.train(data, candidate(model_name), parallelism=8).predictions.select(
            "id", F.col("label").alias("y_true"), "y_pred", "score")

    if point is not None:
        @query(f"{name}_point")
        def run_point(spark, sf_dir):
            return test_predictions(spark, sf_dir, candidate(model_name), point)


# Points: the last word point without class weights for the linear models.
register_model("tfidf_log_reg", "tfidf_log_reg", 14)
register_model("desc_headline_year", "tfidf_log_reg_desc_headline_year")
register_model("tfidf_svm", "tfidf_linear_svm", 14)
register_model("tfidf_naive_bayes", "tfidf_naive_bayes", 1)
register_model("poly2", "tfidf_log_reg_poly2")
register_model("poly4", "tfidf_log_reg_poly4")
register_model("poly5", "tfidf_log_reg_poly5")
register_model("count_log_reg", "count_log_reg", 8)
register_model("count_svm", "count_linear_svm", 8)


@query("best_pipeline_errors")
def best_pipeline_errors(spark, sf_dir):
    table = training_table(spark, sf_dir)
    predicted = test_predictions(spark, sf_dir, C.BEST["political"])
    texts = table.select("id", "headline", "description")
    return evaluation.error_table(predicted.join(texts, "id"), "fp")


@query("domestic_pipeline_report")
def domestic_pipeline_report(spark, sf_dir):
    predicted = test_predictions(spark, sf_dir, C.BEST["domestic"], target="domestic")
    return rounded(evaluation.classification_report(predicted),
                   "precision", "recall", "f1_score", "support")


# --------------------------------------------------------------------------- searches

@query("grid_search")
def grid_search(spark, sf_dir):
    """The whole naive Bayes grid, five folds: mean F1 per point."""
    model = candidate("tfidf_naive_bayes")
    data = training.prepare(training_table(spark, sf_dir))
    scores = spark.createDataFrame(training.grid_scores(data, model, parallelism=8),
                                   "grid_index INT, fold INT, f1 DOUBLE")
    params = spark.createDataFrame(
        [(i, p.settings.high, p.settings.min_df, p.alpha) for i, p in enumerate(model.grid)],
        "grid_index INT, ngram_high INT, min_df DOUBLE, alpha DOUBLE")
    return rounded(scores.groupBy("grid_index").agg(F.avg("f1").alias("mean_f1"))
                   .join(params, "grid_index"), "mean_f1").orderBy(F.desc("mean_f1"), "grid_index")


@query("grid_best")
def grid_best(spark, sf_dir):
    """The whole count grid, five folds, with refit on the whole training split."""
    log = training.run_baselines(training_table(spark, sf_dir), [candidate("count_log_reg")],
                                 parallelism=8)
    return rounded(log, "f1", "cv_f1").select("model", "f1", "cv_f1", "cv")


@query("linear_vote_run")
def linear_vote_run(spark, sf_dir):
    """All candidates, each searched over its grid, and the vote of the best linear ones."""
    summary, _, _ = training.run_ensemble(training_table(spark, sf_dir), C.candidates(),
                                          parallelism=8)
    return summary


@query("feature_set_cv_domestic")
def feature_set_cv_domestic(spark, sf_dir):
    return rounded(feature_sets.eval_feature_sets(view(spark, sf_dir), "domestic", parallelism=8),
                   "roc_auc_mean", "bacc_mean")


@query("feature_set_cv")
def feature_set_cv(spark, sf_dir):
    return rounded(feature_sets.eval_feature_sets(view(spark, sf_dir), "political", parallelism=8),
                   "roc_auc_mean", "bacc_mean")
