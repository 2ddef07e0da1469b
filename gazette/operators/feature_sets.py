"""How much do year, lengths and the other label tell? Cross-validated logistic regressions."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.operators.evaluation import balanced_accuracy, roc_auc
from gazette.operators.splits import stratified_folds
from gazette.sources.scratch import written

BASELINE = "(baseline) most_frequent"


TARGETS = ("political", "domestic")
NUMBERS = ("year", "desc_tokens", "headline_tokens")
# The names under which sets of several columns are reported.
ALL_NUMBERS, WITH_OTHER_LABEL = "year+tokens", "year+tokens+other_label"


def feature_sets(target: str) -> dict[str, list[str]]:
    """Each number alone, all of them, and all with the labels that are not the target."""
    others = [name for name in TARGETS if name != target]
    if len(others) == len(TARGETS):
        raise ValueError(f"{target!r} is no label of an article")
    sets = {name: [name] for name in NUMBERS}
    sets[ALL_NUMBERS] = list(NUMBERS)
    sets[WITH_OTHER_LABEL] = [*NUMBERS, *others]
    return sets


def scaled(rows: DataFrame, columns: Sequence[str], learn: DataFrame) -> DataFrame:
    """Columns at mean 0 and population deviation 1 of the rows in ``learn``; a constant column
    is only centred."""
    whole = learn.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                      *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])

    def cell(c: str):
        spread = whole.select(F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)).scalar()
        return (F.col(c) - whole.select(f"m_{c}").scalar()) / spread

    return rows.withColumns({c: cell(c) for c in columns})


def _fold_predictions(rows: DataFrame, columns: Sequence[str], fold: int, n: int) -> DataFrame:
    learn = rows.filter(F.col("fold") != fold)
    assembler = VectorAssembler(inputCols=list(columns), outputCol="features")
    vectors = assembler.transform(scaled(rows, columns, learn)).select(
        "fold", "features", F.col("label").cast("double").alias("label"))
    model = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
                               maxIter=2000).fit(vectors.filter(F.col("fold") != fold))
    return model.transform(vectors.filter(F.col("fold") == fold)).select(
        "fold", F.col("label").cast("int").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability")[1].alias("score"))


def eval_feature_sets(view: DataFrame, target: str, k: int = 5, seed: int = 42,
                      parallelism: int = 4) -> DataFrame:
    """``features, roc_auc_mean, bacc_mean`` per set and for always predicting the commoner
    class; the best area first. All sets are scored in one pass over their predictions."""
    sets = feature_sets(target)
    numeric = sorted({c for columns in sets.values() for c in columns})
    rows = view.select("id", F.col(target).alias("label"), *numeric)
    folds = stratified_folds(rows.select("id", "label"), "label", k, seed)
    data = written(rows.join(folds.select("id", "fold"), "id").select("label", "fold", *numeric),
                   "feature-sets")
    # One row per fold.
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    total = sum(sizes.values())

    def run(item: tuple[str, list[str], int]) -> DataFrame:
        name, columns, fold = item
        part = _fold_predictions(data, columns, fold, total - sizes[fold])
        return part.withColumn("features", F.lit(name))

    work = [(name, columns, fold) for name, columns in sets.items() for fold in sorted(sizes)]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        parts = list(pool.map(inheritable_thread_target(view.sparkSession)(run), work))
    parts.append(_most_frequent(data, sorted(sizes)))
    scored = written(reduce(DataFrame.unionByName, parts), "feature-set-scores")
    by = ["features", "fold"]
    scores = roc_auc(scored, by).join(balanced_accuracy(scored, by), by)
    return scores.groupBy("features").agg(
        F.avg("roc_auc").alias("roc_auc_mean"),
        F.avg("balanced_accuracy").alias("bacc_mean")).orderBy(F.desc("roc_auc_mean"), "features")


def _most_frequent(data: DataFrame, folds: Sequence[int]) -> DataFrame:
    """Every row gets the commonest label of the other folds (the smaller one on ties)."""
    counts = data.groupBy("label").agg(
        *[F.count_if(F.col("fold") != f).alias(f"n_{f}") for f in folds])
    modes = counts.agg(*[F.max_by("label", F.struct(F.col(f"n_{f}"), -F.col("label")))
                         .alias(f"mode_{f}") for f in folds])
    guess = F.lit(None).cast("int")
    for f in folds:
        guess = F.when(F.col("fold") == f, modes.select(f"mode_{f}").scalar()).otherwise(guess)
    return data.select("fold", F.col("label").alias("y_true"), guess.alias("y_pred"),
                       guess.cast("double").alias("score"), F.lit(BASELINE).alias("features"))
