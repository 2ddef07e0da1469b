"""Evaluation of binary predictions ``(y_true, y_pred[, score])``, per group if asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.functions import scores as S
from gazette.functions.text import short_text
from gazette.operators.ordering import join_groups, running_totals
from gazette.sources.scratch import written

# Rows of an error table, and its columns.
ERROR_ROWS = 20
ERROR_COLUMNS = ("id", "y_true", "y_pred", "score", "headline_short", "description_short")


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``tn, fp, fn, tp`` in one pass."""
    return df.groupBy(*by).agg(*_cells())


def _cells() -> list[Column]:
    y, p = F.col("y_true"), F.col("y_pred")
    return [F.count_if((y == 0) & (p == 0)).alias("tn"),
            F.count_if(S.is_false_positive(y, p)).alias("fp"),
            F.count_if(S.is_false_negative(y, p)).alias("fn"),
            F.count_if((y == 1) & (p == 1)).alias("tp")]


def f1_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``f1, accuracy, n``: F1 of the positive class, the share of rows told right, and all rows.

    Labels outside 0 and 1 count as rows, right where both sides agree.
    """
    y, p = F.col("y_true"), F.col("y_pred")
    cells = df.groupBy(*by).agg(*_cells(), F.count_if(y == p).alias("hits"),
                                F.count("*").alias("n"))
    return cells.select(*by, S.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"),
                        F.try_divide(F.col("hits").cast("double"), "n").alias("accuracy"), "n")


def run_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What a finished labelling run reports: ``f1, n_samples, positive_rate``."""
    cells = df.groupBy(*by).agg(*_cells(), F.count_if(F.col("y_true") == 1).alias("positive"),
                                F.count("*").alias("n_samples"))
    return cells.select(*by, S.f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), "n_samples",
                        F.try_divide(F.col("positive").cast("double"), "n_samples")
                        .alias("positive_rate"))


def with_error_flags(df: DataFrame) -> DataFrame:
    y, p = F.col("y_true"), F.col("y_pred")
    return df.withColumns({"is_fp": S.is_false_positive(y, p), "is_fn": S.is_false_negative(y, p)})


def class_scores(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class of any label set: ``class, tp, predicted, support, precision, recall, f1_score``.

    Everything after the first aggregate runs on one row per pair of labels.
    """
    pairs = df.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    n = F.col("n")
    hit = F.when(F.col("y_true") == F.col("y_pred"), n).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = pairs.select(*by, F.explode(F.array(
        F.struct(F.col("y_true").alias("class"), n.alias("support"), zero.alias("predicted"),
                 hit.cast("bigint").alias("tp")),
        F.struct(F.col("y_pred").alias("class"), zero.alias("support"), n.alias("predicted"),
                 zero.alias("tp")),
    )).alias("side")).select(*by, "side.*")
    totals = sides.groupBy(*by, "class").agg(
        *[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return totals.withColumns({
        "precision": S.ratio_or_zero(tp, predicted),
        "recall": S.ratio_or_zero(tp, support),
        "f1_score": S.ratio_or_zero(2 * tp, predicted + support),
    })


def classification_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``class, precision, recall, f1_score, support`` with accuracy, macro and weighted rows.

    The accuracy row holds the accuracy in all four columns.
    """
    per_class = class_scores(df, by)
    support = F.col("support").cast("double")
    measures = ("precision", "recall", "f1_score")
    rows = per_class.select(*by, F.col("class").cast("string").alias("class"), *measures,
                            support.alias("support"))
    whole = per_class.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("acc"),
        F.sum(support).alias("n"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * support) / F.sum(support)).alias(f"weighted_{m}") for m in measures],
    )

    def line(name: str, cells: list, last) -> object:
        return F.struct(F.lit(name).alias("class"),
                        *[c.alias(m) for c, m in zip(cells, measures)], last.alias("support"))

    summary = whole.select(*by, F.explode(F.array(
        line("accuracy", [F.col("acc")] * 3, F.col("acc")),
        line("macro avg", [F.col(f"macro_{m}") for m in measures], F.col("n")),
        line("weighted avg", [F.col(f"weighted_{m}") for m in measures], F.col("n")),
    )).alias("line")).select(*by, "line.*")
    return rows.unionByName(summary)


def balanced_accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean recall over the classes that occur in ``y_true``."""
    seen = class_scores(df, by).filter(F.col("support") > 0)
    return seen.groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def score_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., score, pos, neg``: one row per distinct score."""
    return df.filter(F.col("score").isNotNull()).groupBy(*by, "score").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"),
        F.count_if(F.col("y_true") != 1).alias("neg"))


def stored_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``score_counts`` as a written table, so that curves and totals scan the data once."""
    return written(score_counts(df, by), "score-counts")


def curve_of_counts(counts: DataFrame, by: Sequence[str] = (), buckets: int | None = None,
                    keep_range: bool = False) -> DataFrame:
    """``by..., score, pos, neg, tp, fp`` from stored counts."""
    return running_totals(counts, "score", {"tp": F.col("pos"), "fp": F.col("neg")}, by,
                          descending=True, buckets=buckets, stored=True,
                          keep_range=keep_range)


def cumulative_counts(df: DataFrame, by: Sequence[str] = (),
                      buckets: int | None = None) -> DataFrame:
    """Predictions at or above each distinct score."""
    return curve_of_counts(stored_counts(df, by), by, buckets)


def _with_totals(curve: DataFrame, counts: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if by:
        return join_groups(curve, totals, by)
    return curve.withColumns({c: totals.select(c).scalar() for c in ("all_pos", "all_neg")})


def _mark_corners(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keep the ends of the curve and the points where its step changes.

    The next point may lie in the next range, so each range also learns the first step of the
    range after it, from one row per range.
    """
    keys = [*by, "_range"]
    step = F.struct("pos", "neg")
    edges = curve.groupBy(*keys).agg(F.max_by(step, F.col("score")).alias("_first_step"))
    after = W.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("_range").desc())
    edges = edges.select(*keys, F.lead("_first_step").over(after).alias("_next_range"))
    within = W.partitionBy(*keys).orderBy(F.col("score").desc())
    joined = join_groups(curve, edges, keys)
    following = F.coalesce(F.lead(step).over(within), F.col("_next_range"))
    marked = joined.withColumn("_next", following)
    is_first = (F.col("tp") + F.col("fp")) == (F.col("pos") + F.col("neg"))
    bends = ((F.col("_next.pos") != F.col("pos")) | (F.col("_next.neg") != F.col("neg")))
    return (marked.filter(F.col("_next").isNull() | is_first | bends)
            .drop("_next", "_next_range"))


def roc_points(df: DataFrame, by: Sequence[str] = (), drop_intermediate: bool = True,
               buckets: int | None = None) -> DataFrame:
    """``fpr, tpr, threshold`` from (0, 0, infinity) on; points inside a straight run may go."""
    counts = stored_counts(df, by)
    curve = curve_of_counts(counts, by, buckets, keep_range=True)
    kept = _with_totals(_mark_corners(curve, by) if drop_intermediate else curve, counts, by)
    rate = lambda part, whole: F.try_divide(F.col(part).cast("double"), F.col(whole))
    points = kept.select(*by, rate("fp", "all_neg").alias("fpr"),
                         rate("tp", "all_pos").alias("tpr"), F.col("score").alias("threshold"))
    groups = counts.groupBy(*by).agg(F.count("*").alias("_n"))
    start = groups.select(*by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                          F.lit(float("inf")).alias("threshold"))
    return points.unionByName(start)


def roc_auc(df: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve: the share of (positive, negative) pairs in the right order.

    A positive loses to the negatives counted at or above its score, except that those it ties
    with count half.
    """
    curve = cumulative_counts(df, by, buckets)
    pos, neg, fp = (F.col(c).cast("double") for c in ("pos", "neg", "fp"))
    pairs = F.sum(pos) * F.sum(neg)
    lost = F.sum(pos * (fp - neg / 2))
    return curve.groupBy(*by).agg(F.try_divide(pairs - lost, pairs).alias("roc_auc"))


def pr_points(df: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """``precision, recall, threshold`` per distinct score, and the end point (1, 0)."""
    counts = stored_counts(df, by)
    curve = _with_totals(curve_of_counts(counts, by, buckets), counts, by)
    tp, fp = F.col("tp").cast("double"), F.col("fp")
    recall = F.coalesce(F.try_divide(tp, F.col("all_pos")), F.lit(1.0))
    points = curve.select(*by, (tp / (tp + fp)).alias("precision"), recall.alias("recall"),
                          F.col("score").alias("threshold"))
    groups = counts.groupBy(*by).agg(F.count("*").alias("_n"))
    end = groups.select(*by, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
                        F.lit(None).cast("double").alias("threshold"))
    return points.unionByName(end)


def average_precision(df: DataFrame, by: Sequence[str] = (),
                      buckets: int | None = None) -> DataFrame:
    """Step sum of precision over the gains in recall (not the trapezoid Spark ML reports)."""
    curve = cumulative_counts(df, by, buckets)
    tp, fp = F.col("tp").cast("double"), F.col("fp")
    gained = F.sum(F.col("pos") * tp / (tp + fp))
    return curve.groupBy(*by).agg(
        S.ratio_or_zero(gained, F.sum("pos")).alias("average_precision"))


def error_table(df: DataFrame, kind: str, rows: int = ERROR_ROWS) -> DataFrame:
    """The worst errors with short texts: false positives from the highest score down
    (``kind="fp"``), false negatives from the lowest score up (``kind="fn"``)."""
    y, p, score = F.col("y_true"), F.col("y_pred"), F.col("score")
    if kind == "fp":
        wrong, order = S.is_false_positive(y, p), score.desc()
    elif kind == "fn":
        wrong, order = S.is_false_negative(y, p), score.asc()
    else:
        raise ValueError("kind must be 'fp' or 'fn'")
    # Texts are shortened after the top rows are known.
    top = df.filter(wrong).orderBy(order, "id").limit(rows)
    return top.withColumns({
        "headline_short": short_text(F.col("headline")),
        "description_short": short_text(F.col("description")),
    }).select(*ERROR_COLUMNS)


def score_summary(log: DataFrame, score: str = "f1", by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, sample deviation (0 for one run) and number of scored runs per model."""
    named = log
    for key in by:
        named = named.filter(F.col(key).isNotNull())
    return named.groupBy(*by).agg(
        F.avg(score).alias(score),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"),
        F.count(score).alias("count"),
    ).orderBy(F.desc(score), *by)


def best_row(log: DataFrame, score: str = "f1", name: str = "model") -> DataFrame:
    """The row with the highest score; the first name wins a tie."""
    return log.orderBy(F.desc_nulls_last(score), name).limit(1)


def fit_time_table(log: DataFrame) -> DataFrame:
    """Fit time against F1."""
    return log.select("model", "fit_time_s", "f1")


def loss_curve(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Training loss by step (by epoch where the log has no steps)."""
    x = "step" if "step" in log.columns else "epoch"
    return log.filter(F.col("loss").isNotNull()).select(*by, F.col(x).alias("x"), "loss")


def eval_curve(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Evaluation metrics by step, rows without any left out."""
    x = "step" if "step" in log.columns else "epoch"
    metrics = [c for c in ("eval_f1", "eval_loss") if c in log.columns]
    present = F.coalesce(*[F.col(m) for m in metrics]).isNotNull()
    return log.filter(present).select(*by, F.col(x).alias("x"), *metrics)


def best_epoch(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step with the best ``eval_f1``, the earliest on ties."""
    rows = log.filter(F.col("eval_f1").isNotNull())
    key = F.struct(F.col("eval_f1"), -F.col("step"))
    return rows.groupBy(*by).agg(F.max_by("step", key).alias("best_step"),
                                 F.max("eval_f1").alias("best_f1"))
