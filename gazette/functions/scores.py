"""Scores from the four cells of a confusion table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 of the positive class, 0 when undefined."""
    return ratio_or_zero(2 * tp, 2 * tp + fp + fn)


def accuracy(tn: Column, fp: Column, fn: Column, tp: Column) -> Column:
    return F.try_divide((tn + tp).cast("double"), (tn + fp + fn + tp).cast("double"))


def is_false_positive(y_true: Column, y_pred: Column) -> Column:
    return (y_true == 0) & (y_pred == 1)


def is_false_negative(y_true: Column, y_pred: Column) -> Column:
    return (y_true == 1) & (y_pred == 0)
