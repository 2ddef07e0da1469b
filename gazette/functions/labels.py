"""Label and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code for "not coded", the year of an unreadable date, and the day-first
# forms a date may take.
SENTINEL = 99
NO_YEAR = -1
DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d")


def label_number(raw: Column) -> Column:
    """Label text to a number; anything unreadable, and NaN, becomes NULL."""
    number = F.trim(raw.cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def parse_day_first(raw: Column) -> Column:
    """Day-first date, NULL when no form fits."""
    forms = [F.try_to_timestamp(raw, F.lit(form)) for form in DAY_FIRST_FORMATS]
    return F.coalesce(*forms).cast("date")


def year_number(raw: Column) -> Column:
    return F.coalesce(F.year(parse_day_first(raw)), F.lit(NO_YEAR))


def year_category(raw: Column) -> Column:
    """Year as a category; an unreadable date is its own category."""
    return year_number(raw).cast("string")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def binary_or_null(value: Column) -> Column:
    """Keep 0 and 1, else NULL."""
    return F.when(value.isin(0, 1), value)


def first_argmax(scores: Column) -> Column:
    """0-based position of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
