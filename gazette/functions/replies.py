"""Turn a model's JSON reply into a 0/1 label and a status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gazette.functions.text import is_blank

# Statuses of a reply, the finish reason of a reply cut by the token limit,
# and the outermost braces of a text.
OK = "ok"
RETRY_LONGER = "retry_longer"
EMPTY = "empty"
MISSING_KEY = "missing_key"
BAD_VALUE = "bad_value"
CUT_SHORT = "length"
OUTER_BRACES = r"(?s)\{.*\}"
WHOLE_NUMBER = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"


def strict_object(reply: Column) -> Column:
    """The whole reply as a JSON object of strings, else NULL."""
    return F.from_json(reply, "map<string,string>")


def embedded_object(reply: Column) -> Column:
    """The text from the first ``{`` to the last ``}`` as a JSON object, else NULL."""
    return strict_object(F.nullif(F.regexp_extract(reply, OUTER_BRACES, 0), F.lit("")))


def reply_object(reply: Column) -> Column:
    return F.coalesce(strict_object(reply), embedded_object(reply))


def keyed_value(fields: Column, key: Column | str) -> Column:
    """Value under ``key``; without the key, the value of an object's only field."""
    name = F.lit(key) if isinstance(key, str) else key
    sole = F.when(F.size(fields) == 1, F.element_at(F.map_values(fields), 1))
    return F.when(F.map_contains_key(fields, name), F.element_at(fields, name)).otherwise(sole)


def has_value(fields: Column, key: Column | str) -> Column:
    name = F.lit(key) if isinstance(key, str) else key
    return F.map_contains_key(fields, name) | (F.size(fields) == 1)


def value_label(value: Column) -> Column:
    """0 or 1 from a field value, all else is NULL.

    Whole decimals count as their integer, booleans and their names as 1 and 0.
    """
    number = F.when(F.regexp_like(value, F.lit(WHOLE_NUMBER)),
                    F.trim(value).try_cast("double").try_cast("int"))
    number = F.when(value == "true", 1).when(value == "false", 0).otherwise(number)
    return F.when(number.isin(0, 1), number)


def reply_status(reply: Column, finish_reason: Column, fields: Column, label: Column,
                 key: Column | str) -> Column:
    """Why a reply can be used or not; ``retry_longer`` asks again with a larger limit."""
    text = F.coalesce(reply, F.lit(""))
    return (
        F.when(is_blank(text) & (finish_reason == CUT_SHORT), RETRY_LONGER)
        .when(is_blank(text), EMPTY)
        .when(fields.isNull(), RETRY_LONGER)
        .when(~has_value(fields, key), MISSING_KEY)
        .when(label.isNull(), BAD_VALUE)
        .otherwise(OK)
    )
