"""Labelling runs over tables: prompts out, replies in, resume, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.functions import replies as R
from gazette.functions.text import fill_template

# The JSON key of each target, and the slot an article takes in a prompt.
KEYS = {"political": "political", "domestic": "domestic"}
SLOT = "{txt}"

# Prompt texts are a parameter; these are this library's own.
PROMPTS = {
    "political": (
        "Decide whether politics is the central subject of this newspaper article: government, "
        "parties, elections, public policy, international relations. Politics mentioned in "
        "passing does not count.\n"
        'Answer with JSON only: {"political": 1} if it is, {"political": 0} if it is not.\n\n'
        "Article:\n{txt}"
    ),
    "domestic": (
        "Decide whether this newspaper article is about politics inside the country (1) or "
        "about foreign and international politics (0).\n"
        'Answer with JSON only: {"domestic": 1} or {"domestic": 0}.\n\n'
        "Article:\n{txt}"
    ),
}


def check_target(target: str) -> str:
    if target not in KEYS:
        raise ValueError(f"target must be one of {', '.join(KEYS)}")
    return target


def prompt_table(df: DataFrame, target: str, template: str | None = None) -> DataFrame:
    """``id, target, json_key, prompt`` with the whole text of each article."""
    check_target(target)
    template = PROMPTS[target] if template is None else template
    if not template.strip():
        raise ValueError("the prompt is empty")
    return df.select("id", F.lit(target).alias("target"), F.lit(KEYS[target]).alias("json_key"),
                     fill_template(template, SLOT, F.col("description")).alias("prompt"))


def parse_replies(df: DataFrame, target: str) -> DataFrame:
    """Add ``y_pred`` (NULL unless usable) and ``status`` to ``reply, finish_reason`` rows."""
    key = KEYS[check_target(target)]
    reply, reason = F.col("reply"), F.col("finish_reason")

    def outcome(fields: Column) -> Column:
        label = R.value_label(R.keyed_value(fields, key))
        return F.struct(label.alias("y_pred"),
                        R.reply_status(reply, reason, fields, label, key).alias("status"))

    # The lambda binds the parsed object, so a reply is parsed once however often it is used.
    parsed = df.withColumn("_out", F.transform(F.array(R.reply_object(reply)), outcome)[0])
    usable = F.when(F.col("_out.status") == R.OK, F.col("_out.y_pred"))
    return parsed.withColumns({"y_pred": usable, "status": F.col("_out.status")}).drop("_out")


def retry_table(parsed: DataFrame, default_limit: int = 512, cap: int = 2048) -> DataFrame:
    """Replies to ask again, with the doubled token limit of the next try."""
    used = F.col("max_tokens") if "max_tokens" in parsed.columns else F.lit(default_limit)
    return parsed.filter(F.col("status") == R.RETRY_LONGER).withColumn(
        "next_max_tokens", F.least(used * 2, F.lit(cap)))


def todo(rows: DataFrame, done: DataFrame) -> DataFrame:
    """The rows without a stored prediction: a set difference, in whatever order they came."""
    return rows.join(done.select("id"), "id", "left_anti")


def resume_check(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``matching, y_true_differs, not_in_split``: may stored predictions be resumed from?"""
    now = rows.select("id", F.col("y_true").alias("_now"), F.lit(True).alias("_in_split"))
    old = done.select("id", F.col("y_true").alias("_old"))
    both = old.join(now, "id", "left")
    same = F.col("_now").eqNullSafe(F.col("_old"))
    inside = F.col("_in_split").isNotNull()
    return both.agg(F.count_if(inside & same).alias("matching"),
                    F.count_if(inside & ~same).alias("y_true_differs"),
                    F.count_if(~inside).alias("not_in_split"))


def progress(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``n_done, n_left`` of the rows."""
    marked = rows.select("id").join(done.select("id", F.lit(1).alias("_done")).distinct(), "id",
                                    "left")
    return marked.agg(F.count("_done").alias("n_done"),
                      (F.count("*") - F.count("_done")).alias("n_left"))
