"""Exact URL filters: host and path rules, and a Bloom filter cascade for listed hosts.

The cascade knows every host of the corpus. Level 0 is a Bloom filter of the listed hosts; level 1
holds the other hosts that level 0 lets pass wrongly, level 2 the listed hosts that level 1 lets
pass wrongly, and so on until nothing passes wrongly. The first level that does not hold a host
decides it, which is exact for every host of the corpus, and no page is joined with anything: the
levels are arrays of 64-bit words that reach the scan of the pages as scalar subqueries.

Levels take about ``BITS`` bits per listed host. If they would exceed ``SHARD_BITS``, hosts are
split by hash into shards with a cascade each, and the pages of a shard are tested by its cascade
in a scan of their own, so what a task holds stays bounded. Everything is built of SQL functions.

A NULL url, or one without ``://``, has an empty host and path; the empty host is never listed.
Repeated rows repeat their verdict. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.sources.scratch import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS, HASHES = 10, 4
SHARD_BITS = 1 << 26
# The rules of the query, (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# Words of a host's labels that put it on the list.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "malware", "phishing", "pills", "porn", "spam",
                "warez")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], part: int
              ) -> Column:
    """Of the longest rule that fits: its text (``part`` 0) or its verdict (1)."""
    out = F.lit(None).cast("string")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(
            path, F.lit(rule_path))
        out = F.when(fits, F.lit((rule_host + rule_path, verdict)[part])).otherwise(out)
    return out


def has_listed_word(host: Column, words: Sequence[str] = LISTED_WORDS) -> Column:
    """Whether a part of a host between dots and hyphens is one of ``words``."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(w) for w in words]))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its number, its size, and a one-row table of its words."""

    number: int
    bits: int
    words: DataFrame

    def holds(self, key: Column) -> Column:
        words = self.words.scalar()
        out = F.lit(True)
        for bit in _places(key, self.number, self.bits):
            word = F.element_at(words, (F.floor(bit / 64) + 1).cast("int"))
            # The width of a shift is a column only through the SQL function.
            shifted = F.call_function("shiftrightunsigned", word, (bit % 64).cast("int"))
            out = out & (shifted.bitwiseAND(F.lit(1)) == 1)
        return out


def _places(key: Column, number: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def _level(keys: DataFrame, number: int, n: int) -> Level:
    bits = 64 * math.ceil(max(1, n) * BITS / 64)
    places = keys.select(F.explode(F.array(*_places(F.col("key"), number, bits))).alias("bit"))
    words = places.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("ones"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word")).join(
        words, "word", "left")
    # One array of at most SHARD_BITS / 64 words.
    whole = every.agg(F.array_sort(F.collect_list(
        F.struct("word", F.coalesce("ones", F.lit(0)).alias("ones")))).alias("all")).select(
        F.transform("all", lambda w: w["ones"]).alias("words"))
    return Level(number, bits, written(whole, "level"))


def cascade(keys: DataFrame) -> list[Level]:
    """Levels for distinct ``key, listed`` rows."""
    encode = written(keys.where("listed").select("key"), "keys")
    others = written(keys.where("NOT listed").select("key"), "keys")
    levels: list[Level] = []
    n = encode.count()
    while n:
        level = _level(encode, len(levels), n)
        levels.append(level)
        wrong = written(others.where(level.holds(F.col("key"))), "keys")
        encode, others, n = wrong, encode, wrong.count()
    return levels


def is_listed(levels: Sequence[Level], key: Column) -> Column:
    """The first level without the key decides: the even ones against, the odd ones for it."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        out = F.when(level.holds(key), out).otherwise(F.lit(level.number % 2 == 1))
    return out


def judged(pages: DataFrame, listed: Column, rules: Sequence[tuple[str, str, str]] = RULES,
           id_col: str = "page_id", url_col: str = "url", shard_bits: int = SHARD_BITS
           ) -> DataFrame:
    """``id_col, host, path, rule, verdict`` of every page.

    ``listed`` is a condition on the column ``key``, a host, that says whether it is on the list.
    A rule decides first; where none fits, listed hosts are blocked and all others allowed.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    keys = written(rows.select(F.col("host").alias("key")).where("key != ''").distinct().select(
        "key", F.coalesce(listed, F.lit(False)).alias("listed")), "universe")
    shards = max(1, math.ceil(keys.where("listed").count() * BITS / shard_bits))
    out: DataFrame | None = None
    for shard in range(shards):
        mine = F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(shards)) == shard
        levels = cascade(keys.where(mine) if shards > 1 else keys)
        part = rows
        if shards > 1:
            part = part.where(F.pmod(F.xxhash64("host", F.lit(-1)), F.lit(shards)) == shard)
        h, p = F.col("host"), F.col("path")
        blocked = (h != "") & is_listed(levels, h)
        part = part.select(
            id_col, "host", "path", best_rule(h, p, rules, 0).alias("rule"),
            F.coalesce(best_rule(h, p, rules, 1),
                       F.when(blocked, "block").otherwise("allow")).alias("verdict"))
        out = part if out is None else out.union(part)
    return out
