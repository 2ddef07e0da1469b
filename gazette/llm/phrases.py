"""Collocations: phrases of two to five words that occur together more often than by chance.

Method: a weighted de Bruijn graph per language. Nodes are runs of four words, and an edge leads
from a run to the one a word further on; it is a run of five words, weighted by its occurrences.
Each word of a piece starts one run, cut short where the piece ends, so every text is cut once,
and the cut runs are the piece-end corrections. The count of a shorter phrase follows without
reading texts again: what flows out of it into phrases one word longer, plus the runs that end
with it. Chains of edges with one way in and out and equal weight are compacted to paths by
pointer doubling; a path tells its five-word phrases, and which four-word ones it holds at the
same weight.

Pieces are cut at pairs of words that are rarer than the least count already, as no wanted phrase
holds such a pair. Which pairs are frequent is kept as bits of their hashes, of bounded size: a
false bit lets a pair through, which costs rows and never a result. Counts are exact.

Scale: tasks count runs before they shuffle, so a frequent run is one row per task and a language
of any size is spread over all of them. Rows carry counts, not occurrences. Only the best
``top`` rows per partition and language meet for the ranking.

A NULL text is empty, a NULL language is ``und``; both add nothing or count as stated. Repeated
rows count each. Empty tables give an empty result. Other columns are ignored. A very long text
is cut at once in memory proportional to it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gazette.llm.common import GOLDEN, mix
from gazette.shipping import ship_package
from gazette.sources.scratch import written

# A-Z in lower case, the characters that end a piece, the longest phrase.
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
ENDS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 5
LEAST, TOP = 100, 2000
# Texts of one language counted together, in bytes; bits of the pair filter, a frequent pair.
TEXT_BYTES = 8 << 20
LEAST_BITS, MOST_BITS, BITS_A_PAIR = 1 << 16, 1 << 25, 32

PLAIN = bytes.maketrans(UPPER + ENDS, LOWER + b"." * len(ENDS))
END = b"."  # a piece end stands as a word of its own, which no word can equal


class Numbered:
    """The words of some texts as small numbers; 0 is the end of a piece."""

    def __init__(self, texts: list[str]):
        numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        numbers[END]
        raw = f" {END.decode()} ".join(texts).encode("utf-8", "replace")
        # What separates words: space and tab; every other white space ended a piece already.
        tokens = raw.translate(PLAIN).replace(END, b" " + END + b" ").split()
        self.ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        self.words = list(numbers)

    def pairs(self) -> np.ndarray:
        """Whether a word follows the word at each place, in the same piece."""
        return (self.ids[:-1] != 0) & (self.ids[1:] != 0)

    def pair_codes(self, lang: str) -> np.ndarray:
        """A 32-bit hash of each word and its successor."""
        from xxhash import xxh3_64_intdigest

        seed = np.uint64(xxh3_64_intdigest(lang.encode("utf-8", "replace")))
        codes = np.array([xxh3_64_intdigest(w) for w in self.words], np.uint64)
        with np.errstate(over="ignore"):
            first = mix(codes + seed) * GOLDEN
            return (mix(first[self.ids[:-1]] + codes[self.ids[1:]]) >> np.uint64(32)).astype(
                np.uint32)


def count_pairs(texts: list[str], lang: str) -> tuple[np.ndarray, np.ndarray]:
    numbered = Numbered(texts)
    return np.unique(numbered.pair_codes(lang)[numbered.pairs()], return_counts=True)


def count_runs(texts: list[str], lang: str, bits: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Runs of up to five words, one from each word on, with their occurrences."""
    numbered = Numbered(texts)
    ids, size = numbered.ids, np.int64(len(numbered.words))
    go_on = np.zeros(len(ids), bool)
    codes = numbered.pair_codes(lang) & np.uint32(len(bits) * 64 - 1)
    go_on[:-1] = numbered.pairs() & (
        bits[codes >> np.uint32(6)] >> (codes & np.uint32(63)).astype(np.uint64) & np.uint64(1)
    ).astype(bool)
    at = np.flatnonzero(ids)
    runs = np.zeros(len(at), np.int64)
    phrases: list[str] = []
    counts = []
    code = np.zeros(len(at), np.int64)
    for k in range(LONGEST):
        # Runs are numbered anew with each word, so that numbers stay small and exact.
        pairs, first, code, times = np.unique(
            code * size + ids[at + k], return_index=True, return_inverse=True, return_counts=True)
        done = np.ones(len(at), bool) if k == LONGEST - 1 else ~go_on[at + k]
        runs = np.bincount(code[done], minlength=len(pairs))
        for p in np.flatnonzero(runs):
            start = at[first[p]]
            phrases.append(b" ".join([numbered.words[i] for i in ids[start:start + k + 1]])
                           .decode("utf-8", "replace"))
        counts.append(runs[runs > 0])
        at, code = at[~done], code[~done]
    return phrases, np.concatenate(counts)


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str]]]:
    """Texts of one language at a time, some megabytes together."""
    held: dict[str, list[str]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                              strict=True):
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            # Many languages fill the memory as one large one does.
            if sizes[lang] >= TEXT_BYTES or len(sizes) > 64:
                for full in ([lang] if sizes[lang] >= TEXT_BYTES else list(held)):
                    sizes.pop(full)
                    yield full, held.pop(full)
    yield from held.items()


def _rows(texts: DataFrame, work, schema: str) -> DataFrame:
    """What ``work`` makes of each language's texts, task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _by_language(batches):
            columns = work(held, lang)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    ship_package(texts.sparkSession)
    return texts.mapInArrow(run, schema)


def frequent_pairs(texts: DataFrame, least: int) -> np.ndarray:
    """The bit of every pair hash that occurs ``least`` times or more, in 64-bit words."""

    def work(held, lang):
        codes, times = count_pairs(held, lang)
        return {"code": pa.array(codes.view(np.int32)), "times": pa.array(times)}

    counts = _rows(texts, work, "code int, times bigint").groupBy("code").agg(
        F.sum("times").alias("times")).where(F.col("times") >= least).select("code")
    codes = written(counts, "pairs")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (codes.count() * BITS_A_PAIR).bit_length()))
    place = F.col("code").bitwiseAND(bits - 1)
    # At most bits / 64 rows, whatever the size of the corpus.
    words = codes.groupBy(F.shiftright(place, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, code & {63})")).alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("value").to_numpy().view(np.uint64)
    return out


def count_phrases(docs: DataFrame, least: int = LEAST, text_col: str = "text",
                  lang_col: str = "lang") -> list[DataFrame]:
    """Tables ``lang, phrase, f`` of phrases of 1, 2, ... 5 words.

    Complete for single words, and for longer phrases without a pair rarer than ``least``.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = texts.sparkSession.sparkContext.broadcast(frequent_pairs(texts, least))

    def work(held, lang):
        phrases, times = count_runs(held, lang, shared.value)
        return {"lang": pa.array([lang] * len(phrases), pa.string()),
                "phrase": pa.array(phrases, pa.string()), "f": pa.array(times)}

    runs = _rows(texts, work, "lang string, phrase string, f bigint").groupBy(
        "lang", "phrase").agg(F.sum("f").alias("f"))
    runs = written(runs.withColumn("words", F.size(F.split("phrase", " "))), "runs")
    tables: list[DataFrame] = []
    for k in range(LONGEST, 0, -1):
        ends = runs.where(F.col("words") == k).select("lang", "phrase", "f")
        if tables:
            flow = tables[-1].select("lang", F.substring_index("phrase", " ", k).alias("phrase"),
                                     "f")
            ends = flow.union(ends).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        tables.append(written(ends, f"phrases-{k}"))
    return tables[::-1]


def paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lang, words, f``: maximal chains of edges through nodes with one way in and out.

    ``edges`` and ``nodes`` hold ``lang, phrase, f`` of phrases of five and four words. A node
    joins its two edges if both carry all of its occurrences. Such nodes cannot form a ring, as no
    text could have entered it.
    """
    one_in = edges.select("lang", F.col("phrase").alias("before"), F.col("f").alias("f_in"),
                          F.substring_index("phrase", " ", 1 - LONGEST).alias("node"))
    one_out = edges.select("lang", F.col("phrase").alias("edge"), F.col("f").alias("f_out"),
                           F.substring_index("phrase", " ", LONGEST - 1).alias("node"))
    inside = nodes.withColumnRenamed("phrase", "node")
    links = one_in.join(one_out, ["lang", "node"]).join(inside, ["lang", "node"]).where(
        "f_in = f AND f_out = f").select("lang", "edge", "before")
    steps = edges.withColumnRenamed("phrase", "edge").join(links, ["lang", "edge"], "left").select(
        "lang", "edge", "f", F.coalesce("before", "edge").alias("head"),
        F.col("before").isNotNull().cast("bigint").alias("steps"))
    steps = written(steps, "paths")
    while True:
        # Each round doubles how far an edge has looked back.
        ahead = steps.where("steps > 0").select(
            "lang", F.col("edge").alias("head"), F.col("head").alias("further"),
            F.col("steps").alias("more"))
        jumped = steps.join(ahead, ["lang", "head"], "left").select(
            "lang", "edge", "f", F.coalesce("further", "head").alias("head"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
            F.col("further").isNotNull().alias("moved"))
        jumped = written(jumped, "paths")
        moved = not jumped.where("moved").isEmpty()
        steps = jumped.drop("moved")
        if not moved:
            break
    last = F.struct("steps", F.substring_index("edge", " ", -1).alias("word"))
    return steps.groupBy("lang", F.col("head").alias("head")).agg(
        F.first("f").alias("f"), F.array_sort(F.collect_list(last)).alias("tail")).select(
        "lang", F.concat(F.slice(F.split("head", " "), 1, LONGEST - 1),
                         F.col("tail.word")).alias("words"), "f")


def _windows(compact: DataFrame, k: int) -> DataFrame:
    """The phrases of ``k`` words along the paths, with their path's weight."""
    starts = F.sequence(F.lit(1), F.size("words") - k + 1)
    return compact.select("lang", "f", F.explode(F.transform(starts, lambda i: F.array_join(
        F.slice(F.col("words"), i, F.lit(k)), " "))).alias("phrase"))


def _unheld(short: DataFrame, longer: DataFrame) -> DataFrame:
    """Phrases that no longer one (``lang, phrase, f`` of parts of it) holds at the same count."""
    best = longer.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    return short.join(best, ["lang", "phrase"], "left").where(
        "held IS NULL OR held < f").drop("held")


def candidates(tables: list[DataFrame], least: int = LEAST) -> DataFrame:
    """``lang, phrase, words, f``: frequent phrases of two words or more, without those that
    stand in a longer one as often.

    A phrase held by a longer one at equal count is held by one a single word longer, too.
    """
    frequent = [t.where(F.col("f") >= least) for t in tables]
    compact = written(paths(frequent[-1], frequent[-2]), "compact")
    found = [(LONGEST, _windows(compact, LONGEST)),
             (LONGEST - 1, _unheld(frequent[-2], _windows(compact, LONGEST - 1)))]
    for k in range(2, LONGEST - 1):
        longer = frequent[k]
        parts = longer.select("lang", "f", F.explode(F.array(
            F.substring_index("phrase", " ", k), F.substring_index("phrase", " ", -k))).alias(
            "phrase"))
        found.append((k, _unheld(frequent[k - 1], parts)))
    out = None
    for k, rows in found:
        part = rows.select("lang", "phrase", F.lit(k).alias("words"), "f")
        out = part if out is None else out.union(part)
    return out


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its two parts at the cut with the lowest
    score (the first of equal ones), ``n`` all words of the language, and ``score`` the whole part
    of ``1000 a n / (l r)``. Best score first, then count, then phrase.
    """
    tables = count_phrases(docs, least, text_col, lang_col)
    totals = tables[0].groupBy("lang").agg(F.sum("f").alias("n"))
    known = None
    for t in tables[:-1]:
        part = t.where(F.col("f") >= least)
        known = part if known is None else known.union(part)
    known = written(known, "known")
    cuts = candidates(tables, least).select("lang", "phrase", "words", F.col("f").alias("a"),
                                            F.explode(F.sequence(F.lit(1), F.col("words") - 1))
                                            .alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        F.expr("substring_index(phrase, ' ', cut)").alias("left"),
        F.expr("substring_index(phrase, ' ', cut - words)").alias("right"))
    sides = cuts.join(known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")),
                      ["lang", "left"]).join(
        known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")),
        ["lang", "right"]).join(totals, "lang")
    # Products may pass 64 bits; the quotient of whole decimals is exact.
    wide = "cast({} as decimal(19, 0))"
    score = F.expr(f"(1000 * ({wide.format('a')} * {wide.format('n')})) div "
                   f"({wide.format('l')} * {wide.format('r')})")
    lowest = sides.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("at"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return lowest.select("lang", "phrase", "a", "at.l", "at.r", "n", "at.score").withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
