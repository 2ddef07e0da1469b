"""Secrets in texts: three fixed patterns, and random strings found by token efficiency.

Natural language and ordinary code need few tokens per character under a byte-pair vocabulary;
random strings hardly merge. A run of key characters is reported as ``random`` if it yields fewer
than ``MOST_CHARS_PER_TOKEN`` characters per token, mixes letters and digits, and is neither a
known digest (a bare hexadecimal string of a common digest length), a UUID, a number, nor a
version or date, and touches no span of a fixed pattern. Domains, file names and addresses are
matched as wholes and taken out of a run; what is left of it beside them is judged. Of a run with
many separators the parts of key length that mix letters and digits are judged, or all of it if
they are most of it, so readable paths stay and blobs that happen to hold separators are found.

Spans are code points, end exclusive. NULL and empty texts have none. Texts may be of any length:
all patterns are linear in it. Each row is judged by itself, so repeated rows repeat their result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm import bpe
from gazette.llm.common import SPANS, Covered, span_count, span_text, with_results

KINDS = ("assign", "access", "hex", "random")
# The patterns of the three base kinds.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6

# The method's parameters.
LEAST_RUN = 16
MOST_CHARS_PER_TOKEN = 2.0
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
HEXADECIMAL = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
# An address; a domain or file name, which has labels on both sides of its dots and ends in a short
# one that begins with a letter.
NAME = re.compile(
    r"(?<![A-Za-z0-9_.%+-])(?:[A-Za-z0-9_.%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z0-9-]{1,63}"
    r"|(?:[A-Za-z0-9_-]{1,63}\.)+[A-Za-z][A-Za-z0-9]{1,9}(?![A-Za-z0-9_=+-]))")
SEPARATOR = re.compile(r"[/_-]")
PLAIN = re.compile(r"[0-9=/_+-]+|[^0-9]+|[A-Za-z]+[_-]?[0-9]{1,6}|v?[0-9]+([_-][0-9A-Za-z]{1,8})*")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``start, rank, end, kind`` of the fixed patterns, leftmost and non-overlapping per kind."""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text)
             if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found)


def mixed(run: str) -> bool:
    """Long enough, of letters and digits, and no digest, identifier, number or plain name."""
    if len(run) < LEAST_RUN or not any(map(str.isdigit, run)) or not any(map(str.isalpha, run)):
        return False
    if len(run) in DIGEST_LENGTHS and HEXADECIMAL.fullmatch(run):
        return False
    return not (UUID.fullmatch(run) or PLAIN.fullmatch(run))


def beside(start: int, end: int, names: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """What sorted disjoint ``names`` leave of a span."""
    out = []
    for at in range(bisect_left(names, (start, start)) - 1, len(names)):
        a, b = names[at] if at >= 0 else (start, start)
        if a >= end:
            break
        if b > start:
            if a > start:
                out.append((start, a))
            start = b
    return [*out, (start, end)] if start < end else out


def candidate_runs(text: str, taken: Sequence[tuple[int, int, int, str]]) -> list[tuple[int, int]]:
    """Runs long and mixed enough to be judged by their tokens."""
    covered, out = Covered(taken), []
    names: list[tuple[int, int]] | None = None
    for m in RUN.finditer(text):
        start, end = m.span()
        if not any(map(str.isdigit, m[0])) or not any(map(str.isalpha, m[0])):
            continue
        if covered.overlaps(start, end):
            continue
        pieces = [(start, end)]
        if text[end:end + 1] in ("@", ".") or text[max(0, start - 1):start] in ("@", "."):
            if names is None:
                names = [n.span() for n in NAME.finditer(text)]
            pieces = beside(start, end, names)
        for a, b in pieces:
            run = text[a:b]
            if not mixed(run):
                continue
            if (a, b) == (start, end) and run.count("/") <= 2 and run.count("-") <= 3 \
                    and run.count("_") <= 3:
                out.append((a, b))
                continue
            parts, at = [], a
            for part in SEPARATOR.split(run):
                if mixed(part):
                    parts.append((at, at + len(part)))
                at += len(part) + 1
            whole = 2 * sum(y - x for x, y in parts) >= b - a
            out += [(a, b)] if whole else parts
    return out


def find_spans(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
               keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) plus ``spans``, sorted by start and kind."""
    ranks = bpe.sent(docs.sparkSession, ranks_path)

    def work(texts: list[str]) -> dict[str, list]:
        own, out = None, []
        for text in texts:
            spans = base_spans(text)
            runs = candidate_runs(text, spans)
            if runs:
                own = own or bpe.codec(ranks.value, pattern)
                for (start, end), ids in zip(
                        runs, own.encode([text[a:b] for a, b in runs]), strict=True):
                    if end - start < MOST_CHARS_PER_TOKEN * len(ids):
                        spans.append((start, 3, end, "random"))
            out.append([dict(zip(("start", "rank", "end", "kind"), s, strict=True))
                        for s in sorted(spans)])
        return {"spans": out}

    return with_results(docs.drop("spans") if keep is None else docs, work, f"spans {SPANS}",
                        text_col, keep)


def without_spans(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; overlapping spans become one mark."""
    start = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda got, s: F.when(
            s["end"] <= got["at"], got).otherwise(F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < got["at"], got["out"]).otherwise(F.concat(
                    got["out"],
                    F.substring(text, (got["at"] + 1).cast("int"),
                                (s["start"] - got["at"]).cast("int")),
                    F.lit(mark))).alias("out"))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(
        start["out"], F.substring(text, (start["at"] + 1).cast("int"), F.length(text))))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per document with counts, the digest of the base spans, and all spans."""
    found = find_spans(docs.select("doc_id", "text"), ranks_path, pattern, keep=["doc_id"])
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    *fixed, added = [span_count(spans, k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *fixed, F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(spans).alias("spans"), added)
