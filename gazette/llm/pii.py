"""Personal data in texts: four fixed patterns, and a classifier taught by weak labelers.

1. Base spans are found by the fixed patterns of e-mail addresses, IP addresses, card numbers and
   telephone numbers.
2. Looser patterns propose further candidates: obfuscated addresses, numbers grouped like
   telephone numbers, card numbers and national ids, names after a title.
3. Three labelers vote on every span, base or candidate: *regex* (the strict form of its kind),
   *gazetteer* (known top-level domains, card issuers, calling codes, given names, reserved
   networks) and *context* (cue words before the span). A vote is yes, no or none.
4. Votes are counted per kind and combination over all documents. Expectation-maximisation on
   these counts gives each labeler's reliability and each combination's probability.
5. A logistic regression on features of the span is fitted to those probabilities, weighted by the
   counts. Candidates it accepts, and which overlap no base span, are added.

What reaches the driver is one row per combination of kind, votes and classes of features, at most
``PATTERNS`` rows at any input size. NULL and empty texts have no spans; an empty table teaches
nothing and accepts nothing. Rows are judged one by one, so repeated rows repeat their result.
Spans are code points, end exclusive. All patterns are linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import SPANS, Covered, sorted_spans, span_count, span_text, with_results
from gazette.sources.scratch import written

KINDS = ("email", "ip", "card", "phone")
# The kinds that only candidates have, ranked behind the base kinds.
MORE_KINDS = ("mail_words", "phone_local", "card_loose", "national_id", "name")
ALL_KINDS = KINDS + MORE_KINDS
RANK = {kind: i for i, kind in enumerate(ALL_KINDS)}
LABELERS = ("regex", "gazetteer", "context")
LENGTHS, BEFORE = 3, 3
PATTERNS = len(ALL_KINDS) * 3 ** len(LABELERS) * LENGTHS * BEFORE
ACCEPT = 0.5
# (none, no, yes) of a labeler where there is no personal data, and where there is.
PSEUDO_VOTES = np.array([[0.0, 2.0, 1.0], [0.0, 1.0, 2.0]])

# The characters and patterns of the base kinds.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser forms of the candidates.
LOOSE = {
    "mail_words": re.compile(
        r"\b[A-Za-z0-9][A-Za-z0-9._-]{0,63}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}"
        r"(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,24}|\.[A-Za-z]{2,24})"),
    "phone_local": re.compile(
        r"(?<![\w+.-])\(?0?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
    "card_loose": re.compile(r"(?<![\w.-])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![\w-])"),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "name": re.compile(
        r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?"),
}
# Gazetteers (fixed values).
TOP_LEVEL = set("com org net edu gov io de fr es uk eu info int".split())
GIVEN = set("anna ana carlos claire david emma hans jean john julia juan karl laura luis maria marie "
            "martin michael paul peter pierre robert sarah sofia thomas".split())
CALLING = ("1", "33", "34", "44", "49")
ISSUERS = ("4", "34", "37", "51", "52", "53", "54", "55", "6011", "65")
CUES = {
    "email": "mail email e-mail contact write correo courriel adresse".split(),
    "ip": "ip host server address adresse client login".split(),
    "card": "card visa mastercard credit tarjeta carte karte payment".split(),
    "phone": "tel phone call mobile fax cell contact teléfono téléphone telefon ruf".split(),
    "national_id": "ssn social security id".split(),
    "name": "name by from dear signed".split(),
}
AGAINST = set("version isbn issn order item invoice page figure section no. nr".split())
GROUP = {"mail_words": "email", "phone_local": "phone", "card_loose": "card"}


def _emails(text: str) -> list[tuple[int, int]]:
    """For every @ the run of local characters before it and the domain behind it."""
    out, last, floor = [], 0, 0
    at = text.find("@")
    while at >= 0:
        if at > last:
            head = text[max(last, floor):at]
            local = len(head) - len(head.rstrip(LOCAL))
            domain = DOMAIN.match(text, at + 1) if local else None
            if domain:
                out.append((at - local, domain.end()))
                last = domain.end()
        floor = at + 1
        at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(run: str) -> str:
    return "".join(c for c in run if "0" <= c <= "9")


def _part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _card_fits(run: str) -> bool:
    digits = _digits(run)
    return 14 <= len(digits) <= 19 and _luhn(digits)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``start, rank, end, kind`` of the base kinds, leftmost and non-overlapping per kind."""
    found = [(a, RANK["email"], b, "email") for a, b in _emails(text)]
    found += [(m.start(), RANK["ip"], m.end(), "ip") for m in IP.finditer(text)
              if all(map(_part_fits, m[0].split(".")))]
    found += [(m.start(), RANK["card"], m.end(), "card") for m in CARD.finditer(text)
              if m.end() - m.start() >= 14 and _card_fits(m[0])]
    if "+" in text:
        found += [(m.start(), RANK["phone"], m.end(), "phone") for m in PHONE.finditer(text)
                  if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


def candidates(text: str, base: Sequence[tuple[int, int, int, str]]
               ) -> list[tuple[int, int, int, str]]:
    """Spans of the looser patterns that overlap no base span."""
    covered, found = Covered(base), []
    for kind, pattern in LOOSE.items():
        for m in pattern.finditer(text):
            if not covered.overlaps(m.start(), m.end()):
                found.append((m.start(), RANK[kind], m.end(), kind))
    return sorted(found)


def votes(text: str, start: int, end: int, kind: str) -> tuple[int, ...]:
    """Yes (2), no (1) or none (0) of each labeler."""
    run = text[start:end]
    group = GROUP.get(kind, kind)
    digits = _digits(run)
    strict = {
        "email": kind == "email",
        "ip": len(run) >= 7,
        "card": _card_fits(run),
        "phone": 10 <= len(digits) <= 15,
        "national_id": not digits.startswith(("000", "666", "9")),
        "name": run.count(" ") >= 2,
    }[group]
    if group == "email":
        known = 2 if re.split(r"[^A-Za-z]+", run.rstrip(")]"))[-1].lower() in TOP_LEVEL else 1
    elif group == "card":
        known = 2 if digits.startswith(ISSUERS) else 1
    elif group == "phone":
        known = (2 if digits.startswith(CALLING) else 1) if run[0] == "+" else 0
    elif group == "ip":
        known = 1 if digits and run.split(".")[0].lstrip("0") in ("", "127", "255") else 2
    elif group == "name":
        known = 2 if run.split()[1].lower() in GIVEN else 0
    else:
        known = 0
    before = re.findall(r"[\w.-]+", text[max(0, start - 40):start].lower())[-4:]
    cues = CUES.get(group, ())
    context = 2 if any(w.rstrip(".:") in cues for w in before) else (
        1 if any(w in AGAINST for w in before) else 0)
    return (2 if strict else 1, known, context)


def pattern_of(text: str, start: int, end: int, kind: str) -> int:
    """The combination of kind, votes, length class and character before, as one number."""
    code = RANK[kind]
    for vote in votes(text, start, end, kind):
        code = code * 3 + vote
    size = end - start
    code = code * LENGTHS + (0 if size < 12 else 1 if size < 18 else 2)
    before = text[start - 1] if start else " "
    return code * BEFORE + (0 if before.isspace() else 1 if before.isalnum() else 2)


def features(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes and one-hot features of pattern numbers."""
    rest, before = np.divmod(pattern, BEFORE)
    rest, size = np.divmod(rest, LENGTHS)
    each = []
    for _ in LABELERS:
        rest, vote = np.divmod(rest, 3)
        each.append(vote)
    marks = np.stack(each[::-1], 1)
    x = np.concatenate([np.eye(len(ALL_KINDS))[rest], *[np.eye(3)[v] for v in marks.T],
                        np.eye(LENGTHS)[size], np.eye(BEFORE)[before]], 1)
    return rest, marks, x


def reliabilities(kinds: np.ndarray, marks: np.ndarray, counts: np.ndarray, rounds: int = 200
                  ) -> tuple[np.ndarray, np.ndarray]:
    """EM for two hidden classes: ``P(vote | class)`` per labeler, and P(personal) per row.

    The labelers are shared by all kinds, the share of personal data is each kind's own. A labeler
    that casts no vote says nothing. Rows start from the share of yes among their votes; a labeler
    starts as right more often than not, by pseudo-votes that also keep tables off zero.
    """
    yes, cast = (marks == 2).sum(1), (marks > 0).sum(1)
    p = (yes + 0.5) / (cast + 1.0)
    table = np.zeros((marks.shape[1], 2, 3))
    for _ in range(rounds):
        prior = np.ones((len(ALL_KINDS), 2))
        for c, share in enumerate((1 - p, p)):
            np.add.at(prior[:, c], kinds, counts * share)
            for k in range(marks.shape[1]):
                seen = np.bincount(marks[:, k], counts * share, 3) + PSEUDO_VOTES[c]
                table[k, c, 1:] = seen[1:] / seen[1:].sum()
        log = np.log(prior / prior.sum(1, keepdims=True))[kinds]
        for k in range(marks.shape[1]):
            cast_here = marks[:, k] > 0
            log[cast_here] += np.log(table[k][:, marks[cast_here, k]]).T
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        done = np.abs(new - p).max(initial=0) < 1e-9
        p = new
        if done:
            break
    return table, p


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0,
                 rounds: int = 50) -> np.ndarray:
    """Newton steps on the weighted cross entropy with soft targets."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def find_spans(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None
               ) -> DataFrame:
    """``keep`` columns (all by default), ``base`` and ``added`` spans of each row."""

    def work(texts: list[str]) -> dict[str, list]:
        base_out, more_out = [], []
        for text in texts:
            base = base_spans(text)
            more = candidates(text, base)
            for out, spans in ((base_out, base), (more_out, more)):
                out.append([{"start": a, "rank": r, "end": b, "kind": k,
                             "pattern": pattern_of(text, a, b, k)} for a, r, b, k in spans])
        return {"base": base_out, "candidates": more_out}

    spans = SPANS.replace("kind:string", "kind:string,pattern:int")
    found = written(with_results(docs, work, f"base {spans}, candidates {spans}", text_col, keep),
                    "pii")
    seen = found.select(F.explode(F.concat("base", "candidates")).alias("s")).groupBy(
        F.col("s.pattern").alias("pattern")).count().orderBy("pattern").collect()
    accepted: list[int] = []
    if seen:
        pattern = np.array([r["pattern"] for r in seen])
        counts = np.array([r["count"] for r in seen], float)
        kinds, marks, x = features(pattern)
        _, p = reliabilities(kinds, marks, counts)
        w = fit_logistic(x, p, counts)
        accepted = pattern[1 / (1 + np.exp(-x @ w)) >= ACCEPT].tolist()

    def plain(span):
        return F.struct(*[span[c].alias(c) for c in ("start", "rank", "end", "kind")])

    taken = F.lit(accepted).cast("array<int>")
    return found.select(
        *[c for c in found.columns if c not in ("base", "candidates")],
        F.transform("base", plain).alias("base"),
        F.transform(F.filter("candidates", lambda s: F.array_contains(taken, s["pattern"])),
                    plain).alias("added"))


def digests(docs: DataFrame) -> DataFrame:
    """One row per document with counts, the digest of the base spans, and all spans."""
    found = find_spans(docs.select("doc_id", "text"), keep=["doc_id"])
    base = F.col("base")
    return found.select(
        "doc_id", *[span_count(base, k).alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(sorted_spans("base", "added")).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"))
