"""The candidate models and their grids."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from gazette.functions.text import english_stop_words
from gazette.operators.terms import CHAR_WB, TermSettings

LOG_REG = "log_reg"
LINEAR_SVM = "linear_svm"
NAIVE_BAYES = "naive_bayes"
ENGLISH = "english"


@dataclass(frozen=True)
class Point:
    """One grid point: how texts become vectors, and the classifier's parameters."""

    settings: TermSettings
    c: float = 1.0
    balanced: bool = False
    alpha: float = 1.0

    def params(self) -> dict[str, object]:
        s = self.settings
        return {"analyzer": s.analyzer, "ngram_range": f"{s.low},{s.high}", "min_df": s.min_df,
                "max_df": s.max_df, "stop_words": ENGLISH if s.stop_words else None,
                "C": self.c, "class_weight": "balanced" if self.balanced else None,
                "alpha": self.alpha}


@dataclass(frozen=True)
class Candidate:
    """A named model: its classifier, its grid (one point: no search), and its features."""

    name: str
    kind: str
    grid: tuple[Point, ...]
    fields: tuple[str, ...] = ("description",)
    degree: int | None = None
    components: int = field(default=8192)


# Every grid below.
WORD_MIN_DF = (0.001, 0.005)
COUNT_C = (0.1, 1.0, 10.0)
TFIDF_LOG_REG_C = (0.1, 1.0, 10.0)
TFIDF_SVM_C = (0.1, 1.0, 3.0)
ALPHAS = (0.1, 1.0)
CHARS = TermSettings(analyzer=CHAR_WB, low=3, high=5, min_df=0.002, max_df=0.9)
SVM_FEATURES = 100_000
YEAR = "year"


def _tfidf_grid(cs: Sequence[float], max_features: int | None, stop_words: Sequence[str]
                ) -> tuple[Point, ...]:
    words = [
        Point(TermSettings(low=1, high=2, min_df=min_df, max_features=max_features,
                           stop_words=stops), c, balanced)
        for min_df, stops, c, balanced in product(
            WORD_MIN_DF, (None, tuple(stop_words)), cs, (False, True))]
    return (*words, Point(CHARS, 1.0, False), Point(CHARS, 1.0, True))


def _count_grid() -> tuple[Point, ...]:
    return tuple(
        Point(TermSettings(low=1, high=high, min_df=min_df, tfidf=False), c, balanced)
        for high, min_df, c, balanced in product((1, 2), WORD_MIN_DF, COUNT_C, (False, True)))


def candidates(stop_words: Sequence[str] | None = None) -> list[Candidate]:
    """All nine candidates; ``stop_words`` replaces the English list."""
    stops = list(stop_words) if stop_words is not None else english_stop_words()
    bayes = tuple(Point(TermSettings(low=1, high=high, min_df=min_df), alpha=alpha)
                  for high, min_df, alpha in product((1, 2), WORD_MIN_DF, ALPHAS))
    balanced = (Point(CHARS, 1.0, True),)
    return [
        Candidate("tfidf_log_reg", LOG_REG, _tfidf_grid(TFIDF_LOG_REG_C, None, stops)),
        Candidate("tfidf_log_reg_desc_headline_year", LOG_REG, balanced,
                  ("description", "headline", YEAR)),
        Candidate("tfidf_linear_svm", LINEAR_SVM, _tfidf_grid(TFIDF_SVM_C, SVM_FEATURES, stops)),
        Candidate("tfidf_naive_bayes", NAIVE_BAYES, bayes),
        *[Candidate(f"tfidf_log_reg_poly{d}", LOG_REG, balanced, degree=d) for d in (2, 4, 5)],
        Candidate("count_log_reg", LOG_REG, _count_grid()),
        Candidate("count_linear_svm", LINEAR_SVM, _count_grid()),
    ]


# The model whose errors are analysed, per target.
BEST = {
    "political": Candidate("tfidf_log_reg", LOG_REG, (Point(CHARS, 1.0, True),)),
    "domestic": Candidate("tfidf_linear_svm", LINEAR_SVM, (
        Point(TermSettings(low=1, high=2, min_df=0.001, max_features=SVM_FEATURES)),)),
}


def select(names: Sequence[str] | None = None, known: Sequence[Candidate] | None = None
           ) -> tuple[list[Candidate], list[str]]:
    """(candidates with these names, names without a candidate); none at all is an error."""
    known = candidates() if known is None else list(known)
    if not names:
        return known, []
    chosen = [c for c in known if c.name in set(names)]
    if not chosen:
        raise ValueError(f"none of {sorted(set(names))} is a candidate")
    return chosen, sorted(set(names) - {c.name for c in known})
