"""Text expressions: whitespace tokens, word tokens, n-grams, display texts.

Everything here is a built-in Spark expression, so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from importlib.resources import files

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. The space characters that Python's str.split() cuts at; Java's own \s knows the
# ASCII ones only. Characters below 256 listed one by one become a bitmap, and the others are
# looked at only above U+1680: three times as fast as one list of ranges.
LOW_SPACES = r"\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0"
HIGH_SPACES = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = rf"{LOW_SPACES}[\x{{1680}}-\x{{3000}}&&[{HIGH_SPACES}]]"
SPACE_RUN = f"[{SPACES}]+"
SPACE_FREE_RUN = f"[^{SPACES}]+"
# A word token: two or more letters, digits or underscores.
WORD = r"[\p{L}\p{N}_]{2,}"
SHORT_TEXT_LENGTH = 180
ELLIPSIS = "..."


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.regexp_count(text, F.lit(SPACE_FREE_RUN))


def is_blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(SPACE_FREE_RUN))


def collapse_spaces(text: Column) -> Column:
    """Runs of spaces become one blank, none at either end."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def short_text(text: Column, limit: int = SHORT_TEXT_LENGTH) -> Column:
    """Collapsed text, cut to ``limit`` characters with a closing ellipsis. NULL stays NULL."""
    flat = collapse_spaces(text)
    cut = F.concat(F.substring(flat, 1, limit - len(ELLIPSIS)), F.lit(ELLIPSIS))
    return F.when(F.length(flat) > limit, cut).otherwise(flat)


def word_tokens(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Lower-cased word tokens in order; stop words leave before n-grams are formed."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    if stop_words:
        listed = list(stop_words)
        tokens = F.filter(tokens, lambda token: ~token.isin(listed))
    return tokens


def word_ngrams(tokens: Column, low: int = 1, high: int = 1) -> Column:
    """All n-grams of ``low``..``high`` neighbouring tokens, joined by one blank."""
    grams: Column | None = None
    level = tokens
    for size in range(1, high + 1):
        if size > 1:
            # n-grams from the (n-1)-grams: glue on the token that follows each of them.
            room = F.greatest(F.size(level) - 1, F.lit(0))
            level = F.zip_with(
                F.slice(level, F.lit(1), room),
                F.slice(tokens, F.lit(size), room),
                lambda left, right: F.concat(left, F.lit(" "), right),
            )
        if size >= low:
            grams = level if grams is None else F.concat(grams, level)
    if grams is None:
        raise ValueError("n-gram range is empty")
    return grams


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """All character n-grams inside space-padded, lower-cased words, word by word.

    A padded word shorter than ``low`` is itself the only gram.
    """
    def of_size(padded: Column, size: int) -> Column:
        length = F.length(padded)
        spots = F.sequence(F.lit(1), F.greatest(length - size + 1, F.lit(1)))
        cut = F.transform(spots, lambda spot: F.substring(padded, spot, F.lit(size)))
        return cut if size == low else F.when(length >= size, cut).otherwise(
            F.array().cast("array<string>"))

    words = F.filter(F.split(F.lower(text), SPACE_RUN), lambda word: word != "")
    padded = F.transform(words, lambda word: F.concat(F.lit(" "), word, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda word: F.concat(
        *[of_size(word, size) for size in range(low, high + 1)])))


def truncate_tokens(text: Column, limit: int) -> Column:
    """The first ``limit`` whitespace tokens, which is what a length-limited encoder sees."""
    tokens = F.filter(F.split(text, SPACE_RUN), lambda token: token != "")
    return F.array_join(F.slice(tokens, 1, limit), " ")


def name_list(names: str) -> list[str]:
    """``"a, b,,c"`` -> ``["a", "b", "c"]`` for parameters given as one string."""
    return [name for name in (part.strip() for part in names.split(",")) if name]


def split_names(names: Column) -> Column:
    """The same as ``name_list`` for a column."""
    parts = F.transform(F.split(names, ","), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def safe_name(name: Column) -> Column:
    """A name that can stand in a path."""
    return F.replace(name, F.lit("/"), F.lit("_"))


def fill_template(template: str, slot: str, value: Column) -> Column:
    """Template text with ``slot`` replaced by a column."""
    return F.replace(F.lit(template), F.lit(slot), value)


def english_stop_words() -> list[str]:
    """The English list of Spark ML's StopWordsRemover, kept beside this file. Workers read it out
    of the archive that ``ship_package`` sends."""
    return files(__package__).joinpath("english_stop_words.txt").read_text("utf-8").split()
