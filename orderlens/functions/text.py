"""Text expressions: tokens, keywords, lines, sentences and markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists the text results depend on.
WORD = r"[\p{L}\p{N}_]{2,}"
KEYWORD = r"[a-z0-9_]+"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
SENTENCE_BREAK = r"(?<=[.!?])\s+"
MARKUP_EDGES = " -|#*`>"
KEYWORD_STOP_WORDS = (
    "a an the of to in on for and or is are was were be been being what which who how "
    "does do did with from this that these those by as at it its their our your you we "
    "about into can could would should will than then there here when where why"
).split()
REFUSAL_MARKERS = [
    "can only", "i can help", "outside", "out of scope", "out-of-scope",
    "unable to", "i can't help", "i cannot help", "not able to", "designed to",
    "only answer", "only help",
]
UNKNOWN_MARKERS = [
    "don't have", "do not have", "not have that", "no information", "not available",
    "don't know", "do not know", "cannot find", "can't find", "isn't in", "is not in",
]


def strip_space(text: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def split_lines(text: Column) -> Column:
    """The lines of a text."""
    return F.split(text, LINE_BREAK)


def keywords(text: Column) -> Column:
    """Distinct lower-case words of three letters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(KEYWORD), F.lit(0))
    stop = F.array(*[F.lit(w) for w in KEYWORD_STOP_WORDS])
    return F.array_except(F.filter(words, lambda w: F.length(w) > 2), stop)


def contains_any(text: Column, markers: list[str]) -> Column:
    """Whether the text holds any of the markers, whatever the case."""
    lowered = F.lower(text)
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(lowered, F.lit(marker.lower()))
    return found


def plain_sentence(chunk: Column) -> Column:
    """A chunk without markup: edges, bold marks, table bars, repeated blanks."""
    bare = strip_space(F.btrim(strip_space(chunk), F.lit(MARKUP_EDGES)))
    bare = F.replace(bare, F.lit("**"), F.lit(""))
    bare = F.replace(bare, F.lit(" | "), F.lit(" · "))
    bare = F.replace(bare, F.lit("|"), F.lit(" "))
    return strip_space(F.regexp_replace(bare, r"\s{2,}", " "))


def content_words(text: Column, stop_words: list[str]) -> Column:
    """Lower-case words of two letters or more, in order, without stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def with_pairs(words: Column) -> Column:
    """Words followed by the pairs of neighbouring words."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)
