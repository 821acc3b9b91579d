"""Small text helpers the other column functions are built from.

All patterns run with ``(?U)`` so that word edges, digits and blanks are the
Unicode ones on every Java version.
"""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value, body):
    """Evaluate ``value`` once per row and hand it to ``body`` as a column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(value, low, high):
    """``value`` inside the bounds; null stays null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)))


def string_array(words):
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def first_match(col, pattern, group=0):
    """First match of ``pattern``, or null."""
    return F.nullif(F.regexp_extract(col, "(?U)" + pattern, group), F.lit(""))


def all_matches(col, pattern, group=0):
    return F.regexp_extract_all(col, F.lit("(?U)" + pattern), F.lit(group))


def whole_number(col):
    """Digits to a number; digits too long for a number are null, not an error."""
    return col.try_cast("bigint")


def word_count(col):
    """Number of blank-separated words."""
    return F.regexp_count(col, F.lit(r"(?U)\S+"))


def strip(col):
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def has_text(col):
    """True when the text is there and not blank."""
    return F.coalesce(col.rlike(r"(?U)\S"), F.lit(False))


def has_any(col, words) -> Column:
    """True when any word occurs anywhere in ``col``. Words that hold another one tell nothing more and are not looked for."""
    least = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in least])


def count_present(col, words):
    """How many of the words occur at least once."""
    return reduce(lambda a, b: a + b, [F.contains(col, F.lit(w)).cast("int") for w in words])


def occurrences(col, word):
    """Non-overlapping occurrences of a fixed string."""
    return F.floor((F.length(col) - F.length(F.replace(col, F.lit(word), F.lit("")))) / F.lit(len(word)))


def first_word_position(col, words):
    """1-based position of the first word **in list order** that occurs, else null."""
    return F.coalesce(*[F.nullif(F.locate(w, col), F.lit(0)) for w in words])


def tokens(text_lc):
    """Maximal runs of word characters."""
    return F.split(text_lc, r"(?U)\W+")


def whole_words(text_lc, vocabulary, words=None):
    """The vocabulary entries that occur between word edges, in vocabulary order.

    ``words`` are the :func:`tokens` of the text, when they are at hand.

    Plain words are looked up in the token set (one pass over the text whatever
    the vocabulary size); entries with blanks or punctuation are searched, and
    the pattern runs only where the plain string occurs. An entry that begins
    with a word needs this word as a token, so the others are not searched.
    """
    vocabulary = list(dict.fromkeys(vocabulary))
    begins = {t: _leading_word(t) for t in vocabulary if not re.fullmatch(r"\w+", t)}
    found = tokens(text_lc) if words is None else words
    if not begins:
        return F.array_intersect(string_array(vocabulary), found)

    def hit(known, t):
        there = F.contains(text_lc, F.lit(t)) & text_lc.rlike(r"(?U)\b" + re.escape(t) + r"\b")
        return F.when(F.array_contains(known, begins[t]) & there if begins[t] else there, F.lit(t))

    looked_up = list(dict.fromkeys([*vocabulary, *filter(None, begins.values())]))
    return bind(F.array_intersect(string_array(looked_up), found), lambda known: F.array_intersect(
        string_array(vocabulary), F.concat(known, F.array_compact(F.array(*[hit(known, t) for t in begins])))))


def _leading_word(phrase):
    """The word that a phrase begins with, where it surely ends inside the phrase: then it is a token of each text that has the phrase
    between word edges."""
    word = re.match(r"[A-Za-z0-9_]+(?=[ -~])", phrase)
    return word.group() if word and not re.match(r"\w", phrase[word.end():]) else None


def substrings_present(text_lc, vocabulary):
    """The vocabulary entries that occur anywhere, in vocabulary order."""
    return F.array_compact(F.array(*[F.when(F.contains(text_lc, F.lit(t)), F.lit(t)) for t in vocabulary]))


def ladder(value, steps, otherwise=0.0):
    """Points of the first ``(at_least, points)`` step that ``value`` reaches."""
    col = None
    for at_least, points in steps:
        col = F.when(value >= at_least, points) if col is None else col.when(value >= at_least, points)
    return col.otherwise(otherwise)


def bands(value, rows, otherwise=0.0):
    """Points of the first ``(low, high, points)`` band that contains ``value``; no high means open."""
    col = None
    for low, high, points in rows:
        inside = (value >= low) if high is None else value.between(low, high)
        col = F.when(inside, points) if col is None else col.when(inside, points)
    return col.otherwise(otherwise)


def by_level(level, choices):
    """Pick the column of a level; senior is what remains."""
    return F.when(level == "entry", choices["entry"]).when(level == "mid", choices["mid"]).otherwise(choices["senior"])
