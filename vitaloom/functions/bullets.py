"""Bullet points."""

from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions.text import has_text

_SIGN = r"[^\S\n]*[•\-*◦▪][^\S\n]+"


def starts_with_bullet(line):
    return F.substring(line, 1, 1).isin(fixed.BULLET_SIGNS)


def split_bullets(text):
    """One string per bullet: its line and the later non-blank lines up to the next bullet."""
    pieces = F.filter(F.split(text, r"(?mdU)^(?=" + _SIGN + ")"), lambda p: p.rlike("(?U)^" + _SIGN))
    return F.transform(pieces, lambda p: F.array_join(F.filter(F.split(p, "\n"), has_text), " "))


def count_bullets(bullets):
    return F.size(bullets)


def quantified_bullets(bullets):
    """How many bullets carry a number that measures something."""
    pattern = "(?U)" + "|".join("(?:%s)" % p for p in fixed.QUANTIFIED)
    return F.size(F.filter(bullets, lambda b: F.lower(b).rlike(pattern)))
