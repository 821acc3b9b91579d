"""Name and contact details."""

from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions.text import bind, first_match, has_any, strip, word_count


def extract_name(text):
    """First short, digit-free line among the first five that is no contact line."""
    top = F.slice(F.split(text, "\n", 6), 1, 5)

    def looks_like_name(line):
        return ((line != "") & ~line.rlike(r"(?U)\d") & (word_count(line) <= 4)
                & ~bind(F.lower(line), lambda low: has_any(low, fixed.NOT_A_NAME)))

    return F.get(F.filter(F.transform(top, strip), looks_like_name), F.lit(0))


def extract_email(text):
    """The pattern runs only where its sign is."""
    return F.when(F.contains(text, F.lit("@")), first_match(text, fixed.EMAIL))


def extract_phone(text):
    """The pattern, which begins with optional parts, runs only where its end is."""
    return F.when(text.rlike("(?U)" + fixed.PHONE_END), first_match(text, fixed.PHONE))


def extract_location(text):
    return F.coalesce(*[first_match(text, p) for p in fixed.LOCATIONS])


def extract_linkedin(text):
    return F.coalesce(*[first_match(text, "(?i)" + p, 1) for p in fixed.LINKEDIN])


def extract_github(text):
    return F.coalesce(*[first_match(text, "(?i)" + p, 1) for p in fixed.GITHUB])
