"""Layout, dates, grammar, tone and other checks of one document."""

from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions.text import bind, count_present, has_any, ladder, occurrences, strip, word_count


def detect_file_type():
    """Text reaches the engine as text, so the type is always the same."""
    return F.struct(F.lit("text_based").alias("file_type"), F.lit(0).alias("penalty"))


def analyze_layout(text):
    """Struct of layout type and points."""
    line_breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    mean_line = (F.length(text) - line_breaks) / (line_breaks + F.lit(1))
    crowded = (occurrences(text, "|") > 50) | (occurrences(text, "\t") > 30)
    kind = F.when(crowded, "complex").when(mean_line > 100, "multi_column").otherwise("single_column")
    points = F.when(crowded, 2.0).when(mean_line > 100, 4.0).otherwise(6.0)
    return F.struct(kind.alias("layout"), points.alias("score"))


def date_format(value):
    col = None
    for name, pattern in fixed.DATE_FORMATS.items():
        hit = value.rlike("(?U)" + pattern)
        col = F.when(hit, name) if col is None else col.when(hit, name)
    return col


def date_consistency(experience, education):
    """Struct of points for uniform dates and the penalty for missing ones."""
    def judge(jobs, degrees):
        formats = F.array_distinct(F.array_compact(F.concat(
            F.transform(jobs, date_format),
            F.transform(degrees, lambda y: F.when(y.rlike(r"(?U)\d{4}"), "year_only")))))
        total = F.size(jobs) + F.size(degrees)
        missing = F.size(F.filter(F.concat(jobs, degrees), lambda d: F.coalesce(strip(d), F.lit("")) == ""))
        points = bind(F.size(formats), lambda kinds: F.when(total == 0, 2.0).when(kinds == 0, 1.0).when(kinds == 1, 4.0)
                      .when(kinds == 2, 3.0).otherwise(2.0))
        penalty = F.when(missing > F.floor(total / 2), fixed.PENALTY_DATES).otherwise(0.0)
        return F.struct(points.alias("score"), penalty.alias("penalty"))

    durations = F.transform(experience, lambda e: e["duration"])
    years = F.transform(education, lambda e: e["graduation_year"])
    return bind(durations, lambda d: bind(years, lambda y: judge(d, y)))


def grammar_score(text, text_lc):
    gaps = occurrences(text, "  ")

    def starts_small(line):
        small = (F.length(line) > 20) & line.rlike(r"(?U)^\s*\p{Lower}")
        return small & bind(strip(line), lambda s: (F.length(s) > 20) & ~s.startswith("i.e") & ~s.startswith("e.g"))

    small = F.size(F.filter(F.split(text, "\n"), starts_small))
    errors = (F.when(gaps > 10, 2).when(gaps > 5, 1).otherwise(0)
              + count_present(text_lc, fixed.TYPOS) * 2 + small * F.lit(0.5))
    return bind(errors, lambda e: F.when(e == 0, 5.0).when(e <= 1, 4.0).when(e <= 2, 3.0).when(e <= 4, 2.0)
                .when(e <= 6, 1.0).otherwise(0.0))


def tone_score(text, text_lc, words=None):
    """Points for short sentences and little passive voice; ``words`` is the word count, when at hand."""
    # one letter for each word, no blanks: what is left between the ends of sentences is as long as they have words
    letters = F.regexp_replace(F.regexp_replace(text, r"(?U)[^\s.!?]+", "w"), r"(?U)\s+", "")
    lengths = F.filter(F.transform(F.split(letters, "[.!?]+"), F.length), lambda n: n > 3)
    # each word ends in a blank, so hits of different words cannot overlap
    passive = F.regexp_count(text_lc, F.lit("|".join(fixed.PASSIVE_WORDS)))
    ratio = passive / F.greatest(word_count(text) if words is None else words, F.lit(1))

    def points(ns):
        mean = F.aggregate(ns, F.lit(0), lambda a, n: a + n) / F.nullif(F.size(ns), F.lit(0))
        long = F.when(mean > 35, 1.5).when(mean > 30, 1.0).when(mean > 25, 0.5).otherwise(0.0)
        return F.when(F.size(ns) == 0, 1.5).otherwise(F.greatest(F.lit(0.0), 3.0 - long - F.when(ratio > 0.10, 1.0)
                                                                  .when(ratio > 0.06, 0.5).otherwise(0.0)))

    return bind(lengths, points)


def detect_tailoring(text_lc):
    return has_any(text_lc, fixed.TARGETING_PHRASES)


def detect_leadership(text_lc):
    return count_present(text_lc, fixed.LEADERSHIP_WORDS) >= 2


def detect_oss(text_lc):
    return has_any(text_lc, fixed.OPEN_SOURCE_WORDS)


def summary_score(text, text_lc):
    """Points for the words in the 300 characters from the earliest summary word."""
    start = F.least(*[F.nullif(F.locate(w, text_lc), F.lit(0)) for w in fixed.SUMMARY_WORDS])
    words = word_count(F.substring(text, start, F.lit(300)))
    return (F.when(start.isNotNull(), ladder(words, fixed.HYBRID["summary"], 0.5))
            .when(F.contains(text_lc, F.lit("about me")), 0.5).otherwise(0.0))


def certifications_score(text_lc):
    n = count_present(text_lc, fixed.CERTIFICATES)
    section = has_any(text_lc, fixed.SECTION_WORDS["certifications"])
    return (F.when((n >= 3) | ((n >= 2) & section), 4.0).when(n >= 2, 3.0).when(n >= 1, 1.5).otherwise(0.0))
