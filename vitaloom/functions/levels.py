"""Seniority of candidates and of jobs."""

from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions.text import all_matches, bind, first_match, has_any, whole_number


def max_stated_years(text_lc):
    """Largest N in "N years (of) experience", 0 when none is stated."""
    matches = F.when(F.contains(text_lc, F.lit("year")), all_matches(text_lc, fixed.STATED_YEARS, 1))
    return F.coalesce(F.array_max(F.transform(matches, whole_number)), F.lit(0).cast("bigint"))


def sum_date_ranges(text_lc, as_of_year=fixed.CURRENT_YEAR, cap=20):
    """Years covered by the year ranges of the text, at most ``cap``."""
    def span(start, end):
        until = F.coalesce(whole_number(end), F.lit(as_of_year).cast("bigint"))
        return F.greatest(F.lit(0).cast("bigint"), until - whole_number(start))

    spans = F.zip_with(all_matches(text_lc, fixed.YEAR_RANGE, 1), all_matches(text_lc, fixed.YEAR_RANGE, 2), span)
    total = F.least(F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(cap).cast("bigint"))
    # every range begins with these digits, and most texts have none
    return F.when(~F.contains(text_lc, F.lit("20")), F.least(F.lit(0), F.lit(cap)).cast("bigint")).otherwise(total)


def detect_level(text_lc, total_bullets, as_of_year=fixed.CURRENT_YEAR):
    """Struct of candidate level and years."""
    student = has_any(text_lc, fixed.STUDENT_PHRASES)
    senior, mid = has_any(text_lc, fixed.SENIOR_WORDS), has_any(text_lc, fixed.MID_WORDS)
    entry = has_any(text_lc, fixed.ENTRY_WORDS)
    top = has_any(text_lc, ["principal", "staff"])
    years = bind(max_stated_years(text_lc),
                 lambda n: F.when(n > 0, n).otherwise(sum_date_ranges(text_lc, as_of_year)))

    def result(level, n):
        return F.struct(F.lit(level).alias("level"), n.cast("bigint").alias("years"))

    def rungs(n):
        return (F.when(student, result("student", F.lit(0)))
                .when((n < 2) | entry, result("entry", n))
                .when((senior | (n >= 7)) & ((n >= 10) | top), result("principal", n))
                .when(senior | (n >= 7), result("senior", n))
                .when(mid | (n >= 3), result("mid", F.greatest(n, F.lit(3))))
                .when(total_bullets >= 25, result("senior", F.greatest(n, F.lit(7))))
                .when(total_bullets >= 15, result("mid", F.greatest(n, F.lit(3))))
                .otherwise(result("entry", n)))

    return bind(years, rungs)


def resolve_level(detected, target=None):
    """The level to score against: the target if given, else the detected one; others score as entry."""
    wanted = detected if target is None else F.coalesce(F.nullif(target, F.lit("")), detected)
    return F.when(wanted.isin(fixed.SCORED_LEVELS), wanted).otherwise("entry")


def _range_mean(text):
    low = whole_number(first_match(text, fixed.JOB_YEARS_RANGE, 1))
    high = whole_number(first_match(text, fixed.JOB_YEARS_RANGE, 2))
    return F.floor((low + high) / 2)


def _job_rungs(title, body, both):
    intern = has_any(both, fixed.JOB_INTERN) & (~F.contains(both, F.lit("graduate student"))
                                                | F.contains(both, F.lit("intern")))
    principal = has_any(title, fixed.JOB_PRINCIPAL_TITLES + fixed.JOB_MANAGER_TITLES)
    first_numeral = F.contains(both, F.lit(fixed.JOB_ENTRY_NUMERAL)) & ~has_any(both, fixed.JOB_HIGHER_NUMERALS)
    entry = (has_any(both, fixed.JOB_ENTRY) | first_numeral
             | (has_any(title, fixed.JOB_ENTRY_TITLES) & ~has_any(title, fixed.JOB_ENTRY_TITLE_EXCEPT))
             | has_any(body, fixed.JOB_TEACHING))
    open_years = whole_number(first_match(both, fixed.JOB_YEARS_OPEN, 1))
    seasoned = F.coalesce(F.coalesce(_range_mean(both), open_years) >= 7, F.lit(False))
    years = F.coalesce(whole_number(first_match(both, fixed.JOB_YEARS_PLUS, 1)), _range_mean(both),
                       whole_number(first_match(both, fixed.JOB_YEARS, 1)))
    by_years = bind(years, lambda n: F.when(n >= 10, "principal").when(n >= 5, "senior").when(n >= 2, "mid")
                    .when(n.isNotNull(), "entry"))
    by_duty = None
    for name, hints in fixed.JOB_DUTIES.items():
        hit = has_any(body, hints)
        by_duty = F.when(hit, name) if by_duty is None else by_duty.when(hit, name)
    untrained = (has_any(title, fixed.JOB_ROLE_TITLES) & ~has_any(body, fixed.JOB_ROLE_MID_HINTS)
                 & has_any(body, fixed.JOB_ROLE_ENTRY_HINTS))
    without_words = F.coalesce(by_years, by_duty, F.when(untrained, "entry"), F.lit("mid"))
    return (F.when(intern, "intern").when(principal, "principal").when(entry, "entry")
            .when(has_any(both, fixed.JOB_SENIOR), F.when(seasoned, "principal").otherwise("senior"))
            .when(has_any(both, fixed.JOB_MID), "mid").otherwise(without_words))


def detect_job_seniority(title, description):
    """intern, entry, mid, senior or principal; the first rung that applies."""
    title, body = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, description))
    texts = F.struct(title.alias("title"), body.alias("body"), F.concat(title, F.lit(" "), body).alias("both"))
    return bind(texts, lambda t: _job_rungs(t["title"], t["body"], t["both"]))
