"""Scores and reasons of resume x job pairs; every input is a narrow per-side column."""

from pyspark.sql import functions as F

from vitaloom import fixed_messages as say
from vitaloom import fixed_values as fixed
from vitaloom.functions.advice import filled, first_of
from vitaloom.functions.text import clamp, ladder, string_array, word_count
from vitaloom.functions.vocabulary import cap_matched_skills, contained_skills, matched_terms, topk_terms

SCORE_SCALE = 1e9


def job_text(title, description):
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))


def is_snippet(text):
    return word_count(text) < fixed.SNIPPET_WORDS


def _curve(sim, steps, tail):
    col = None
    for at_least, base, slope in steps:
        points = base + (sim - at_least) * slope
        col = F.when(sim >= at_least, points) if col is None else col.when(sim >= at_least, points)
    return col.otherwise(sim * tail)


def semantic_score(similarity, snippet):
    return (F.when(snippet, _curve(similarity, fixed.SNIPPET_CURVE, fixed.SNIPPET_TAIL))
            .otherwise(_curve(similarity, fixed.FULL_CURVE, fixed.FULL_TAIL)))


def ats_contribution(ats_score, snippet):
    most = F.when(snippet, fixed.SNIPPET_QUALITY_POINTS).otherwise(fixed.FULL_QUALITY_POINTS)
    return F.coalesce(ats_score, F.lit(0.0)) / F.lit(100.0) * most


def seniority_penalty(candidate_level, job_level):
    """Points lost for a job above the candidate's level; unknown candidate levels lose none."""
    col = None
    for candidate, row in fixed.SENIORITY_PENALTY.items():
        for job, points in row.items():
            hit = (candidate_level == candidate) & (job_level == job)
            col = F.when(hit, points) if col is None else col.when(hit, points)
    return col.otherwise(0.0)


def match_level(score):
    return first_of(*[(score >= at, name) for at, name in fixed.MATCH_LEVELS[:-1]]).otherwise(fixed.MATCH_LEVELS[-1][1])


def match_score(similarity, snippet, ats_score, candidate_level, job_level):
    """Struct with the score and its parts. The score has 9 decimals: what is half a tenth must not depend on
    the last bit of a sum, neither for the rounded score nor for the levels."""
    semantic, quality = semantic_score(similarity, snippet), ats_contribution(ats_score, snippet)
    penalty = seniority_penalty(candidate_level, job_level)
    score = clamp(semantic + quality - penalty, 0, 100)
    score = F.rint(score * F.lit(SCORE_SCALE)) / F.lit(SCORE_SCALE)
    return F.struct(score.alias("score"), semantic.alias("semantic"), quality.alias("quality"), penalty.alias("penalty"))


def keyword_overlap(resume_words, job_words):
    """Share of the job's long words that the resume has too."""
    return F.coalesce(F.size(F.array_intersect(resume_words, job_words)) / F.nullif(F.size(job_words), F.lit(0)),
                      F.lit(0.0))


def match_keyword(resume_words, job_words, ats_score):
    """Struct of the keyword match, for use without an encoder."""
    common = F.size(F.array_intersect(resume_words, job_words))
    overlap = keyword_overlap(resume_words, job_words)
    quality = F.coalesce(ats_score, F.lit(0.0)) / F.lit(100.0) * F.lit(40.0)
    score = clamp(overlap * F.lit(60.0) + quality, 0, 100)
    return F.struct(F.round(score, 1).alias("match_score"), F.round(overlap * 100, 1).alias("keyword_overlap"),
                    F.round(quality, 1).alias("ats_contribution"), match_level(score).alias("match_level"),
                    F.array(filled(say.KEYWORD_REASON, common)).alias("reasons"))


def match_reasons(similarity, ats_score, score, penalty, candidate_level, job_level, resume_terms, job_terms):
    """Why the pair scored as it did, in order."""
    gap = first_of(*[(penalty >= at, filled(text, *[job_level, candidate_level][:text.count("%s")]))
                     for at, text in say.GAP_REASONS])
    strained = first_of(*[(score >= at, text) for at, text in say.GAP_QUALITY[:-1]]).otherwise(say.GAP_QUALITY[-1][1])
    plain = first_of(*[(score >= at, text) for at, text in say.QUALITY[:-1]]).otherwise(say.QUALITY[-1][1])
    shared = topk_terms(matched_terms(resume_terms, job_terms))
    return F.array_compact(F.array(
        gap, F.when(penalty >= say.GAP_QUALITY_FROM, strained).otherwise(plain),
        first_of(*[(similarity >= at, text) for at, text in say.SIMILARITY_REASONS]),
        first_of(*[(ats_score >= at, text) for at, text in say.RESUME_QUALITY_REASONS]),
        F.when(F.size(shared) > 0, F.concat(F.lit(say.SKILL_REASON), F.array_join(shared, ", ")))))


def job_age_days(posted, as_of):
    """Days since posting, with fraction; null when the date is missing."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(posted.cast("timestamp"))) / F.lit(86400e6)


def freshness_points(age_days):
    return first_of(*[(age_days <= at, F.lit(points)) for at, points in fixed.FRESHNESS]).otherwise(fixed.FRESHNESS_REST)


def _share(n_found, n, points):
    return F.coalesce(n_found / F.nullif(n, F.lit(0)) * F.lit(points), F.lit(0.0))


def is_paid(salary):
    """Whether the job names a salary."""
    return (F.coalesce(salary, F.lit("")) != "") & (salary != fixed.NO_SALARY)


def rule_total(technical_found, technical, soft_found, soft, ats_score, fresh, paid):
    """The parts of the rule score together (unrounded)."""
    return rule_total_counted(F.size(technical_found), F.size(technical), F.size(soft_found), F.size(soft), ats_score, fresh, paid)


def rule_total_counted(n_technical_found, n_technical, n_soft_found, n_soft, ats_score, fresh, paid):
    """The same from the numbers of skills."""
    score = (_share(n_technical_found, n_technical, 40.0) + _share(n_soft_found, n_soft, 15.0)
             + F.coalesce(ats_score, F.lit(0.0)) / F.lit(100.0) * F.lit(20.0) + fresh + paid)
    return clamp(score, 0, 100)


def match_rules(job_text_lc, salary, age_days, technical, soft, ats_score):
    """Rule-based score from skills, quality, age and salary (unrounded)."""
    return rule_total(contained_skills(technical, job_text_lc), technical, contained_skills(soft, job_text_lc), soft, ats_score,
                      freshness_points(age_days), F.when(is_paid(salary), 10.0).otherwise(0.0))


def match_rules_counted(salary, age_days, n_technical_found, n_technical, n_soft_found, n_soft, ats_score):
    """The same from the numbers of skills."""
    return rule_total_counted(n_technical_found, n_technical, n_soft_found, n_soft, ats_score, freshness_points(age_days),
                              F.when(is_paid(salary), 10.0).otherwise(0.0))


def rule_reasons(score, job_text_lc, age_days, technical):
    return rule_reasons_named(score, cap_matched_skills(technical, job_text_lc), age_days)


def rule_reasons_named(score, named, age_days):
    """Reasons of a rule score, with the skills to be named."""
    return F.array_compact(F.array(
        first_of(*[(score >= at, text) for at, text in say.RULE_REASONS]),
        F.when(F.size(named) > 0, F.concat(F.lit(say.RULE_SKILL_REASON), F.array_join(named, ", "))),
        first_of((F.floor(age_days) <= fixed.FRESH_DAYS, say.RULE_FRESH_REASON))))


def validate_resume(skills, sections, email, phone, experience, education, words):
    """Struct of the five format checks: how many pass, which fail, verdict and reason."""
    def filled_in(col):
        return F.coalesce(col, F.lit("")) != ""

    def length(col):
        return F.coalesce(F.size(col), F.lit(0))

    passed = [length(skills) >= 3, length(sections) >= 2, filled_in(email) | filled_in(phone),
              (length(experience) > 0) | (length(education) > 0), F.coalesce(words, F.lit(0)).between(200, 2000)]
    n = sum([c.cast("int") for c in passed[1:]], passed[0].cast("int"))
    failed = F.array_compact(F.array(*[F.when(~c, F.lit(name)) for c, name in zip(passed, fixed.FORMAT_CHECKS)]))
    valid = n >= fixed.FORMAT_CHECKS_NEEDED
    reason = F.when(valid, fixed.FORMAT_OK).otherwise(filled(fixed.FORMAT_BAD, F.lit(len(passed)) - n))
    return F.struct(n.alias("passed"), F.when(valid, string_array([])).otherwise(failed).alias("failed"),
                    valid.alias("is_valid"), reason.alias("reason"))
