"""Document scores. Every scorer works on the feature columns, never on the text.

``features`` is anything with item access by column name, usually the feature
DataFrame itself, so ladders can be tested without text.
"""

from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions.text import bands, bind, by_level, clamp, ladder

LEVELS = fixed.SCORED_LEVELS


def _ratio(features):
    return features["quantified_bullets"] / F.nullif(features["total_bullets"], F.lit(0))


def _level_ladder(level, value, steps):
    return by_level(level, {name: ladder(value, steps[name]) for name in LEVELS})


def _level_bands(level, value, rows):
    return by_level(level, {name: bands(value, rows[name]) for name in LEVELS})


def _has(col):
    return F.coalesce(col, F.lit("")) != ""


def hybrid_parts(features, level, semantic):
    """Unrounded subscores by name, in report order."""
    steps = fixed.HYBRID
    jobs, projects = F.size(features["work_experience"]), F.size(features["projects"])
    skills, verbs = F.size(features["skills"]), F.size(features["action_verbs"])
    degrees, degree = F.size(features["education"]), F.get(features["education"], F.lit(0))
    contact, link = features["has_contact"], _has(features["linkedin"]) | _has(features["github"])
    either = _has(features["email"]) | _has(features["phone"])
    details = sum([_has(degree[c]).cast("int") for c in ("institution", "degree", "field", "graduation_year")],
                  F.lit(0))
    one_job = F.when(jobs == 1, F.when(projects >= 3, 4.0).otherwise(2.0))
    experience = steps["experience"]
    return {
        "ml_semantic_score": semantic,
        "file_type_score": F.lit(5.0),
        "layout_score": features["layout"]["score"],
        "sections_score": ladder(F.size(features["sections"]), steps["sections"]),
        "date_consistency_score": features["dates"]["score"],
        "contact_info_score": F.when(contact & link, 3.0).when(contact, 2.0).when(either, 1.0).otherwise(0.0),
        "bullet_density_score": F.when(jobs > 0, bands(features["total_bullets"] / F.nullif(jobs, F.lit(0)),
                                                       fixed.BULLET_DENSITY)).otherwise(0.0),
        "summary_score": features["summary_points"],
        "skills_clarity_score": ladder(skills, steps["skills_clarity"]),
        "experience_completeness_score": by_level(level, {
            "entry": F.coalesce(one_job, ladder(jobs, experience["entry"])),
            "mid": ladder(jobs, experience["mid"]), "senior": ladder(jobs, experience["senior"])}),
        "projects_detail_score": _level_ladder(level, projects, steps["projects"]),
        "hard_skills_score": ladder(skills, steps["hard_skills"]),
        "action_verbs_score": ladder(verbs, steps["action_verbs"]),
        "quantification_score": F.coalesce(ladder(_ratio(features), steps["quantification"]), F.lit(0.0)),
        "education_details_score": by_level(level, {
            "entry": F.when(degrees >= 1, ladder(details, steps["education_entry"], 1.0)).otherwise(0.0),
            "mid": F.when(degrees >= 2, 6.0).when(degrees == 1, 5.0).otherwise(0.0),
            "senior": F.when(degrees >= 1, 6.0).otherwise(2.0)}),
        "certifications_score": features["certification_points"],
        "grammar_score": features["grammar_points"],
        "tone_score": features["tone_points"],
        "length_score": _level_bands(level, features["word_count"], fixed.LENGTH_BANDS),
        "tailoring_bonus": F.when(features["tailored"], fixed.BONUS_TAILORING).otherwise(0.0),
        "leadership_bonus": F.when(features["leads"], fixed.BONUS_LEADERSHIP).otherwise(0.0),
        "oss_bonus": F.when(features["open_source"], fixed.BONUS_OPEN_SOURCE).otherwise(0.0),
        "contact_penalty": F.when(contact, 0.0).otherwise(fixed.PENALTY_CONTACT),
        "dates_penalty": features["dates"]["penalty"],
    }


CATEGORIES = {
    "ml_semantic": ["ml_semantic_score"],
    "formatting": ["file_type_score", "layout_score", "sections_score", "date_consistency_score",
                   "contact_info_score", "bullet_density_score"],
    "content": ["summary_score", "skills_clarity_score", "experience_completeness_score", "projects_detail_score"],
    "skills": ["hard_skills_score", "action_verbs_score", "quantification_score"],
    "education": ["education_details_score", "certifications_score"],
    "language": ["grammar_score", "tone_score"],
    "length": ["length_score"],
    "bonuses": ["tailoring_bonus", "leadership_bonus", "oss_bonus"],
    "penalties": ["contact_penalty", "dates_penalty"],
}


def category_rollup(parts):
    """Category totals, base and final score from the unrounded parts (a struct or mapping)."""
    totals = {name: sum([parts[p] for p in members[1:]], parts[members[0]]) for name, members in CATEGORIES.items()}
    base = sum([totals[n] for n in list(CATEGORIES)[1:7]], totals["ml_semantic"])
    final = clamp(base + totals["bonuses"] + totals["penalties"], 0, 100)
    return totals, base, final


def ats_score_hybrid(features, level, semantic):
    """Breakdown struct: every part, the category scores, base and total, to one decimal. Missing semantic points are none."""
    def report(parts):
        totals, base, final = category_rollup(parts)
        return F.struct(
            *[F.round(parts[name], 1).alias(name) for name in names],
            F.struct(*[F.round(col, 1).alias(name) for name, col in totals.items()]).alias("category_scores"),
            F.round(base, 1).alias("base_score"), F.round(final, 1).alias("total_score"))

    parts = hybrid_parts(features, level, F.coalesce(semantic, F.lit(0.0)))
    names = list(parts)
    return bind(F.struct(*[col.cast("double").alias(name) for name, col in parts.items()]), report)


def ats_score_legacy(features, level, mean_similarity):
    """The older, stricter score; a missing similarity counts as zero."""
    steps = fixed.LEGACY
    jobs, projects = F.size(features["work_experience"]), F.size(features["projects"])
    degrees, degree = F.size(features["education"]), F.get(features["education"], F.lit(0))
    named = _has(degree["institution"]) & _has(degree["degree"])
    entry_jobs = (F.when(jobs == 1, ladder(projects, steps["one_job_projects"]))
                  .when(jobs == 0, ladder(projects, steps["no_job_projects"]))
                  .otherwise(ladder(jobs, steps["experience"]["entry"])))
    parts = {
        "contact_info_score": F.when(features["has_contact"], 3.0)
        .when(_has(features["email"]) | _has(features["phone"]), 1.5).otherwise(0.0),
        "professional_identity_score": F.when(_has(features["name"]), 1.0).otherwise(0.0)
        + F.when(_has(features["linkedin"]) | _has(features["github"]), 1.0).otherwise(0.0),
        "sections_score": ladder(F.size(features["sections"]), steps["sections"]),
        "education_score": by_level(level, {
            "entry": F.when(degrees == 0, 0.0).when(named & _has(degree["field"]), 6.0).when(named, 4.0).otherwise(2.0),
            "mid": F.when(degrees == 0, 0.0).when(degrees >= 2, 6.0).when(named, 5.0).otherwise(2.5),
            "senior": F.when(degrees >= 2, 5.0).when(degrees == 1, 4.0).otherwise(0.0)}),
        "work_experience_score": by_level(level, {
            "entry": entry_jobs, "mid": ladder(jobs, steps["experience"]["mid"]),
            "senior": ladder(jobs, steps["experience"]["senior"])}),
        "projects_score": _level_ladder(level, projects, steps["projects"]),
        "action_verbs_score": ladder(F.size(features["action_verbs"]), steps["action_verbs"]),
        "skills_score": ladder(F.size(features["skills"]), steps["skills"]),
        "quantification_score": F.when(features["total_bullets"] > 0, ladder(_ratio(features), steps["quantification"]))
        .otherwise(ladder(F.size(features["numbers"]), steps["numbers"])),
        "content_density_score": bands(features["word_count"], fixed.LEGACY_DENSITY),
        "bullet_points_score": _level_bands(level, features["total_bullets"], fixed.LEGACY_BULLETS),
    }
    semantic = F.coalesce(mean_similarity, F.lit(0.0)) * F.lit(20.0)
    rules = sum(list(parts.values())[1:], parts["contact_info_score"])
    total = clamp(semantic + rules, 0, 100)
    return F.struct(F.round(semantic, 1).alias("ml_semantic_score"),
                    *[F.round(col, 1).alias(name) for name, col in parts.items()],
                    F.round(rules, 1).alias("rule_based_score"), F.round(total, 1).alias("total_score"))


def ats_score_rules(features):
    """Score without an encoder (unrounded)."""
    steps = fixed.RULES
    sections, verbs = F.size(features["sections"]), F.size(features["action_verbs"])
    numbers, skills = F.size(features["numbers"]), F.size(features["skills"])
    contact = (F.when(features["has_contact"], 8.0)
               .when(_has(features["email"]) | _has(features["phone"]), 4.0).otherwise(0.0))
    mixed = None
    for v, n, points in steps["verbs_and_numbers"]:
        hit = (verbs >= v) & (numbers >= n)
        mixed = F.when(hit, points) if mixed is None else mixed.when(hit, points)
    score = (contact + ladder(sections, steps["sections"], sections / F.lit(6) * F.lit(12))
             + F.least(verbs / F.lit(12) * F.lit(15), F.lit(15.0))
             + F.least(numbers / F.lit(10) * F.lit(18), F.lit(18.0))
             + bands(features["word_count"], steps["words"], 6.0)
             + ladder(sections, steps["section_bonus"]) + mixed.otherwise(0.0) + ladder(skills, steps["skills"]))
    return clamp(score, 0, 100)


def ats_status(score):
    """Struct of status and message."""
    status = message = None
    for at_least, name, said in fixed.STATUS[:-1]:
        hit = score >= at_least
        status = F.when(hit, name) if status is None else status.when(hit, name)
        message = F.when(hit, said) if message is None else message.when(hit, said)
    return F.struct(status.otherwise(fixed.STATUS[-1][1]).alias("status"),
                    message.otherwise(fixed.STATUS[-1][2]).alias("message"))
