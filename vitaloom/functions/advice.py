"""Insights and advice as ordered arrays of messages."""

from pyspark.sql import functions as F

from vitaloom import fixed_messages as say
from vitaloom import fixed_values as fixed
from vitaloom.functions.text import bind, by_level, has_any, string_array
from vitaloom.functions.vocabulary import missing_sections


def first_of(*cases):
    """Message of the first true ``(condition, message)``, else null."""
    col = None
    for condition, message in cases:
        message = F.lit(message) if isinstance(message, str) else message
        col = F.when(condition, message) if col is None else col.when(condition, message)
    return col


def filled(template, *values):
    return F.format_string(template, *values)


def _has(col):
    return F.coalesce(col, F.lit("")) != ""


def _level_label(level):
    return by_level(level, {k: F.lit(v) for k, v in say.LEVEL_LABELS.items()})


def insights(features, score, level):
    """Positive messages, in order."""
    said = say.INSIGHT
    degrees, jobs, projects = (F.size(features[c]) for c in ("education", "work_experience", "projects"))
    sections, verbs, numbers, skills = (F.size(features[c])
                                        for c in ("sections", "action_verbs", "numbers", "skills"))
    linkedin, github, words = _has(features["linkedin"]), _has(features["github"]), features["word_count"]
    label = _level_label(level)
    headline = first_of(*[(score >= at, filled(text, label)) for at, text in say.HEADLINES[:-1]])
    lines = [
        headline.otherwise(filled(say.HEADLINES[-1][1], label)),
        first_of((features["has_contact"], said["contact"])),
        first_of((linkedin & github, said["both_links"]), (linkedin | github, said["one_link"])),
        first_of((degrees >= 2, filled(said["degrees"], degrees)), (degrees == 1, said["degree"])),
        first_of((jobs >= 3, filled(said["jobs_3"], jobs)), (jobs >= 2, filled(said["jobs_2"], jobs)),
                 (jobs == 1, said["jobs_1"])),
        first_of((projects >= 3, filled(said["projects_3"], projects)),
                 (projects >= 2, filled(said["projects_2"], projects)), (projects == 1, said["projects_1"])),
        first_of((sections >= 5, filled(said["sections_5"], sections)),
                 (sections >= 3, filled(said["sections_3"], sections))),
        first_of((verbs >= 10, filled(said["verbs_10"], verbs)), (verbs >= 5, filled(said["verbs_5"], verbs))),
        first_of((numbers >= 5, filled(said["numbers_5"], numbers)),
                 (numbers >= 3, filled(said["numbers_3"], numbers))),
        first_of((skills >= 10, filled(said["skills_10"], skills)), (skills >= 5, filled(said["skills_5"], skills))),
        first_of((words.between(400, 900), said["length_good"]), (words.between(300, 399), said["length_fair"])),
    ]
    return F.array_compact(F.array(*lines))


def recommendations(features, score, level):
    """What to improve, in order."""
    said = say.ADVICE
    degrees, jobs, projects = (F.size(features[c]) for c in ("education", "work_experience", "projects"))
    verbs, numbers, skills = (F.size(features[c]) for c in ("action_verbs", "numbers", "skills"))
    bullets, measured, words = features["total_bullets"], features["quantified_bullets"], features["word_count"]
    degree = F.get(features["education"], F.lit(0))
    linked = _has(features["linkedin"]) | _has(features["github"])
    entry, mid, senior = level == "entry", level == "mid", ~level.isin("entry", "mid")
    no_contact = ~features["has_contact"]
    no_degree = (degrees == 1) & ~_has(degree["degree"])
    ratio = measured / F.nullif(bullets, F.lit(0))

    start = [
        first_of((~_has(features["name"]), said["name"])),
        first_of((~linked & entry, said["links_entry"]), (~linked, said["links"])),
        first_of((no_contact & ~_has(features["email"]), said["email"])),
        first_of((no_contact & ~_has(features["phone"]), said["phone"])),
        first_of((degrees == 0, said["education"]),
                 ((degrees == 1) & ~_has(degree["institution"]), said["institution"])),
        first_of((no_degree, said["degree"])),
        first_of((no_degree & senior, said["degree_senior"])),
        first_of((entry & (jobs == 0) & (projects < 3), said["entry_jobs_0"]),
                 (entry & (jobs == 1), said["entry_jobs_1"]),
                 (mid & (jobs == 0), said["mid_jobs_0"]), (mid & (jobs == 1), said["mid_jobs_1"]),
                 (mid & (jobs == 2), said["mid_jobs_2"]),
                 (senior & (jobs < 3), said["senior_jobs_few"]), (senior & (jobs == 3), said["senior_jobs_3"])),
        first_of((entry & (jobs == 0) & (projects < 3), said["entry_jobs_0_projects"])),
        first_of((entry & (projects == 0), said["entry_projects_0"]),
                 (entry & (projects == 1), said["entry_projects_1"]),
                 (entry & (projects == 2), said["entry_projects_2"]),
                 (mid & (projects == 0) & (jobs < 3), said["mid_projects_0"]),
                 (mid & (projects == 1), said["mid_projects_1"]),
                 (senior & (projects == 0), said["senior_projects_0"])),
        first_of((entry & (bullets < 10), filled(said["entry_bullets_low"], bullets)),
                 (entry & (bullets < 12), filled(said["entry_bullets_fair"], bullets)),
                 (mid & (bullets < 20), filled(said["mid_bullets_low"], bullets)),
                 (mid & (bullets < 25), filled(said["mid_bullets_fair"], bullets)),
                 (senior & (bullets < 30), filled(said["senior_bullets_low"], bullets)),
                 (senior & (bullets < 35), filled(said["senior_bullets_fair"], bullets))),
    ]
    sections = F.transform(missing_sections(features["sections"]), lambda s: filled(said["section"], F.initcap(s)))
    repeated = F.transform(F.map_entries(features["repetitive_verbs"]),
                           lambda e: filled(said["repeated"], F.initcap(e["key"]), e["value"]))
    end = [
        first_of((verbs < 5, said["verbs_low"]), (verbs < 10, said["verbs_fair"])),
        first_of((ratio < 0.3, filled(said["quantified_low"], measured, bullets)),
                 (ratio < 0.5, filled(said["quantified_fair"], measured, bullets)),
                 (ratio < 0.7, filled(said["quantified_good"], measured, bullets)),
                 ((bullets == 0) & (numbers < 3), said["numbers_low"]),
                 ((bullets == 0) & (numbers < 5), said["numbers_fair"])),
        first_of((words < 200, said["words_200"]), (words < 300, said["words_300"]), (words < 400, said["words_400"]),
                 (words > 1200, said["words_1200"]), (words > 900, said["words_900"])),
        first_of((skills < 5, said["skills_low"]), (skills < 8, said["skills_fair"])),
        first_of((score < 50, said["score_low"]), (score < 70, said["score_fair"])),
    ]
    advice = F.concat(F.array_compact(F.array(*start)), sections, repeated, F.array_compact(F.array(*end)))
    hint = F.when(F.exists(advice, lambda a: F.contains(F.lower(a), F.lit("bullet"))), string_array([]))
    return F.concat(advice, hint.otherwise(string_array([said["bullets"]])))


def highlight_insights(insight_list, advice):
    """Struct of the short lists shown to a person."""
    def quality(line):
        return bind(F.lower(line), lambda low: has_any(low, fixed.QUALITY_WORDS) | ~has_any(low, fixed.DRAWBACK_WORDS))

    return F.struct(F.slice(insight_list, 1, 5).alias("key_insights"),
                    F.slice(F.filter(insight_list, quality), 1, 6).alias("qualities"),
                    F.slice(advice, 1, 6).alias("improvements"))
