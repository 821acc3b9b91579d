"""Queries over single documents: every resume and every document, whole texts."""

from pyspark.sql import functions as F

from catalog.features_sql import any_of, features, lit, words
from catalog.inputs import CORPUS, JOB_TEXTS, for_duckdb, table
from vitaloom import fixed_values as fixed
from vitaloom.functions import bullets, contact, levels, matching, quality, sections, vocabulary
from vitaloom.functions.text import word_count
from vitaloom.operators.features import extract_features, require_text
from vitaloom.operators.lines import line_segments
from vitaloom.operators.resumes import stale_analysis
from vitaloom.operators.terms import find_terms

QUERIES, SQL = {}, {}


def corpus(spark, d):
    return table(spark, d, CORPUS).select("doc_id", "text")


def joined(items, sep="|"):
    return F.array_join(items, sep)


def entries(items, *names):
    return joined(F.transform(items, lambda e: F.concat_ws("~", *[F.coalesce(e[n], F.lit("")) for n in names])), "||")


def counted(freq):
    return joined(F.transform(F.map_entries(freq), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))


def _column_query(build):
    """One value per document from the text and its lower-cased form."""
    def run(spark, d):
        low = corpus(spark, d).withColumn("low", F.lower("text"))
        return low.select("doc_id", build(F.col("text"), F.col("low")).alias("value"))
    return run


def _skills(t, low):
    return vocabulary.find_skills(low)


def _level(t, low):
    r = levels.detect_level(low, F.size(bullets.split_bullets(t)))
    return F.concat_ws(":", r["level"], r["years"].cast("string"))


def _dates(t, low):
    r = quality.date_consistency(sections.extract_experience(sections.experience_section(t, low)),
                                 sections.extract_education(sections.education_section(t, low)))
    return F.concat_ws(":", r["score"].cast("string"), r["penalty"].cast("string"))


def _in_sql(name, words_):
    return f"lower(k) IN ({', '.join(map(lit, words_))})" if name == fixed.EXACT_CATEGORY else any_of("lower(k)", words_)


def _category_sql(name):
    return f"list_filter(skills, lambda k: {_in_sql(name, fixed.SEARCH_CATEGORIES[name])})"


ALL_CATEGORIES_SQL = "(" + " OR ".join(_in_sql(n, w) for n, w in fixed.SEARCH_CATEGORIES.items()) + ")"
LOOSE_SQL = f"list_filter(skills, lambda k: NOT {ALL_CATEGORIES_SQL})"
CHOSEN_SQL = ("list_concat(" + ", ".join(_category_sql(n) for n in fixed.SEARCH_CATEGORIES if n != "soft")
              + f", {_category_sql('soft')}[1:5], {LOOSE_SQL})")
KEYWORDS_SQL = (f"CASE WHEN len(skills) = 0 THEN '{fixed.DEFAULT_SEARCH}' ELSE array_to_string(list_filter({CHOSEN_SQL}, "
                f"lambda k, i: list_position({CHOSEN_SQL}, k) = i), ' ') END")
EDUCATION_SQL = (f"CASE WHEN has_education THEN concat(coalesce(degree, '{fixed.DEFAULT_DEGREE}'), '~', field, '~', "
                 "coalesce(institution, ''), '~', coalesce(graduation_year, '')) ELSE '' END")
MISSING_SQL = "list_filter(['experience', 'education', 'skills', 'summary'], lambda s: NOT list_contains(sections, s))"


def _list(expr):
    return f"coalesce(array_to_string({expr}, '|'), '')"


# name: (column on Spark, the same value from the feature SQL)
VALUES = {
    "word_count": (lambda t, low: word_count(t).cast("bigint"), "CAST(word_count AS BIGINT)"),
    "extract_name": (lambda t, low: contact.extract_name(t), "name"),
    "extract_email": (lambda t, low: contact.extract_email(t), "email"),
    "extract_phone": (lambda t, low: contact.extract_phone(t), "phone"),
    "extract_location": (lambda t, low: contact.extract_location(t), "location"),
    "extract_linkedin": (lambda t, low: contact.extract_linkedin(t), "linkedin"),
    "extract_github": (lambda t, low: contact.extract_github(t), "github"),
    "find_sections": (lambda t, low: joined(vocabulary.find_sections(low)), _list("sections")),
    "missing_sections": (lambda t, low: joined(vocabulary.missing_sections(vocabulary.find_sections(low))),
                         _list(MISSING_SQL)),
    "find_action_verbs": (lambda t, low: joined(vocabulary.find_action_verbs(low)), _list("verbs")),
    "find_skills": (lambda t, low: joined(_skills(t, low)), _list("skills")),
    "find_numbers": (lambda t, low: joined(vocabulary.find_numbers(t)), _list("numbers")),
    "action_verb_frequency": (lambda t, low: counted(vocabulary.action_verb_frequency(low)),
                              _list("list_transform(verbs, lambda v, i: concat(v, '=', verb_counts[i]))")),
    "repetitive_verbs": (lambda t, low: counted(vocabulary.repetitive_verbs(vocabulary.action_verb_frequency(low))),
                         _list("list_filter(list_transform(verbs, lambda v, i: CASE WHEN verb_counts[i] > 2 THEN "
                               "concat(v, '=', verb_counts[i]) END), lambda x: x IS NOT NULL)")),
    "count_bullets": (lambda t, low: bullets.count_bullets(bullets.split_bullets(t)).cast("bigint"),
                      "CAST(total_bullets AS BIGINT)"),
    "quantified_bullets": (lambda t, low: bullets.quantified_bullets(bullets.split_bullets(t)).cast("bigint"),
                           "CAST(quantified_bullets AS BIGINT)"),
    "extract_education": (lambda t, low: entries(sections.extract_education(sections.education_section(t, low)), "degree",
                                                 "field", "institution", "graduation_year"), EDUCATION_SQL),
    "extract_experience": (lambda t, low: entries(sections.extract_experience(sections.experience_section(t, low)),
                                                  "organization", "role", "duration", "description"),
                           "coalesce(array_to_string(work, '||'), '')"),
    "extract_projects": (lambda t, low: entries(sections.extract_projects(sections.project_section(t, low)), "name",
                                                "technology", "description"),
                         "coalesce(array_to_string(projects, '||'), '')"),
    "detect_level": (_level, "seniority"),
    "max_stated_years": (lambda t, low: levels.max_stated_years(low), "CAST(stated AS BIGINT)"),
    "sum_date_ranges": (lambda t, low: levels.sum_date_ranges(low), "CAST(ranges AS BIGINT)"),
    "analyze_layout": (lambda t, low: quality.analyze_layout(t)["layout"], "layout"),
    "date_consistency": (_dates, "concat(CAST(CAST(date_score AS DOUBLE) AS VARCHAR), ':', "
                                 "CAST(CAST(date_penalty AS DOUBLE) AS VARCHAR))"),
    "grammar_score": (lambda t, low: quality.grammar_score(t, low), "CAST(grammar AS DOUBLE)"),
    "tone_score": (lambda t, low: quality.tone_score(t, low), "CAST(tone AS DOUBLE)"),
    "summary_score": (lambda t, low: quality.summary_score(t, low), "CAST(summary AS DOUBLE)"),
    "certifications_score": (lambda t, low: quality.certifications_score(low), "CAST(certificates AS DOUBLE)"),
    "detect_tailoring": (lambda t, low: quality.detect_tailoring(low), "tailored"),
    "detect_leadership": (lambda t, low: quality.detect_leadership(low), "leads"),
    "detect_oss": (lambda t, low: quality.detect_oss(low), "open_source"),
    "search_keywords": (lambda t, low: vocabulary.search_keywords(_skills(t, low)), KEYWORDS_SQL),
    "uncategorized_skills": (lambda t, low: joined(vocabulary.uncategorized_skills(_skills(t, low))), _list(LOOSE_SQL)),
    "cap_soft_skills": (lambda t, low: joined(vocabulary.cap_soft_skills(_skills(t, low))),
                        _list(_category_sql("soft") + "[1:5]")),
    "resolve_level": (lambda t, low: levels.resolve_level(levels.detect_level(low, F.size(bullets.split_bullets(t)))["level"]),
                      "CASE WHEN experience_level IN ('entry', 'mid', 'senior') THEN experience_level ELSE 'entry' END"),
}
for _name, (_build, _expr) in VALUES.items():
    QUERIES[_name] = _column_query(_build)
    SQL[_name] = f"{features()}SELECT doc_id, {_expr} AS value FROM features"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


@query("require_text", f"SELECT doc_id, coalesce(trim(text) <> '', false) AS success FROM ({for_duckdb(CORPUS)})")
def _require_text(spark, d):
    return require_text(corpus(spark, d)).select("doc_id", "success")


@query("split_bullets", features() + "SELECT doc_id, CAST(b AS BIGINT) AS n, s AS bullet FROM bullet")
def _split_bullets(spark, d):
    return corpus(spark, d).select("doc_id", F.posexplode(bullets.split_bullets(F.col("text"))).alias("n", "bullet")).select(
        "doc_id", (F.col("n") + 1).cast("bigint").alias("n"), "bullet")


@query("line_segments", features() + """SELECT doc_id, CAST(b AS BIGINT) AS segment, min(n) AS first_line, max(n) AS last_line,
  count(*) AS n_lines FROM marked WHERE b > 0 GROUP BY doc_id, b""")
def _line_segments(spark, d):
    return line_segments(corpus(spark, d), "doc_id")


@query("extract_section", features() + "SELECT doc_id, edu AS education, xp AS experience, pj AS projects FROM cut")
def _extract_section(spark, d):
    t, low = F.col("text"), F.col("low")
    return corpus(spark, d).withColumn("low", F.lower("text")).select(
        "doc_id", sections.education_section(t, low).alias("education"),
        sections.experience_section(t, low).alias("experience"), sections.project_section(t, low).alias("projects"))


@query("skill_category_counts", features() + "SELECT doc_id, " + ", ".join(
    f"CAST(len({_category_sql(n)}) AS BIGINT) AS {n}" for n in fixed.SEARCH_CATEGORIES) + " FROM features")
def _skill_category_counts(spark, d):
    low = corpus(spark, d).select("doc_id", F.lower("text").alias("low"))
    skills = low.select("doc_id", vocabulary.find_skills(F.col("low")).alias("skills"))
    counts = skills.select("doc_id", vocabulary.skill_category_counts(F.col("skills")).alias("n"))
    return counts.select("doc_id", *[F.col("n")[c].cast("bigint").alias(c) for c in fixed.SEARCH_CATEGORIES])


@query("stale_analysis", features() + """SELECT doc_id, len(skills) < 10 AS limited_skills, name IS NULL AS missing_fields,
  len(skills) < 10 OR name IS NULL AS is_stale FROM features""")
def _stale_analysis(spark, d):
    return stale_analysis(extract_features(corpus(spark, d))).select("doc_id", "limited_skills", "missing_fields", "is_stale")


_PASSED = """[len(skills) >= 3, len(sections) >= 2, email IS NOT NULL OR phone IS NOT NULL, jobs > 0 OR degrees > 0,
  word_count BETWEEN 200 AND 2000]"""


@query("validate_resume", features() + f"""SELECT doc_id, CAST(passed AS BIGINT) AS passed,
  CASE WHEN passed >= 3 THEN '' ELSE coalesce(array_to_string(list_filter(list_transform(
    ['sufficientSkills', 'hasProperSections', 'hasContactInfo', 'hasExperienceOrEducation', 'reasonableLength'],
    lambda n, i: CASE WHEN NOT checks[i] THEN n END), lambda n: n IS NOT NULL), '|'), '') END AS failed,
  passed >= 3 AS is_valid, CASE WHEN passed >= 3 THEN {lit(fixed.FORMAT_OK)} ELSE
    replace({lit(fixed.FORMAT_BAD)}, '%d', CAST(5 - passed AS VARCHAR)) END AS reason
  FROM (SELECT doc_id, {_PASSED} AS checks, len(list_filter({_PASSED}, lambda c: c)) AS passed FROM features)""")
def _validate_resume(spark, d):
    c = F.col
    f = extract_features(corpus(spark, d))
    v = f.select("doc_id", matching.validate_resume(c("skills"), c("sections"), c("email"), c("phone"), c("work_experience"),
                                                    c("education"), c("word_count")).alias("v"))
    return v.select("doc_id", c("v.passed").cast("bigint").alias("passed"), joined(c("v.failed")).alias("failed"),
                    "v.is_valid", "v.reason")


def job_seniority_sql(title="lower(coalesce(title, ''))", body="lower(coalesce(description, ''))") -> str:
    both = f"concat({title}, ' ', {body})"

    def number(pattern, group=1):
        return f"TRY_CAST(nullif(regexp_extract({both}, {lit(pattern)}, {group}), '') AS BIGINT)"

    middle = f"(({number(fixed.JOB_YEARS_RANGE)} + {number(fixed.JOB_YEARS_RANGE, 2)}) // 2)"
    years = f"coalesce({number(fixed.JOB_YEARS_PLUS)}, {middle}, {number(fixed.JOB_YEARS)})"
    duties = " ".join(f"WHEN {any_of(body, ws)} THEN {lit(k)}" for k, ws in fixed.JOB_DUTIES.items())
    return f"""CASE
  WHEN {any_of(both, fixed.JOB_INTERN)} AND (NOT contains({both}, 'graduate student') OR contains({both}, 'intern')) THEN 'intern'
  WHEN {any_of(title, fixed.JOB_PRINCIPAL_TITLES)} OR {any_of(title, fixed.JOB_MANAGER_TITLES)} THEN 'principal'
  WHEN {any_of(both, fixed.JOB_ENTRY)} THEN 'entry'
  WHEN contains({both}, ' i ') AND NOT {any_of(both, fixed.JOB_HIGHER_NUMERALS)} THEN 'entry'
  WHEN {any_of(title, fixed.JOB_ENTRY_TITLES)} AND NOT {any_of(title, fixed.JOB_ENTRY_TITLE_EXCEPT)} THEN 'entry'
  WHEN {any_of(body, fixed.JOB_TEACHING)} THEN 'entry'
  WHEN {any_of(both, fixed.JOB_SENIOR)} THEN CASE WHEN coalesce({middle}, {number(fixed.JOB_YEARS_OPEN)}) >= 7 THEN 'principal'
    ELSE 'senior' END
  WHEN {any_of(both, fixed.JOB_MID)} THEN 'mid'
  WHEN {years} >= 10 THEN 'principal' WHEN {years} >= 5 THEN 'senior' WHEN {years} >= 2 THEN 'mid' WHEN {years} <= 1 THEN 'entry'
  {duties}
  WHEN {any_of(title, fixed.JOB_ROLE_TITLES)} AND NOT {any_of(body, fixed.JOB_ROLE_MID_HINTS)}
    AND {any_of(body, fixed.JOB_ROLE_ENTRY_HINTS)} THEN 'entry' ELSE 'mid' END"""


@query("detect_job_seniority", f"SELECT doc_id, {job_seniority_sql()} AS level FROM ({for_duckdb(JOB_TEXTS)})")
def _detect_job_seniority(spark, d):
    return table(spark, d, JOB_TEXTS).select(
        "doc_id", levels.detect_job_seniority(F.col("title"), F.col("description")).alias("level"))


@query("is_snippet", f"SELECT doc_id, {words('text')} < 100 AS snippet FROM (SELECT doc_id, concat(title, ' ', description) "
                     f"AS text FROM ({for_duckdb(JOB_TEXTS)}))")
def _is_snippet(spark, d):
    return table(spark, d, JOB_TEXTS).select(
        "doc_id", matching.is_snippet(matching.job_text(F.col("title"), F.col("description"))).alias("snippet"))


def _find_terms(spark, d):
    """The skills as a table that the words of the texts are joined with."""
    names = list(dict.fromkeys(fixed.TECHNICAL_SKILLS + fixed.SOFT_SKILLS))
    terms = spark.createDataFrame(list(enumerate(names)), "ord int, term string")
    return find_terms(table(spark, d, CORPUS), terms).select("doc_id", joined(F.col("terms")).alias("value"))


QUERIES["find_terms"], SQL["find_terms"] = _find_terms, SQL["find_skills"]
