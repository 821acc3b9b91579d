"""Best jobs for every resume of a corpus."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions.matching import job_text, match_level, match_reasons, rule_reasons_named, validate_resume
from vitaloom.functions.vocabulary import match_terms
from vitaloom.operators.jobs import combine_jobs, filter_posted_within, link_id, search_jobs
from vitaloom.operators.pairs import job_side, resume_side, top_matches
from vitaloom.operators.recommendations import top_n
from vitaloom.operators.rules import rule_job_columns, rule_matches, rule_resume_columns, shared
from vitaloom.session import cut_lineage

# Places of rows without a time (before all others) and, before those, of feed rows in candidate order.
FIRST_SEQ = -(1 << 60)
FEED_SEQ = -(1 << 62)
# The features that the format checks read.
CHECKED = ["skills", "sections", "email", "phone", "work_experience", "education", "word_count"]


def is_valid(c=F.col):
    """Whether a resume passes the format checks."""
    return validate_resume(*[c(n) for n in CHECKED])["is_valid"]


def candidate_jobs(jobs: DataFrame, keywords=None, location=None, feed: DataFrame | None = None,
                   limit: int | None = fixed.SEARCH_LIMIT) -> DataFrame:
    """Feed rows and the newest ``limit`` catalogue rows of a search, one per link, in candidate order.

    ``limit`` is the length of the search list; ``None`` pairs with the whole catalogue, without sorting it. The order
    is in ``seq`` and, for equal times, ``job_id``; no row is numbered. ``job_id`` is the catalogue's id; rows of the
    feed, whose own ids mean nothing here, get a negative one from their link. ``feed`` may bring a ``vector``.
    """
    found = search_jobs(jobs, keywords, location, limit)
    newest = F.coalesce(-F.unix_micros(F.col("updated").cast("timestamp")), F.lit(FIRST_SEQ))
    found = found.withColumns({"seq": newest, "job_id": F.col("id").cast("bigint")})
    if feed is None:
        feed = found.where("false")
    else:
        feed = feed.withColumns({"seq": F.col("seq").cast("bigint") + F.lit(FEED_SEQ), "job_id": link_id(F.col("link"))})
    return combine_jobs(feed, found, ["seq", "job_id"])


def recommend_jobs(features: DataFrame, candidates: DataFrame, vectors: DataFrame, as_of: str, min_score=None,
                   days_posted=None, k: int = fixed.TOP_MATCHES, text: str = "text", rules: bool = False) -> DataFrame:
    """Ranked matches with reasons.

    ``features`` has the feature columns, ``score`` and ``vector`` per resume;
    ``candidates`` come from :func:`candidate_jobs`; ``vectors(job_id, vector)``
    holds the job vectors. A candidate without a vector stays: it is similar to
    nothing, or with ``rules`` every pair that lacks a vector on either side is
    scored by the rules, and both kinds are ranked together. Long texts are reduced to their match terms on each side and meet
    the ranked rows only. Both sides are written once, in narrow form.
    """
    kept = filter_posted_within(candidates, days_posted, as_of, "updated")
    known = vectors.select("job_id", F.col("vector").alias("_known"))
    own = F.col("vector") if "vector" in kept.columns else F.lit(None).cast(known.schema["_known"].dataType)
    jobs = (kept.withColumn("description", F.col("snippet")).withColumn("vector", own).join(known, "job_id", "left")
            .withColumn("vector", F.coalesce("_known", "vector")))
    terms = match_terms(F.lower(job_text(F.col("title"), F.col("description"))))
    read = rule_job_columns("updated", as_of) if rules else []
    jobs = cut_lineage(job_side(jobs, "job_id", ["seq", "link", "title", terms.alias("_job_terms"), *read]), "candidates")

    # The features are written before the validity filter: a filter on computed
    # columns would be pushed below them and repeat the text work per condition.
    people = features.withColumns({"ats_score": F.col("score"), "candidate_level": F.col("experience_level")})
    terms = match_terms(F.lower(text)).alias("_resume_terms")
    people = cut_lineage(resume_side(people, "id", text, [terms, is_valid().alias("_valid"), *(rule_resume_columns(text) if rules else [])]), "people")
    people = people.where("_valid").drop("_valid")

    if not rules:
        return told_matches(people, jobs, k, min_score)
    by_vector = told_matches(people.where("resume_vector IS NOT NULL"), jobs.where("job_vector IS NOT NULL"), k, min_score)
    by_rules = told_rules(people, jobs, k, min_score)
    columns = [c for c in by_vector.columns if c != "rank"]
    both = by_vector.select(*columns).withColumn("method", F.lit("vectors")).unionByName(by_rules.withColumn("method", F.lit("rules")), allowMissingColumns=True)
    return top_n(both, ["resume_id"], [F.desc("match_score"), F.asc("seq"), F.asc("job_id")], k)


RULE_COLUMNS = ["job_skills", "fresh", "paid", "age_days", "technical", "soft"]


def told_matches(people: DataFrame, jobs: DataFrame, k: int, min_score) -> DataFrame:
    """Best jobs by vectors, with reasons, from the narrow sides."""
    hidden = ["link", "title", "_job_terms", *[c for c in RULE_COLUMNS if c in jobs.columns]]
    best = top_matches(people.drop("_resume_terms", "technical", "soft"), jobs.drop(*hidden), k, min_score, seq="seq", materialize=False)
    told = (best.join(jobs.select("job_id", "link", "title", "_job_terms"), "job_id")
            .join(people.select("resume_id", "_resume_terms"), "resume_id"))
    c = F.col
    reasons = match_reasons(c("similarity"), c("ats_score"), c("raw_score"), c("seniority_penalty"),
                            c("candidate_level"), c("job_level"), c("_resume_terms"), c("_job_terms"))
    return told.withColumn("reasons", reasons).drop("_job_terms", "_resume_terms", "raw_score")


def told_rules(people: DataFrame, jobs: DataFrame, k: int, min_score) -> DataFrame:
    """Best jobs by the rules for pairs that lack a vector, with reasons, from the narrow sides."""
    c = F.col
    people, jobs = people.withColumn("encoded", c("resume_vector").isNotNull()), jobs.withColumn("encoded", c("job_vector").isNotNull())
    best = rule_matches(people, jobs, k, min_score)
    told = (best.join(jobs.select("job_id", "link", "title", "job_level", "job_skills", "age_days"), "job_id")
            .join(people.select("resume_id", "technical", "ats_score", "candidate_level"), "resume_id"))
    named = F.slice(shared(c("technical"), c("job_skills")), 1, 3)
    return (told.withColumn("reasons", rule_reasons_named(c("raw_score"), named, c("age_days"))).withColumn("match_level", match_level(c("raw_score")))
            .drop("raw_score", "technical", "job_skills", "age_days"))


def recommendation_summary(features: DataFrame, matches: DataFrame) -> DataFrame:
    """One row for every resume of ``features``: verdict, its reason, quality score, and how many jobs were recommended.

    ``features`` must have the validation columns; resumes that fail the format checks have ``success`` false.
    """
    checks = validate_resume(*[F.col(c) for c in CHECKED])
    verdicts = features.withColumn("_checks", checks).select(
        F.col("id").alias("resume_id"), F.col("_checks.is_valid").alias("success"), F.col("_checks.reason").alias("reason"),
        F.col("score").alias("ats_score"))
    counts = matches.groupBy("resume_id").agg(F.count(F.lit(1)).alias("recommended_jobs"))
    return verdicts.join(counts, "resume_id", "left").withColumn("recommended_jobs", F.coalesce("recommended_jobs", F.lit(0)))
