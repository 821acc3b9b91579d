"""Resume texts to scores, insights and advice."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions.advice import insights, recommendations
from vitaloom.functions.levels import resolve_level
from vitaloom.functions.scores import ats_score_hybrid, ats_score_rules, ats_status
from vitaloom.functions.text import has_text
from vitaloom.functions.vectors import nonzero, semantic_to_ideal, unit
from vitaloom.operators.features import extract_features, require_text
from vitaloom.operators.resumes import attach_analysis, needs_analysis
from vitaloom.sources.buckets import read_buckets, update_buckets


def score_features(features: DataFrame, target_level=None, semantic=None) -> DataFrame:
    """Add ``level``, ``breakdown`` (with an encoder), ``score``, status, insights and advice.

    ``semantic`` is the column with the semantic points; without it, and in rows
    where it is null, the score comes from the rules alone, without a breakdown.
    """
    leveled = features.withColumn("level", resolve_level(F.col("experience_level"), target_level))
    level = F.col("level")
    if semantic is None:
        scored = leveled.withColumn("_score", ats_score_rules(leveled))
    else:
        points = leveled.withColumn("_semantic", semantic)
        known = F.col("_semantic").isNotNull()
        scored = points.withColumn("breakdown", F.when(known, ats_score_hybrid(points, level, F.col("_semantic"))))
        scored = scored.withColumn("_score", F.when(known, F.col("breakdown.total_score")).otherwise(ats_score_rules(points))).drop("_semantic")
    return scored.withColumns({
        "score": F.round("_score", 1), "_status": ats_status(F.col("_score")),
        "insights": insights(scored, F.col("_score"), level),
        "recommendations": recommendations(scored, F.col("_score"), level),
    }).withColumns({"status": F.col("_status.status"), "status_message": F.col("_status.message")}).drop(
        "_score", "_status")


def ideal_vectors(spark: SparkSession, encoder: Callable[[DataFrame], DataFrame], sentences: list[str] = fixed.IDEAL_SENTENCES):
    """The ideal sentences as one array of unit vectors, a scalar subquery. ``encoder`` adds ``vector`` to rows with ``text``.

    The vectors are in the sparse form of :func:`vitaloom.functions.vectors.nonzero`: a sentence has few words.
    """
    rows = encoder(spark.createDataFrame(list(enumerate(sentences)), "pos int, text string"))
    both = F.array_sort(F.collect_list(F.struct("pos", unit(F.col("vector")).alias("v"))))
    return rows.agg(nonzero(F.transform(both, lambda s: s["v"])).alias("all")).scalar()


def analyze_resumes(df: DataFrame, text: str = "text", target_level=None, semantic=None,
                    as_of_year: int = fixed.CURRENT_YEAR, encoder: Callable[[DataFrame], DataFrame] | None = None,
                    **vocabularies) -> DataFrame:
    """Add the ``analysis`` struct to every row; rows without text get ``success = false`` only.

    ``semantic`` is a column with semantic points; an ``encoder`` (it adds ``vector``) gives those of the ideal sentences.
    """
    kept = df.columns
    if encoder is not None:
        df = encoder(df).withColumn("_ideals", ideal_vectors(df.sparkSession, encoder))
        semantic = semantic_to_ideal(F.col("vector"), F.col("_ideals"), sparse=True)
    scored = score_features(extract_features(require_text(df, text), text, as_of_year=as_of_year, **vocabularies),
                            target_level, semantic)
    col = F.col
    metrics = F.struct(
        col("word_count").alias("wordCount"), F.size("sections").alias("sectionsFound"),
        F.size("skills").alias("skillsFound"), F.size("action_verbs").alias("actionVerbs"),
        F.size("numbers").alias("quantifiableMetrics"), col("has_contact").alias("contactInfoPresent"),
        col("total_bullets").alias("totalBullets"), col("quantified_bullets").alias("quantifiedBullets"))
    info = F.struct(
        "name", "email", "phone", "location", "linkedin", "github", "skills", "sections", "education",
        "work_experience", "projects", col("experience_level").alias("experienceLevel"),
        col("years_of_experience").alias("yearsOfExperience"))
    parts = [col("score"), col("status"), col("status_message").alias("statusMessage"), col("insights"),
             col("recommendations"), metrics.alias("metrics"), info.alias("extractedInfo"),
             col("level").alias("targetLevel")]
    if semantic is not None:
        parts.insert(5, col("breakdown").alias("scoreBreakdown"))
    full = F.when(col("success"), F.struct(*parts))
    return scored.select(*kept, "success", full.alias("analysis"))


def analyze_pending(spark: SparkSession, path: str, schema, buckets: int, as_of: str, target_level: str | None = None, pending=None, **options) -> list[int]:
    """Analyse what a stored table of resumes still lacks and attach the structs in place; returns the buckets written.

    The table lies in ``buckets`` by id (:mod:`vitaloom.sources.buckets`), its ``analysis`` column is the struct of
    :func:`analyze_resumes`. ``pending`` narrows the work further. Rows without text stay as they are.
    """
    work = needs_analysis(read_buckets(spark, path, schema), target_level)
    work = work if pending is None else work.where(pending)
    done = analyze_resumes(work.where(has_text(F.col("text"))).select("id", "text"), target_level=target_level, **options)
    results = done.select("id", F.lit("processed").alias("status"), "analysis")
    return update_buckets(spark, path, schema, ["id"], buckets, results, lambda stored, found: attach_analysis(stored, found, as_of))


def analysis_type(spark: SparkSession, **options):
    """The type of the ``analysis`` column, for the schema of a stored table."""
    return analyze_resumes(spark.createDataFrame([], "text string"), **options).schema["analysis"].dataType
