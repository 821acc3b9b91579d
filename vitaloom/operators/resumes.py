"""Versioned resumes: lookups, new versions, stored analyses, pending work."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.operators.jobs import touch_updated_at


def mark_latest(resumes: DataFrame) -> DataFrame:
    """Set ``is_latest`` from upload date and id.

    The newest id per user is a fixed-width aggregate with map-side combine, and
    the flag comes back by a join on the unique resume id: no user's history is
    ever sorted or gathered in one task.
    """
    newest = resumes.groupBy("user_id").agg(F.max(F.struct("upload_date", "id")).alias("_top"))
    ids = newest.select(F.col("_top.id").alias("id"), F.lit(True).alias("_latest"))
    flagged = resumes.drop("is_latest").join(ids, "id", "left")
    return flagged.withColumn("is_latest", F.coalesce("_latest", F.lit(False))).drop("_latest")


def add_resume_version(resumes: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Append uploads; the older rows of those users stop being the latest, and are stamped when they change."""
    touched = new.where("user_id IS NOT NULL").select("user_id").distinct().withColumn("_touched", F.lit(True))
    owner = F.coalesce("_touched", F.lit(False))
    # the stored side, with its long columns, is dealt once; the flags of the uploads come from the uploads alone
    stored = resumes.join(touched, "user_id", "left").withColumn("_demoted", owner & F.coalesce("is_latest", F.lit(False)))
    stored = touch_updated_at(stored.withColumn("is_latest", F.when(owner, F.lit(False)).otherwise(F.col("is_latest"))), F.col("_demoted"), as_of)
    tops = new.groupBy("user_id").agg(F.max(F.struct("upload_date", "id")).alias("_top"))
    newest = tops.select(F.col("_top.id").alias("id"), F.lit(True).alias("_newest"))
    given = F.col("is_latest") if "is_latest" in new.columns else F.lit(None).cast("boolean")
    uploads = new.join(newest, "id", "left").withColumn(
        "is_latest", F.when(F.col("user_id").isNotNull(), F.coalesce("_newest", F.lit(False))).otherwise(given)).drop("_newest")
    return stored.select(*resumes.columns).unionByName(uploads, allowMissingColumns=True).select(*resumes.columns)


def attach_analysis(resumes: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """Overwrite status and analysis of the resumes named in ``results(id, status, analysis)``, null included."""
    update = results.select("id", F.col("status").alias("_status"), F.col("analysis").alias("_analysis"),
                            F.lit(True).alias("_hit"))
    # analyses repeat much of their text: small in files and large in memory, by the files' size they would be broadcast
    joined = resumes.join(update.hint("merge"), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    changed = joined.withColumns({"status": F.when(hit, F.col("_status")).otherwise(F.col("status")),
                                  "analysis": F.when(hit, F.col("_analysis")).otherwise(F.col("analysis"))})
    return touch_updated_at(changed, hit, as_of).select(*resumes.columns)


def latest_resume(resumes: DataFrame, user_id: int | None = None) -> DataFrame:
    """Latest resume of one user, or of every user."""
    latest = resumes.where("is_latest")
    return latest if user_id is None else latest.where(F.col("user_id") == user_id)


def resume_by_id(resumes: DataFrame, resume_id: int) -> DataFrame:
    return resumes.where(F.col("id") == resume_id)


def user_resumes(resumes: DataFrame, user_id: int) -> DataFrame:
    """History of one user, newest first."""
    return resumes.where(F.col("user_id") == user_id).orderBy(F.desc_nulls_first("created_at"), F.desc("id"))


def resume_content(resumes: DataFrame, resume_id: int | None = None, user_id: int | None = None) -> DataFrame:
    """Content projection of one resume or of a user's latest one; the only reader of the binary column."""
    rows = latest_resume(resumes, user_id) if resume_id is None else resume_by_id(resumes, resume_id)
    content = "pdf_content" if "pdf_content" in resumes.columns else "text"
    return rows.select(F.col(content).alias("content"), "file_name", "upload_date", "status")


def owned_by(rows: DataFrame, user_id: int) -> DataFrame:
    return rows.where(F.col("user_id") == user_id)


def needs_analysis(resumes: DataFrame, target_level: str | None = None) -> DataFrame:
    """Pending work: everything when a new level is asked for, else what is not analysed yet."""
    if target_level:
        return resumes
    done = (F.col("status") == "processed") & F.col("analysis").isNotNull()
    return resumes.where(~F.coalesce(done, F.lit(False)))


def stale_analysis(features: DataFrame) -> DataFrame:
    """Add ``limited_skills``, ``missing_fields`` and ``is_stale`` (what an outdated analysis looks like)."""
    limited = F.coalesce(F.size("skills") < 10, F.lit(False)) & F.col("skills").isNotNull()
    missing = (F.coalesce("name", F.lit("")) == "") | F.col("projects").isNull() | F.col("education").isNull()
    return features.withColumns({"limited_skills": limited, "missing_fields": missing,
                                 "is_stale": limited | missing})
