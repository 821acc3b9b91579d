"""Stored recommendations and ranking."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.operators.jobs import filter_min_score, filter_posted_within, insert_jobs_if_absent, link_id


def top_n(rows: DataFrame, keys: list[str], order: list, n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark keeps only ``n`` rows per key and task before the shuffle."""
    ranked = rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def top_n_per_resume(matches: DataFrame, n: int = fixed.TOP_MATCHES, seq: str = "job_id") -> DataFrame:
    """Best matches per resume; equal scores keep candidate order."""
    return top_n(matches, ["resume_id"], [F.desc("match_score"), F.asc(seq)], n)


def rank_matches(matches: DataFrame, as_of: str, min_score=None, days_posted=None, n: int = fixed.TOP_MATCHES,
                 posted: str = "updated", seq: str = "job_id") -> DataFrame:
    """Minimum score, then age, then the best ``n`` per resume."""
    kept = filter_posted_within(filter_min_score(matches, min_score), days_posted, as_of, posted)
    return top_n_per_resume(kept, n, seq)


def replace_recommendations(stored: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Stored rows after replacing those of every incoming (user, resume).

    The last of duplicate (user, resume, job) rows wins. Both keyed steps combine
    on the map side; the stored side is only probed against distinct keys.
    """
    keys = ["user_id", "resume_id"]
    kept = stored.join(incoming.select(*keys).distinct(), keys, "left_anti")
    unique = [*keys, "job_id"]
    row = F.struct(*[c for c in stored.columns if c not in unique])
    last = incoming.groupBy(*unique).agg(F.max_by(row, F.col(seq)).alias("_row")).select(*unique, "_row.*")
    return kept.select(*stored.columns).unionByName(last.select(*stored.columns))


def store_recommendations(stored: DataFrame, incoming: DataFrame, jobs: DataFrame, as_of: str, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Catalogue and stored recommendations after storing ``incoming``, whose jobs are named by ``url``.

    Jobs with an unknown url are inserted first, with the id that their link gives (:func:`jobs.link_id`); columns of the
    catalogue that ``incoming`` has come along. Rows without a url have no job and are not stored. The catalogue side of
    the look-up is unique on the url, so a popular job can be split.
    """
    named = incoming.where("url IS NOT NULL")
    details = [c for c in jobs.columns if c in named.columns and c not in ("id", "url")]
    added = insert_jobs_if_absent(jobs, named.select("url", seq, *[c for c in details if c != seq]), as_of, seq)
    catalogue = added.withColumn("id", F.coalesce("id", link_id(F.col("url"))))
    known = jobs.where("url IS NOT NULL").groupBy("url").agg(F.min("id").alias("_id"))
    resolved = named.join(known, "url", "left").withColumn("job_id", F.coalesce("_id", link_id(F.col("url"))))
    return catalogue, replace_recommendations(stored, resolved, seq)


def user_recommendations(recommendations: DataFrame, jobs: DataFrame, user_id: int | None = None,
                         limit: int = fixed.TOP_MATCHES, tie: list[str] | None = None) -> DataFrame:
    """Recommendations with their active jobs, best first, ``limit`` per user."""
    tie = [F.asc(c) for c in (tie or ["resume_id", "job_id"])]
    order = [F.desc_nulls_first("match_score"), F.desc_nulls_first("created_at"), *tie]
    wanted = recommendations if user_id is None else recommendations.where(F.col("user_id") == user_id)
    shown = jobs.where("is_active").withColumnRenamed("id", "job_id").drop("is_active", "created_at", "updated_at")
    # rank the narrow rows of active jobs; only the shown ones meet the details
    live = wanted.join(shown.select("job_id"), "job_id", "left_semi")
    best = live.orderBy(*order).limit(limit) if user_id is not None else top_n(live, ["user_id"], order, limit)
    joined = best.join(shown, "job_id")
    return joined.orderBy(*order) if user_id is not None else joined


def match_batch_summary(matches: DataFrame, good: float = fixed.GOOD_MATCH) -> DataFrame:
    """Mean, good matches and count per resume. Scores are added as whole tenths, so task order cannot change the mean."""
    tenths = F.sum(F.round(F.col("match_score") * 10).cast("bigint"))
    return matches.groupBy("resume_id").agg(
        (tenths / (F.count("match_score") * 10)).alias("avg_score"),
        F.count_if(F.col("match_score") >= good).alias("good_matches"), F.count("*").alias("total"))
