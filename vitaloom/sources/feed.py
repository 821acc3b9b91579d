"""Job feed responses to job rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom import schemas


def read_feed(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(schemas.FEED).option("multiLine", "false").json(path)


def explode_feed(responses: DataFrame) -> DataFrame:
    """One row per job of each response, with its position."""
    kept = [c for c in responses.columns if c not in ("jobs", "totalCount")]
    return responses.select(*kept, F.posexplode("jobs").alias("position", "job")).select(*kept, "position", "job.*")


def _or(col, default):
    return F.coalesce(F.nullif(F.col(col), F.lit("")), F.lit(default))


def ingest_job_feed(feed_jobs: DataFrame, as_of: str, source: str = "feed", keep_source: bool = False) -> DataFrame:
    """Feed jobs as catalogue rows with defaults; an empty string counts as missing.

    ``source`` is the name stored for the feed; with ``keep_source`` the feed's
    own source wins. Dates that cannot be read become null.
    """
    defaults = fixed.FEED_DEFAULTS
    updated = dict(feed_jobs.dtypes)["updated"]
    posted = F.nullif(F.col("updated"), F.lit("")) if updated == "string" else F.col("updated")
    stamp = F.lit(as_of).cast("timestamp")
    posted = F.when(posted.isNull(), stamp).otherwise(F.try_to_timestamp(posted) if updated == "string" else posted)
    rest = [c for c in feed_jobs.columns if c not in schemas.FEED_JOB.fieldNames()]
    return feed_jobs.select(
        *rest, "title", _or("company", defaults["company"]).alias("company"), "location",
        F.col("snippet").alias("description"), F.col("link").alias("url"), posted.alias("posted_date"),
        _or("salary", defaults["salary"]).alias("salary"), F.array().cast("array<string>").alias("tags"),
        (_or("source", source) if keep_source else F.lit(source)).alias("source"),
        F.lit(defaults["experience_required"]).alias("experience_required"),
        _or("type", defaults["job_type"]).alias("job_type"), F.lit(True).alias("is_active"))
