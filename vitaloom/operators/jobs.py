"""Job catalogue: filters, lists, dedupe and url-keyed upserts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed

FEED_SHAPE = {"title": "title", "location": "location", "description": "snippet", "salary": "salary",
              "source": "source", "job_type": "type", "url": "link", "posted_date": "updated", "company": "company"}
# Columns an upsert overwrites; the others keep the value of the first insert.
UPDATED_COLUMNS = ["title", "company", "location", "description", "salary", "job_type"]


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where("is_active")


def _contains_pattern(col: str, words: str) -> Column:
    return F.lower(F.col(col)).like(f"%{words.lower()}%")


def filter_location(jobs: DataFrame, location: str | None, include_remote: bool = False) -> DataFrame:
    """Rows whose location contains the words (``%`` and ``_`` are wildcards), optionally also remote ones."""
    if not location:
        return jobs
    match = _contains_pattern("location", location)
    return jobs.where(match | (F.lower("location") == "remote") if include_remote else match)


def filter_keywords(jobs: DataFrame, keywords: str | None) -> DataFrame:
    """Rows whose title or description contains the whole keyword string."""
    if not keywords:
        return jobs
    return jobs.where(_contains_pattern("title", keywords) | _contains_pattern("description", keywords))


def filter_posted_within(jobs: DataFrame, days: int | None, as_of: str, posted: str = "posted_date") -> DataFrame:
    """Rows posted in the last ``days`` days; strings that are no date are dropped."""
    if not days:
        return jobs
    when = F.col(posted)
    if dict(jobs.dtypes)[posted] == "string":
        when = F.try_to_timestamp(when)
    cutoff = F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(int(days)))
    # compare in the column's own type so that the filter reaches the scan
    return jobs.where(when >= (cutoff.cast("timestamp_ntz") if dict(jobs.dtypes)[posted] == "timestamp_ntz" else cutoff))


def filter_min_score(matches: DataFrame, min_score: float | None, score: str = "match_score") -> DataFrame:
    return matches.where(F.col(score) >= min_score) if min_score else matches


def job_to_feed_shape(jobs: DataFrame) -> DataFrame:
    return jobs.select(*[F.col(a).alias(b) for a, b in FEED_SHAPE.items()], F.col("id").cast("string").alias("id"))


def _newest(jobs: DataFrame, limit: int | None) -> DataFrame:
    """The newest ``limit`` jobs; ``None`` keeps all, in no order."""
    if limit is None:
        return jobs
    return jobs.orderBy(F.desc_nulls_first("posted_date"), F.asc("id")).limit(limit)


def list_jobs(jobs: DataFrame, as_of: str, location=None, keywords=None, days_posted=None,
              limit: int = fixed.LIST_LIMIT) -> DataFrame:
    """Newest active jobs after the filters."""
    kept = filter_location(active_jobs(jobs), location, include_remote=True)
    return _newest(filter_posted_within(filter_keywords(kept, keywords), days_posted, as_of), limit)


def search_jobs(jobs: DataFrame, keywords=None, location=None, limit: int | None = fixed.SEARCH_LIMIT) -> DataFrame:
    """Newest active jobs for a search, in feed shape; remote jobs get no special treatment."""
    found = filter_location(filter_keywords(active_jobs(jobs), keywords), location)
    return job_to_feed_shape(_newest(found, limit))


def dedupe_jobs(jobs: DataFrame, order: list[str], key: str = "link") -> DataFrame:
    """First row per link in the given order.

    ``min_by`` combines on the map side, so a link that holds a large share of
    the rows reaches its reducer as one row per task. Rows without a link are
    one group, like any other value.
    """
    row = F.struct(*[c for c in jobs.columns if c != key])
    first = jobs.groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return first.select(*[F.col(key) if c == key else F.col("_row")[c].alias(c) for c in jobs.columns])


def link_id(link) -> Column:
    """Id of a job known by its link alone: negative, so it meets no id of the table, and the same wherever it is computed."""
    digits = F.substring(F.md5(link.cast("binary")), 1, 15)
    return F.lit(-1) - F.conv(digits, 16, 10).cast("bigint")


def combine_jobs(feed: DataFrame, table: DataFrame, order: list[str], key: str = "link") -> DataFrame:
    """Feed rows, then table rows whose link the feed does not have."""
    ranked = feed.withColumn("_src", F.lit(0)).unionByName(table.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return dedupe_jobs(ranked, ["_src", *order], key).drop("_src")


def anti_new_jobs(incoming: DataFrame, jobs: DataFrame) -> DataFrame:
    """Incoming rows whose url the catalogue does not have; a row without a url is always new."""
    known = jobs.select("url").where("url IS NOT NULL").distinct()
    return incoming.join(known, "url", "left_anti")


def touch_updated_at(df: DataFrame, changed: Column, as_of: str) -> DataFrame:
    """Stamp ``updated_at`` on the rows that changed."""
    stamp = F.lit(as_of).cast(df.schema["updated_at"].dataType)
    return df.withColumn("updated_at", F.when(changed, stamp).otherwise(F.col("updated_at")))


def _one_per_url(incoming: DataFrame, seq: str) -> DataFrame:
    """Per url: inserted columns of the first row, updated columns of the last row, the stamps of both, and how many rows came."""
    first = F.struct(*[c for c in incoming.columns if c not in ("url", *UPDATED_COLUMNS)])
    last = F.struct(*UPDATED_COLUMNS, F.col("_stamp").alias("_last_stamp"))
    grouped = incoming.groupBy("url").agg(F.min_by(first, F.col(seq)).alias("_first"),
                                          F.max_by(last, F.col(seq)).alias("_last"), F.count("*").alias("_times"))
    return grouped.select("url", "_first.*", "_last.*", "_times")


def upsert_jobs(jobs: DataFrame, incoming: DataFrame, as_of: str | None = None, seq: str = "seq", stamp: str | None = None) -> DataFrame:
    """Catalogue after storing the incoming rows in ``seq`` order.

    Known urls change only the updated columns; new urls are inserted once, with
    later rows of the same batch applied as updates. Changes are stamped with
    ``as_of``, or each row with its own time in the column ``stamp``. The incoming
    side has one row per url before the join, so only the catalogue side can be
    skewed, and adaptive execution splits that side of a left join.
    """
    kind = jobs.schema["updated_at"].dataType
    incoming = incoming.withColumn("_stamp", (F.lit(as_of) if stamp is None else F.col(stamp)).cast(kind))
    news = _one_per_url(incoming.where("url IS NOT NULL"), seq)
    changed = [*UPDATED_COLUMNS, "updated_at"]
    fresh_values = news.select("url", F.struct(*UPDATED_COLUMNS, F.col("_last_stamp").alias("updated_at")).alias("_new"))
    joined = jobs.join(fresh_values, "url", "left")
    hit = F.col("_new").isNotNull()
    updated = joined.select(*[F.when(hit, F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns])
    # rows without a url never meet a known one, so each is inserted on its own
    keyless = incoming.where("url IS NULL").withColumns({"_times": F.lit(1), "_last_stamp": F.col("_stamp")})
    inserted = anti_new_jobs(news.unionByName(keyless.select(*news.columns)), jobs)
    inserted = inserted.withColumns({"created_at": F.col("_stamp"), "updated_at": F.col("_last_stamp")})
    return updated.unionByName(inserted.select(*[F.col(c).cast(jobs.schema[c].dataType).alias(c)
                                                 if c in inserted.columns else
                                                 F.lit(None).cast(jobs.schema[c].dataType).alias(c)
                                                 for c in jobs.columns]))


def insert_jobs_if_absent(jobs: DataFrame, incoming: DataFrame, as_of: str, seq: str = "seq") -> DataFrame:
    """Catalogue plus the first incoming row of each unseen url; nothing is updated."""
    unseen = anti_new_jobs(incoming, jobs)
    first = dedupe_jobs(unseen.where("url IS NOT NULL"), [seq], "url").unionByName(unseen.where("url IS NULL"))
    stamp = F.lit(as_of).cast(jobs.schema["updated_at"].dataType)
    first = first.withColumns({"created_at": stamp, "updated_at": stamp})
    return jobs.unionByName(first.select(*[F.col(c) for c in jobs.columns if c in first.columns]),
                            allowMissingColumns=True)
