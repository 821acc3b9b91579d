"""The streaming forms, run over the given tables until the input is used up."""

from pyspark.sql import functions as F

from catalog import match_queries, table_queries
from catalog.inputs import AS_OF, FEED, JOBS, table, tables_of
from vitaloom.plans.analyze import analyze_resumes
from vitaloom.session import is_folder, shared_folder
from vitaloom.sources.feed import ingest_job_feed
from vitaloom.streaming import streams

QUERIES, SQL = {}, {}
DOCUMENTS = "SELECT CAST(doc_id AS VARCHAR(20)) AS doc_id, text FROM {documents}"


def source(spark, d, name):
    """A given table as a stream of files, be it one file or a folder of many."""
    path = f"{d}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    # a stream reads folders: a table of one file is that file of the folder around it
    return stream.parquet(path) if is_folder(spark, path) else stream.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def streamed(spark, d, sql, stream):
    """An input projection with one table read as a stream and the others as tables."""
    frames = {t: source(spark, d, t) if t == stream else spark.read.parquet(f"{d}/{t}.parquet") for t in tables_of(sql)}
    return spark.sql(sql, **frames)


def logged(spark, stream, mode="append"):
    """Run a stream to its end and return its log."""
    path = shared_folder(spark, "log")
    streams.write_log(stream, path, shared_folder(spark, "stream"), mode, once=True).awaitTermination()
    return streams.read_log(spark, path, stream)


def _upsert(spark, d):
    feed = ingest_job_feed(streamed(spark, d, FEED, "orders"), AS_OF, keep_source=True)
    return table_queries.catalogue(streams.catalogue_with_log(table_queries.jobs(spark, d), logged(spark, feed), AS_OF))


def _dedupe(spark, d):
    jobs = streamed(spark, d, JOBS, "part").withColumn("posted_date", F.col("posted_date").cast("timestamp"))
    return logged(spark, streams.stream_dedupe_jobs(jobs.select("url", "posted_date"))).select("url")


def _analyze(spark, d):
    docs = streamed(spark, d, DOCUMENTS, "documents")
    return match_queries.flat_analysis(logged(spark, analyze_resumes(docs)))


def _last_login(spark, d):
    logins = source(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = streams.last_login_from_log(logged(spark, streams.stream_last_login(logins), "update"))
    return out.select("user_id", F.unix_micros("last_login").alias("last_login"))


QUERIES["stream_upsert_jobs"] = _upsert
SQL["stream_upsert_jobs"] = table_queries.SQL["upsert_jobs"]
QUERIES["stream_dedupe_jobs"] = _dedupe
SQL["stream_dedupe_jobs"] = "SELECT DISTINCT concat('https://jobs.example/', CAST(p_partkey % 1500 AS VARCHAR)) AS url FROM part"
QUERIES["stream_last_login"] = _last_login
SQL["stream_last_login"] = table_queries.SQL["last_login"]
QUERIES["stream_analyze"] = _analyze
SQL["stream_analyze"] = match_queries.analysis_sql(match_queries.rules_scored_sql(DOCUMENTS))


def _batches(spark, d, run):
    """The feed in five batches, by priority: each is appended to an inbox and the stream runs until it is used up."""
    inbox = shared_folder(spark, "inbox")
    rows = table(spark, d, FEED).withColumn("priority", F.substring("title", 6, 1).cast("int"))
    for priority in range(1, 6):
        rows.where(F.col("priority") == priority).write.mode("append").parquet(inbox)
        run(spark.readStream.schema(rows.schema).parquet(inbox), priority)


STAMP = f"TIMESTAMP '{AS_OF}' + to_days(priority)"


def _compacted(spark, d):
    """The upsert log of five batches, compacted on the way, with the time of each batch."""
    log, state, base = (shared_folder(spark, n) for n in ("log", "stream", "base"))
    jobs, like = table_queries.jobs(spark, d), []

    def run(stream, priority):
        feed = ingest_job_feed(stream, AS_OF, keep_source=True).withColumn("stamp", F.expr(f"TIMESTAMP '{AS_OF}' + make_dt_interval(priority)"))
        streams.stream_upsert_jobs(feed, log, state, once=True).awaitTermination()
        like[:] = [feed]
        if priority in (2, 4):
            streams.compact_log(spark, log, base, jobs, feed, stamp="stamp")

    _batches(spark, d, run)
    return table_queries.catalogue(streams.current_catalogue(spark, log, base, jobs, like[0], stamp="stamp"))


def _new_jobs(spark, d):
    """First rows of links that neither the catalogue nor an earlier batch has."""
    log, state = shared_folder(spark, "log"), shared_folder(spark, "stream")
    known, like = table_queries.jobs(spark, d).select("url"), []

    def run(stream, priority):
        feed = ingest_job_feed(stream, AS_OF, keep_source=True)
        streams.write_new_jobs(feed, log, state, known, order=("seq",), once=True).awaitTermination()
        like[:] = [feed]

    _batches(spark, d, run)
    return streams.read_log(spark, log, like[0]).select("seq", "url", "title", "location", "salary", "batch_id")


BY_BATCH = table_queries.UPSERTED_SQL.replace(
    f"feed AS ({table_queries.FEED_ROWS_SQL})", f"feed AS (SELECT *, {STAMP} AS stamp FROM (SELECT *, CAST(title[6:6] AS INT) AS priority FROM ({table_queries.FEED_ROWS_SQL})))").replace(
    "ORDER BY seq)", "ORDER BY priority, seq)").replace("ORDER BY seq DESC)", "ORDER BY priority DESC, seq DESC)").replace(
    "f.posted_date, f.source, f.is_active\n", "f.posted_date, f.source, f.is_active, f.stamp AS first_stamp, l.stamp AS last_stamp\n").replace(
    f"ELSE TIMESTAMP '{AS_OF}' END AS updated_at", "ELSE last_stamp END AS updated_at").replace(
    f"TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}' FROM news", "first_stamp, last_stamp FROM news")
QUERIES["stream_upsert_compacted"] = _compacted
SQL["stream_upsert_compacted"] = f"WITH {BY_BATCH} SELECT {table_queries.CATALOGUE_SQL} FROM merged"
QUERIES["stream_new_jobs"] = _new_jobs
SQL["stream_new_jobs"] = f"""SELECT seq, url, title, location, salary, CAST(title[6:6] AS BIGINT) - 1 AS batch_id FROM ({table_queries.FEED_ROWS_SQL})
WHERE url NOT IN (SELECT url FROM ({table_queries.D(JOBS)})) QUALIFY row_number() OVER (PARTITION BY url ORDER BY title, seq) = 1"""
