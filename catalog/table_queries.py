"""Queries over the tables: filters, lists, look-ups, upserts, keys and references."""

from pyspark.sql import functions as F

from catalog.inputs import (ANALYSES, AS_OF, FEED, INCOMING_RECOMMENDATIONS, JOBS, NEW_UPLOADS, RECOMMENDATIONS, RESUMES,
                            SIGNUPS, USERS, for_duckdb, load, table)
from vitaloom import fixed_values as fixed
from vitaloom import schemas
from vitaloom.functions.matching import job_age_days
from vitaloom.operators import integrity, jobs as job_ops, recommendations as rec_ops, resumes as resume_ops
from vitaloom.operators.keyword_index import search_many
from vitaloom.session import shared_folder
from vitaloom.sources import feed as feed_source
from vitaloom.sources.buckets import read_buckets, update_buckets, write_buckets
from vitaloom.sources.files import scan_resume_files
from vitaloom.sources.tables import scan_tables, write_scored

QUERIES, SQL = {}, {}
D = for_duckdb


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def day(col):
    return F.col(col).cast("date").cast("string").alias(col)


DAY = "CAST(CAST({0} AS DATE) AS VARCHAR) AS {0}"
JOB_COLUMNS = ["id", "title", "company", "location", "description", "url", "salary", "source", "job_type"]
JOB_LIST = ", ".join(JOB_COLUMNS) + ", " + DAY.format("posted_date")


def jobs(spark, d):
    return table(spark, d, JOBS)


def shown(df):
    return df.select(*JOB_COLUMNS, day("posted_date"))


@query("active_jobs", f"SELECT {JOB_LIST} FROM ({D(JOBS)}) WHERE is_active")
def _(spark, d):
    return shown(job_ops.active_jobs(jobs(spark, d)))


@query("filter_location", f"SELECT {JOB_LIST} FROM ({D(JOBS)}) WHERE lower(location) LIKE '%berlin%' OR lower(location) = 'remote'")
def _(spark, d):
    return shown(job_ops.filter_location(jobs(spark, d), "Berlin", include_remote=True))


@query("filter_keywords", f"SELECT {JOB_LIST} FROM ({D(JOBS)}) WHERE lower(title) LIKE '%data%' OR lower(description) LIKE '%data%'")
def _(spark, d):
    return shown(job_ops.filter_keywords(jobs(spark, d), "Data"))


SEARCHES = "SELECT DISTINCT p_type AS keywords FROM {part} UNION ALL SELECT DISTINCT concat('Requires ', CAST(p_size AS VARCHAR(10)), '+') AS keywords FROM {part}"


@query("search_many", f"""SELECT DISTINCT keywords AS search, id FROM ({D(SEARCHES)}) JOIN ({D(JOBS)})
  ON lower(title) LIKE concat('%', lower(keywords), '%') OR lower(description) LIKE concat('%', lower(keywords), '%')""")
def _(spark, d):
    """Every kind of part and every number of years, searched for in all jobs."""
    return search_many(jobs(spark, d), table(spark, d, SEARCHES))


@query("filter_posted_within", f"SELECT {JOB_LIST} FROM ({D(JOBS)}) WHERE posted_date >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY")
def _(spark, d):
    return shown(job_ops.filter_posted_within(jobs(spark, d), 14, AS_OF))


@query("list_jobs", f"""SELECT {JOB_LIST} FROM ({D(JOBS)}) WHERE is_active AND (lower(location) LIKE '%austin%' OR lower(location) = 'remote')
  AND (lower(title) LIKE '%engineer%' OR lower(description) LIKE '%engineer%') AND posted_date >= TIMESTAMP '{AS_OF}' - INTERVAL 45 DAY
  ORDER BY posted_date DESC NULLS FIRST, id LIMIT 100""")
def _(spark, d):
    return shown(job_ops.list_jobs(jobs(spark, d), AS_OF, "Austin", "engineer", 45))


FEED_COLUMNS = ("title, location, description AS snippet, salary, source, job_type AS type, url AS link, "
                "CAST(CAST(posted_date AS DATE) AS VARCHAR) AS updated, company, CAST(id AS VARCHAR) AS id")


@query("search_jobs", f"""SELECT {FEED_COLUMNS} FROM (SELECT * FROM ({D(JOBS)}) WHERE is_active AND lower(location) LIKE '%new york%'
  AND (lower(title) LIKE '%engineer%' OR lower(description) LIKE '%engineer%') ORDER BY posted_date DESC NULLS FIRST, id LIMIT 50)""")
def _(spark, d):
    return job_ops.search_jobs(jobs(spark, d), "engineer", "New York").withColumn("updated", day("updated"))


@query("job_to_feed_shape", f"SELECT {FEED_COLUMNS} FROM ({D(JOBS)})")
def _(spark, d):
    return job_ops.job_to_feed_shape(jobs(spark, d)).withColumn("updated", day("updated"))


@query("job_age_days", f"SELECT id, round(epoch_us(TIMESTAMP '{AS_OF}' - posted_date) / 86400e6, 6) AS age_days FROM ({D(JOBS)})".replace(
    f"epoch_us(TIMESTAMP '{AS_OF}' - posted_date)", f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(posted_date))"))
def _(spark, d):
    return jobs(spark, d).select("id", F.round(job_age_days(F.col("posted_date"), F.lit(AS_OF)), 6).alias("age_days"))


FEED_ROWS_SQL = f"""SELECT seq, title, coalesce(nullif(company, ''), 'Unknown') AS company, location, snippet AS description, link AS url,
  CASE WHEN coalesce(updated, '') = '' THEN TIMESTAMP '{AS_OF}' ELSE TRY_CAST(updated AS TIMESTAMP) END AS posted_date,
  coalesce(nullif(salary, ''), 'Not specified') AS salary, coalesce(nullif(source, ''), 'feed') AS source,
  'Not specified' AS experience_required, coalesce(nullif(type, ''), 'Full-time') AS job_type, true AS is_active
  FROM ({D(FEED)})"""


def feed_rows(spark, d):
    """The feed as responses with nested jobs, flattened and given defaults."""
    rows = table(spark, d, FEED)
    nested = rows.select("seq", F.lit(1).alias("totalCount"), F.array(F.struct(
        *[c for c in schemas.FEED_JOB.fieldNames()])).alias("jobs"))
    return feed_source.ingest_job_feed(feed_source.explode_feed(nested), AS_OF, keep_source=True).drop("position")


@query("ingest_job_feed", f"""SELECT seq, title, company, location, description, url, {DAY.format('posted_date')}, salary, source,
  experience_required, job_type, is_active, '' AS tags FROM ({FEED_ROWS_SQL})""")
def _(spark, d):
    return feed_rows(spark, d).withColumns({"posted_date": day("posted_date"), "tags": F.array_join("tags", ",")})


CATALOGUE = ["id", "title", "company", "location", "description", "url", "posted_date", "salary", "source", "job_type", "is_active",
             "created_at", "updated_at"]
CATALOGUE_SQL = ", ".join(DAY.format(c) if c in ("posted_date", "created_at", "updated_at") else c for c in CATALOGUE)


def catalogue(df):
    return df.select(*[day(c) if c in ("posted_date", "created_at", "updated_at") else c for c in CATALOGUE])


UPSERTED_SQL = f"""feed AS ({FEED_ROWS_SQL}), old AS ({D(JOBS)}),
news AS (SELECT f.url, l.title, l.company, l.location, l.description, l.salary, l.job_type, f.posted_date, f.source, f.is_active
  FROM (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1) f
  JOIN (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1) l ON f.url = l.url),
merged AS (
  SELECT o.id, CASE WHEN n.url IS NULL THEN o.title ELSE n.title END AS title,
    CASE WHEN n.url IS NULL THEN o.company ELSE n.company END AS company,
    CASE WHEN n.url IS NULL THEN o.location ELSE n.location END AS location,
    CASE WHEN n.url IS NULL THEN o.description ELSE n.description END AS description, o.url, o.posted_date,
    CASE WHEN n.url IS NULL THEN o.salary ELSE n.salary END AS salary, o.source,
    CASE WHEN n.url IS NULL THEN o.job_type ELSE n.job_type END AS job_type, o.is_active, o.created_at,
    CASE WHEN n.url IS NULL THEN o.updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at
  FROM old o LEFT JOIN news n ON o.url = n.url
  UNION ALL
  SELECT NULL, title, company, location, description, url, posted_date, salary, source, job_type, is_active,
    TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}' FROM news WHERE url NOT IN (SELECT url FROM old))"""


@query("upsert_jobs", f"WITH {UPSERTED_SQL} SELECT {CATALOGUE_SQL} FROM merged")
def _(spark, d):
    return catalogue(job_ops.upsert_jobs(jobs(spark, d), feed_rows(spark, d), AS_OF))


@query("touch_updated_at", f"""WITH {UPSERTED_SQL} SELECT CAST(CAST(updated_at AS DATE) AS VARCHAR) AS updated_at, count(*) AS n
  FROM merged GROUP BY 1""")
def _(spark, d):
    feed = feed_rows(spark, d).select("url").distinct().withColumn("_hit", F.lit(True))
    old = job_ops.touch_updated_at(jobs(spark, d).join(feed, "url", "left"), F.col("_hit").isNotNull(), AS_OF)
    new = job_ops.anti_new_jobs(feed, jobs(spark, d)).withColumn("updated_at", F.lit(AS_OF).cast("timestamp"))
    both = old.select(day("updated_at")).unionByName(new.select(day("updated_at")))
    return both.groupBy("updated_at").agg(F.count("*").alias("n"))


@query("anti_new_jobs", f"SELECT seq, url, title FROM ({FEED_ROWS_SQL}) WHERE url NOT IN (SELECT url FROM ({D(JOBS)}))")
def _(spark, d):
    return job_ops.anti_new_jobs(feed_rows(spark, d), jobs(spark, d)).select("seq", "url", "title")


@query("insert_jobs_if_absent", f"""WITH feed AS ({FEED_ROWS_SQL}), old AS ({D(JOBS)}) SELECT {CATALOGUE_SQL} FROM (
  SELECT {', '.join(CATALOGUE)} FROM old UNION ALL
  SELECT NULL, title, company, location, description, url, posted_date, salary, source, job_type, is_active,
    TIMESTAMP '{AS_OF}', TIMESTAMP '{AS_OF}' FROM feed WHERE url NOT IN (SELECT url FROM old)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)""")
def _(spark, d):
    return catalogue(job_ops.insert_jobs_if_absent(jobs(spark, d), feed_rows(spark, d), AS_OF))


@query("dedupe_jobs", f"""SELECT {JOB_LIST} FROM ({D(JOBS)}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY posted_date DESC, id) = 1""")
def _(spark, d):
    newest = jobs(spark, d).withColumn("_age", -F.unix_micros(F.col("posted_date").cast("timestamp")))
    return shown(job_ops.dedupe_jobs(newest, ["_age", "id"], "url"))


@query("combine_jobs", f"""SELECT link, id, title, src FROM (
  SELECT link, id, title, 'feed' AS src, 0 AS rank, seq FROM ({D(FEED)})
  UNION ALL SELECT url, CAST(id AS VARCHAR), title, 'table', 1, id FROM ({D(JOBS)}))
  QUALIFY row_number() OVER (PARTITION BY link ORDER BY rank, seq) = 1""")
def _(spark, d):
    feed = table(spark, d, FEED).select("link", "id", "title", F.lit("feed").alias("src"), "seq")
    stored = job_ops.job_to_feed_shape(jobs(spark, d)).select("link", "id", "title", F.lit("table").alias("src"),
                                                              F.col("id").cast("bigint").alias("seq"))
    return job_ops.combine_jobs(feed, stored, ["seq"]).drop("seq")


# ------------------------------------------------------------------- resumes
RESUME_COLUMNS = ["id", "user_id", "file_name", "is_latest", "status", "analysis", "upload_date", "updated_at"]
RESUME_SQL = ", ".join(DAY.format(c) if c in ("upload_date", "updated_at") else c for c in RESUME_COLUMNS)


def resumes(spark, d):
    return table(spark, d, RESUMES)


def rows(df):
    return df.select(*[day(c) if c in ("upload_date", "updated_at") else c for c in RESUME_COLUMNS])


LATEST_SQL = (f"SELECT * REPLACE (row_number() OVER (PARTITION BY user_id ORDER BY upload_date DESC, id DESC) = 1 AS is_latest) "
              f"FROM ({D(RESUMES)})")


@query("is_latest", f"SELECT {RESUME_SQL} FROM ({LATEST_SQL})")
def _(spark, d):
    return rows(resume_ops.mark_latest(resumes(spark, d)))


@query("latest_resume", f"SELECT {RESUME_SQL} FROM ({LATEST_SQL}) WHERE is_latest")
def _(spark, d):
    return rows(resume_ops.latest_resume(resume_ops.mark_latest(resumes(spark, d))))


@query("resume_by_id", f"SELECT {RESUME_SQL} FROM ({D(RESUMES)}) WHERE id = 42")
def _(spark, d):
    return rows(resume_ops.resume_by_id(resumes(spark, d), 42))


@query("user_resumes", f"SELECT {RESUME_SQL} FROM ({D(RESUMES)}) WHERE user_id = 7")
def _(spark, d):
    return rows(resume_ops.user_resumes(resumes(spark, d), 7))


@query("owned_by", f"SELECT {RESUME_SQL} FROM ({D(RESUMES)}) WHERE user_id = 11")
def _(spark, d):
    return rows(resume_ops.owned_by(resumes(spark, d), 11))


@query("resume_content", f"SELECT text AS content, file_name, {DAY.format('upload_date')}, status FROM ({LATEST_SQL}) WHERE is_latest")
def _(spark, d):
    return resume_ops.resume_content(resume_ops.mark_latest(resumes(spark, d))).withColumn("upload_date", day("upload_date"))


@query("needs_analysis", f"SELECT {RESUME_SQL} FROM ({D(RESUMES)}) WHERE NOT (status = 'processed' AND analysis IS NOT NULL)")
def _(spark, d):
    return rows(resume_ops.needs_analysis(resumes(spark, d)))


@query("add_resume_version", f"""WITH old AS ({D(RESUMES)}), new AS ({D(NEW_UPLOADS)}) SELECT {RESUME_SQL} FROM (
  SELECT id, user_id, file_name, CASE WHEN user_id IN (SELECT user_id FROM new) THEN false ELSE is_latest END AS is_latest, status,
    analysis, upload_date, CASE WHEN is_latest AND user_id IN (SELECT user_id FROM new) THEN TIMESTAMP '{AS_OF}' ELSE updated_at END
    AS updated_at FROM old
  UNION ALL SELECT id, user_id, file_name, row_number() OVER (PARTITION BY user_id ORDER BY upload_date DESC, id DESC) = 1, status,
    analysis, upload_date, updated_at FROM new)""")
def _(spark, d):
    return rows(resume_ops.add_resume_version(resumes(spark, d), table(spark, d, NEW_UPLOADS), AS_OF))


@query("attach_analysis", f"""WITH a AS ({D(ANALYSES)}) SELECT {RESUME_SQL} FROM (SELECT r.id, user_id, file_name, is_latest,
  CASE WHEN a.id IS NULL THEN r.status ELSE a.status END AS status, CASE WHEN a.id IS NULL THEN r.analysis ELSE a.analysis END AS analysis,
  upload_date, CASE WHEN a.id IS NULL THEN updated_at ELSE TIMESTAMP '{AS_OF}' END AS updated_at
  FROM ({D(RESUMES)}) r LEFT JOIN a ON a.id = r.id)""")
def _(spark, d):
    return rows(resume_ops.attach_analysis(resumes(spark, d), table(spark, d, ANALYSES), AS_OF))


# ----------------------------------------------------------- recommendations
REC_COLUMNS = "user_id, resume_id, job_id, CAST(match_score AS DOUBLE) AS match_score, CAST(CAST(created_at AS DATE) AS VARCHAR) AS created_at"


def recs(spark, d):
    return table(spark, d, RECOMMENDATIONS)


def rec_rows(df, *more):
    return df.select("user_id", "resume_id", "job_id", F.col("match_score").cast("double").alias("match_score"), day("created_at"), *more)


@query("filter_min_score", f"SELECT {REC_COLUMNS} FROM ({D(RECOMMENDATIONS)}) WHERE match_score >= 60")
def _(spark, d):
    return rec_rows(job_ops.filter_min_score(recs(spark, d), 60))


@query("user_recommendations", f"""SELECT {REC_COLUMNS.replace('created_at AS', 'r.created_at AS')}, title, url, CAST(rank AS BIGINT) AS rank FROM (
  SELECT r.*, title, url, row_number() OVER (PARTITION BY user_id ORDER BY match_score DESC NULLS FIRST, r.created_at DESC NULLS FIRST,
    resume_id, job_id, line) AS rank
  FROM ({D(RECOMMENDATIONS)}) r JOIN ({D(JOBS)}) j ON r.job_id = j.id WHERE j.is_active) r WHERE rank <= 20""")
def _(spark, d):
    out = rec_ops.user_recommendations(recs(spark, d), jobs(spark, d), tie=["resume_id", "job_id", "line"])
    return rec_rows(out, "title", "url", F.col("rank").cast("bigint").alias("rank"))


RANKED_SQL = f"""SELECT user_id AS resume_id, job_id, CAST(match_score AS DOUBLE) AS match_score, resume_id * 10 + line AS seq, created_at
  FROM ({D(RECOMMENDATIONS)})"""


def ranked(spark, d):
    return recs(spark, d).select(F.col("user_id").alias("resume_id"), "job_id", F.col("match_score").cast("double").alias("match_score"),
                                 (F.col("resume_id") * 10 + F.col("line")).alias("seq"), "created_at")


@query("top_n_per_resume", f"""SELECT resume_id, job_id, match_score, seq, CAST(rank AS BIGINT) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, seq) AS rank FROM ({RANKED_SQL})) WHERE rank <= 20""")
def _(spark, d):
    out = rec_ops.top_n_per_resume(ranked(spark, d), seq="seq")
    return out.withColumn("rank", F.col("rank").cast("bigint")).drop("created_at")


@query("rank_matches", f"""SELECT resume_id, job_id, match_score, seq, CAST(rank AS BIGINT) AS rank FROM (SELECT *,
  row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, seq) AS rank FROM ({RANKED_SQL})
  WHERE match_score >= 50 AND created_at >= TIMESTAMP '1998-01-01' - INTERVAL 700 DAY) WHERE rank <= 20""")
def _(spark, d):
    out = rec_ops.rank_matches(ranked(spark, d), "1998-01-01 00:00:00", 50, 700, posted="created_at", seq="seq")
    return out.withColumn("rank", F.col("rank").cast("bigint")).drop("created_at")


@query("replace_recommendations", f"""WITH old AS ({D(RECOMMENDATIONS)}), new AS ({D(INCOMING_RECOMMENDATIONS)}) SELECT {REC_COLUMNS} FROM (
  SELECT o.* FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.user_id = o.user_id AND n.resume_id = o.resume_id)
  UNION ALL SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY user_id, resume_id, job_id
    ORDER BY line DESC, created_at DESC, match_score DESC) = 1)""")
def _(spark, d):
    incoming = table(spark, d, INCOMING_RECOMMENDATIONS).withColumn("seq", F.struct("line", "created_at", "match_score"))
    return rec_rows(rec_ops.replace_recommendations(recs(spark, d), incoming))


@query("replace_recommendations_stored", SQL["replace_recommendations"])
def _(spark, d):
    """The same on a table in buckets of which only the touched ones are written again."""
    keys, path = ["user_id", "resume_id"], shared_folder(spark, "recommendations")
    stored = recs(spark, d)
    write_buckets(stored, path, keys, 16)
    incoming = table(spark, d, INCOMING_RECOMMENDATIONS).withColumn("seq", F.struct("line", "created_at", "match_score"))
    update_buckets(spark, path, stored.schema, keys, 16, incoming, rec_ops.replace_recommendations)
    return rec_rows(read_buckets(spark, path, stored.schema))


# The same rows, naming their jobs by links of which the catalogue has some.
BY_LINK = f"""SELECT user_id, resume_id, concat('https://jobs.example/', CAST(resume_id % 2500 AS VARCHAR(10))) AS url, match_score, created_at, line, job_id AS part
FROM ({INCOMING_RECOMMENDATIONS}) AS incoming"""


@query("store_recommendations", f"""WITH old AS ({D(RECOMMENDATIONS)}), known AS (SELECT url, min(id) AS id FROM ({D(JOBS)}) GROUP BY url),
new AS (SELECT user_id, resume_id, coalesce(id, -1 - ('0x' || substr(md5(url), 1, 15))::BIGINT) AS job_id, match_score, created_at, line, part
  FROM ({D(BY_LINK)}) LEFT JOIN known USING (url))
SELECT {REC_COLUMNS} FROM (
  SELECT o.* EXCLUDE (line) FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.user_id = o.user_id AND n.resume_id = o.resume_id)
  UNION ALL SELECT * EXCLUDE (line, part) FROM new QUALIFY row_number() OVER (PARTITION BY user_id, resume_id, job_id
    ORDER BY line DESC, created_at DESC, match_score DESC, part DESC) = 1)""")
def _(spark, d):
    incoming = table(spark, d, BY_LINK).withColumn("seq", F.struct("line", "created_at", "match_score", "part"))
    catalogue, kept = rec_ops.store_recommendations(recs(spark, d).drop("line"), incoming, jobs(spark, d), AS_OF)
    # every stored job of the incoming rows is in the new catalogue
    return rec_rows(kept)


@query("write_scored", f"""SELECT user_id, count(*) AS n, CAST(sum(match_score) AS DOUBLE) AS total FROM ({D(RECOMMENDATIONS)}) GROUP BY user_id""")
def _(spark, d):
    path = shared_folder(spark, "scored")
    out = recs(spark, d).withColumn("reasons", F.array(F.lit("stored"))).withColumn("month", F.month("created_at"))
    write_scored(out, path, ["month"], as_json=True)
    stored = spark.read.schema("user_id BIGINT, match_score DECIMAL(5,2), reasons STRING, month INT").parquet(path)
    return stored.where("reasons = '[\"stored\"]'").groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum("match_score").cast("double").alias("total"))


APPLICATIONS = """
SELECT o_orderkey AS id, o_custkey AS user_id, CAST(o_orderkey % 100 AS DECIMAL(5,2)) AS match_score, CAST(o_orderdate AS TIMESTAMP) AS applied_date,
  o_orderstatus AS status FROM {orders}"""
# Each table with its whole numbers, decimals and times: table, input, sum of, decimals, latest of.
SCANNED = [("users", USERS, "id", None, None), ("resumes", RESUMES, "user_id", None, "upload_date"), ("jobs", JOBS, "id", None, "posted_date"),
           ("job_applications", APPLICATIONS, "user_id", "match_score", "applied_date"), ("job_recommendations", RECOMMENDATIONS, "job_id", "match_score", "created_at")]


@query("scan_tables", " UNION ALL ".join(
    f"""SELECT '{name}' AS name, count(*) AS n, CAST(sum({key}) AS BIGINT) AS keys, {f'CAST(sum({points}) AS DOUBLE)' if points else 'CAST(NULL AS DOUBLE)'} AS points,
  {f"CAST(epoch(max({last})) AS BIGINT)" if last else 'CAST(NULL AS BIGINT)'} AS latest FROM ({D(sql)})""" for name, sql, key, points, last in SCANNED))
def _(spark, d):
    path, out = shared_folder(spark, "tables"), None
    for name, sql, *_ in SCANNED:
        df = table(spark, d, sql)
        df.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TABLES[name] if f.name in df.columns]).write.parquet(f"{path}/{name}")
    found = scan_tables(spark, path)
    for name, _, key, points, last in SCANNED:
        one = found[name].agg(F.count("*").alias("n"), F.sum(key).alias("keys"), (F.sum(points) if points else F.lit(None)).cast("double").alias("points"),
                              (F.unix_seconds(F.max(last)) if last else F.lit(None)).cast("bigint").alias("latest")).select(F.lit(name).alias("name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("scan_resume_files", "SELECT lang, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang")
def _(spark, d):
    path = shared_folder(spark, "files")
    load(spark, d, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    files = scan_resume_files(spark, path, glob="*.txt", max_bytes=1 << 40)
    return files.groupBy(F.regexp_extract("file_path", "/lang=([^/]*)/", 1).alias("lang")).agg(F.sum("length").alias("bytes"))


# ------------------------------------------------------------ keys, accounts
DELETED_USERS = "SELECT s_suppkey AS id FROM {supplier} WHERE s_acctbal < 0"
DELETED_RESUMES = "SELECT o_orderkey AS id FROM {orders} WHERE o_orderstatus = 'F'"


@query("orphans", f"""SELECT {REC_COLUMNS} FROM ({D(RECOMMENDATIONS)}) WHERE resume_id NOT IN (SELECT c_custkey FROM customer)""")
def _(spark, d):
    return rec_rows(integrity.orphans(recs(spark, d), "resume_id", resumes(spark, d)))


@query("cascade_delete", f"""SELECT user_id, CASE WHEN resume_id IN ({D(DELETED_RESUMES)}) THEN NULL ELSE resume_id END AS resume_id, job_id,
  CAST(match_score AS DOUBLE) AS match_score FROM ({D(RECOMMENDATIONS)}) WHERE user_id NOT IN ({D(DELETED_USERS)})""")
def _(spark, d):
    kept = integrity.cascade_delete(recs(spark, d), "user_id", table(spark, d, DELETED_USERS))
    out = integrity.cascade_delete(kept, "resume_id", table(spark, d, DELETED_RESUMES), set_null=True)
    return out.select("user_id", "resume_id", "job_id", F.col("match_score").cast("double").alias("match_score"))


@query("duplicate_keys", f"SELECT user_id, job_id, count(*) AS n FROM ({D(RECOMMENDATIONS)}) GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return integrity.duplicate_keys(recs(spark, d), "user_id", "job_id")


@query("existing_account", f"""SELECT s.id, lower(s.email) AS email, s.username FROM ({D(SIGNUPS)}) s WHERE EXISTS (
  SELECT 1 FROM ({D(USERS)}) u WHERE u.email = lower(s.email) AND u.username = s.username)""")
def _(spark, d):
    return integrity.existing_account(table(spark, d, SIGNUPS), table(spark, d, USERS)).select("id", "email", "username")


@query("last_login", "SELECT user_id, CAST(max(ts) AS VARCHAR) AS last_login FROM events GROUP BY user_id".replace(
    "CAST(max(ts) AS VARCHAR)", "epoch_us(max(ts))"))
def _(spark, d):
    out = integrity.last_login(load(spark, d, "events").select("user_id", "ts"))
    return out.select("user_id", F.unix_micros(F.col("last_login").cast("timestamp")).alias("last_login"))
