"""Inputs of the registered queries: plain SQL projections of the given tables.

The same text runs on both engines; ``{name}`` stands for a table.
"""

import re

from pyspark.sql import DataFrame, SparkSession

SPREAD = "spark.vitaloom.inputs.spread"
TASKS_OF_CORE = 4
AS_OF = "2024-03-01 00:00:00"

JOBS = """
SELECT p_partkey AS id,
  CASE p_partkey % 8 WHEN 0 THEN 'Senior Software Engineer' WHEN 1 THEN 'Junior Developer' WHEN 2 THEN 'Data Analyst'
    WHEN 3 THEN 'Software Engineer' WHEN 4 THEN 'Engineering Manager' WHEN 5 THEN 'Summer Intern'
    WHEN 6 THEN 'Cloud Architect' ELSE 'Product Owner' END AS title,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS company,
  CASE p_partkey % 5 WHEN 0 THEN 'Remote' WHEN 1 THEN 'New York, NY' WHEN 2 THEN 'Berlin'
    WHEN 3 THEN 'Pune, India' ELSE 'Austin, TX' END AS location,
  concat('We use ', CASE p_partkey % 4 WHEN 0 THEN 'Python and Docker' WHEN 1 THEN 'Java and Kafka'
    WHEN 2 THEN 'React and TypeScript' ELSE 'SQL and Spark' END,
    '. Requires ', CAST(1 + p_size % 12 AS VARCHAR(10)), '+ years. ', p_name, ' ', p_type) AS description,
  concat('https://jobs.example/', CAST(p_partkey % 1500 AS VARCHAR(10))) AS url,
  CAST('2024-01-01' AS TIMESTAMP) + (p_partkey % 60) * INTERVAL '1' DAY AS posted_date,
  CASE WHEN p_size % 3 = 0 THEN 'Not specified'
    ELSE concat('$', CAST(CAST(floor(p_retailprice) AS INT) AS VARCHAR(10))) END AS salary,
  'feed' AS source, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'Full-time' END AS job_type,
  p_partkey % 10 <> 0 AS is_active,
  CAST('2024-01-01' AS TIMESTAMP) AS created_at, CAST('2024-01-02' AS TIMESTAMP) AS updated_at
FROM {part}"""

RESUMES = """
SELECT c_custkey AS id, c_custkey % 100 AS user_id,
  CAST('2024-01-01' AS TIMESTAMP) + (c_custkey % 90) * INTERVAL '1' DAY AS upload_date,
  concat(CASE c_custkey % 3 WHEN 0 THEN 'Jane Doe' WHEN 1 THEN 'Ravi Kumar' ELSE '12 Main St' END, chr(10),
    CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('u', CAST(c_custkey AS VARCHAR(10)), '@mail.example.com') END, chr(10),
    CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '+1 (743) 555-3824' END, chr(10),
    CASE WHEN c_custkey % 6 = 0 THEN 'github.com/user1' ELSE 'linkedin.com/in/user1' END, chr(10),
    'Summary', chr(10), 'Engineer seeking a role in ', c_mktsegment, chr(10),
    'Experience', chr(10), 'Acme Corp - Engineer Jan 2018 - Mar ', CAST(2019 + c_custkey % 6 AS VARCHAR(10)), chr(10),
    repeat(concat('- Developed and led ', CAST(c_custkey % 13 AS VARCHAR(10)), ' projects, reduced cost by ',
      CAST(c_custkey % 40 AS VARCHAR(10)), '%', chr(10)), CAST(c_custkey % 9 AS INT)),
    repeat(concat('* Managed the roadmap', chr(10)), CAST(c_custkey % 4 AS INT)),
    CASE WHEN c_custkey % 2 = 0 THEN concat('Education', chr(10),
      'Example State University, Bachelor of Computer Science, 2016', chr(10)) ELSE '' END,
    CASE WHEN c_custkey % 3 = 0 THEN concat('Projects', chr(10), 'Tracker | Python, React', chr(10),
      '- Built api for 500+ users', chr(10)) ELSE '' END,
    'Skills', chr(10), CASE c_custkey % 4 WHEN 0 THEN 'python, docker, sql, spark, java'
      WHEN 1 THEN 'react, typescript, node.js' WHEN 2 THEN 'java, kafka, aws, leadership, agile, git'
      ELSE 'communication' END) AS text,
  concat('cv', CAST(c_custkey AS VARCHAR(10)), '.pdf') AS file_name,
  c_custkey % 100 < 50 AND c_custkey % 7 = 0 AS is_latest,
  CASE c_custkey % 3 WHEN 0 THEN 'processed' WHEN 1 THEN 'uploaded' ELSE 'pending' END AS status,
  CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment ELSE NULL END AS analysis,
  CAST('2024-01-01' AS TIMESTAMP) + (c_custkey % 90) * INTERVAL '1' DAY AS created_at,
  CAST('2024-01-02' AS TIMESTAMP) AS updated_at
FROM {customer}"""

RECOMMENDATIONS = """
SELECT l_suppkey AS user_id, l_orderkey AS resume_id, l_partkey AS job_id,
  CAST(l_quantity * 2 - l_discount * 100 AS DECIMAL(5,2)) AS match_score, l_shipdate AS created_at,
  l_linenumber AS line
FROM {lineitem}"""

# Every resume and every document, as whole texts.
CORPUS = f"""
SELECT concat('r', CAST(id AS VARCHAR(20))) AS doc_id, id AS number, text FROM ({RESUMES}) AS resumes
UNION ALL SELECT concat('d', CAST(doc_id AS VARCHAR(20))) AS doc_id, doc_id AS number, text FROM {{documents}}"""

# Every job, and every document as an untitled job.
JOB_TEXTS = f"""
SELECT concat('j', CAST(id AS VARCHAR(20))) AS doc_id, title, description FROM ({JOBS}) AS jobs
UNION ALL SELECT concat('d', CAST(doc_id AS VARCHAR(20))) AS doc_id, '' AS title, text AS description FROM {{documents}}"""

# What the job feed sends: known and new links, several times, with gaps in the fields.
FEED = """
SELECT o_orderkey AS seq, concat('Role ', o_orderpriority) AS title,
  CASE WHEN o_orderkey % 4 = 0 THEN 'Remote' ELSE 'Berlin' END AS location,
  concat('Work on ', o_orderstatus, ' orders worth ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR(20))) AS snippet,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE '$100' END AS salary,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'board' END AS source,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Contract' END AS type,
  concat('https://jobs.example/', CAST(o_orderkey % 3000 + 700 AS VARCHAR(10))) AS link,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'soon'
    ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) END AS updated,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Initech' END AS company,
  CAST(o_orderkey AS VARCHAR(20)) AS id
FROM {orders}"""

NEW_UPLOADS = """
SELECT o_orderkey + 1000000000 AS id, o_custkey % 150 + 40 AS user_id,
  CAST('2024-02-01' AS TIMESTAMP) + (o_orderkey % 20) * INTERVAL '1' DAY AS upload_date, o_orderstatus AS text,
  'new.pdf' AS file_name, true AS is_latest, 'uploaded' AS status, CAST(NULL AS VARCHAR(10)) AS analysis,
  CAST('2024-02-01' AS TIMESTAMP) AS created_at, CAST('2024-02-01' AS TIMESTAMP) AS updated_at
FROM {orders}"""

ANALYSES = """
SELECT o_custkey AS id, 'processed' AS status,
  CASE WHEN max(o_orderkey) % 4 = 0 THEN NULL ELSE max(o_orderpriority) END AS analysis
FROM {orders} GROUP BY o_custkey"""

INCOMING_RECOMMENDATIONS = """
SELECT l_suppkey AS user_id, CASE WHEN l_returnflag = 'R' THEN l_orderkey ELSE l_orderkey + 100000000 END AS resume_id,
  l_partkey % 3 AS job_id, CAST(l_quantity AS DECIMAL(5,2)) AS match_score, l_shipdate AS created_at,
  l_linenumber AS line
FROM {lineitem}"""

USERS = """
SELECT c_custkey AS id, c_name AS username, concat('u', CAST(c_custkey AS VARCHAR(10)), '@mail.example.com') AS email
FROM {customer}"""
SIGNUPS = """
SELECT o_orderkey AS id, concat('U', CAST(o_custkey AS VARCHAR(10)), '@Mail.example.com') AS email,
  CASE WHEN o_orderstatus = 'F' THEN c_name ELSE 'someone' END AS username
FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""

# Which resume was shown which job.
PAIRS = "SELECT DISTINCT o_custkey AS resume_id, l_partkey AS job_id FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"

# Resumes with a quality score and a level that do not depend on the text, and the encoder's vectors.
PEOPLE = f"""
SELECT r.id, r.text, r.ats_score, r.candidate_level, CASE WHEN r.id % 11 = 3 THEN NULL ELSE e.embedding END AS vector FROM (
  SELECT id, text, CASE WHEN id % 13 = 5 THEN NULL ELSE CAST(floor((c_acctbal + 1000) / 110) AS DOUBLE) END AS ats_score,
    CASE WHEN id % 17 = 2 THEN NULL ELSE CASE id % 6 WHEN 0 THEN 'student' WHEN 1 THEN 'entry' WHEN 2 THEN 'mid' WHEN 3 THEN 'senior' WHEN 4 THEN 'principal'
      ELSE 'intern' END END AS candidate_level, id % (SELECT count(*) FROM {{embeddings}}) AS vec
  FROM ({RESUMES}) AS resumes JOIN {{customer}} ON id = c_custkey) AS r
JOIN {{embeddings}} AS e ON e.vec_id = r.vec"""
JOB_VECTORS = """
SELECT j.job_id, CASE WHEN j.job_id % 19 = 4 THEN NULL ELSE e.embedding END AS vector FROM (
  SELECT p_partkey AS job_id, (p_partkey * 7 + 3) % (SELECT count(*) FROM {embeddings}) AS vec FROM {part}) AS j
JOIN {embeddings} AS e ON e.vec_id = j.vec"""
CORPUS_VECTORS = f"""
SELECT c.doc_id, c.text, CASE WHEN c.number % 11 = 3 THEN NULL ELSE e.embedding END AS vector FROM (
  SELECT doc_id, text, number, number % (SELECT count(*) FROM {{embeddings}}) AS vec FROM ({CORPUS}) AS corpus) AS c
JOIN {{embeddings}} AS e ON e.vec_id = c.vec"""

def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"{(\w+)}", sql)))


def for_duckdb(sql: str) -> str:
    return sql.format(**{t: t for t in tables_of(sql)})


def load(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """One given table. The rows of text tables are dealt to ``SPREAD`` tasks, or to ``TASKS_OF_CORE`` for each core and no
    fewer than the table has splits: a file is small beside the texts and the work that come of it, and all its rows may lie
    in one split. With a ``key`` they are dealt by it, so that two sides of a join lie together."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in ("customer", "documents", "part"):
        return df
    tasks = spark.conf.get(SPREAD, None)
    tasks = int(tasks) if tasks else max(TASKS_OF_CORE * spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    return df.repartition(tasks, key) if key else df.repartition(tasks)


def table(spark: SparkSession, sf_dir: str, sql: str, merge: str | None = None, **keys: str) -> DataFrame:
    """Run an input projection on Spark; ``keys`` are those of :func:`load`, by table. The table ``merge`` is not sent to all
    tasks: its file may be small and its rows, in memory, too large for a driver."""
    tables = {t: load(spark, sf_dir, t, keys.get(t)) for t in tables_of(sql)}
    return spark.sql(sql, **{t: df.hint("merge") if t == merge else df for t, df in tables.items()})
