"""Table operators: upserts, versions, keys, ranking, sources."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from vitaloom.operators import integrity, jobs as J, recommendations as R, resumes as S
from vitaloom.sources import feed as feed_source
from vitaloom.sources.files import scan_resume_files
from vitaloom.sources.tables import json_columns, scan_table, write_scored

AS_OF = "2024-03-01 00:00:00"
OLD = dt.datetime(2024, 1, 1)
NOW = dt.datetime(2024, 3, 1)
JOB = ("id bigint, title string, company string, location string, description string, url string, posted_date timestamp, "
       "salary string, source string, job_type string, is_active boolean, created_at timestamp, updated_at timestamp")


def job(i, url, title="T", posted=OLD, location="Berlin", description="D", active=True):
    return (i, title, "C", location, description, url, posted, "S", "src", "Full-time", active, OLD, OLD)


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.createDataFrame([job(1, "a"), job(2, "b", title="Keep"), job(3, None)], JOB)


@pytest.fixture(scope="module")
def incoming(spark):
    rows = [(1, "a", "first", "2024-02-01", "x"), (2, "a", "last", "2024-02-02", "y"), (3, "n", "new1", "2024-02-03", "x"),
            (4, "n", "new2", "2024-02-04", "y"), (5, None, "loose", "2024-02-05", "x")]
    df = spark.createDataFrame(rows, "seq int, url string, title string, posted string, source string")
    return df.select("seq", "url", "title", F.lit("IC").alias("company"), F.lit("IL").alias("location"), F.lit("ID").alias("description"),
                     F.to_timestamp("posted").alias("posted_date"), F.lit("IS").alias("salary"), "source",
                     F.lit("IT").alias("job_type"), F.lit(True).alias("is_active"))


def test_upsert_updates_some_columns_and_inserts_from_the_first_row(catalogue, incoming):
    got = {(r["url"], r["id"]): r for r in J.upsert_jobs(catalogue, incoming, AS_OF).collect()}
    assert set(got) == {("a", 1), ("b", 2), (None, 3), ("n", None), (None, None)}
    a, n = got["a", 1], got["n", None]
    assert (a["title"], a["company"], a["posted_date"], a["source"], a["created_at"], a["updated_at"]) == ("last", "IC", OLD, "src", OLD, NOW)
    assert (n["title"], n["posted_date"], n["source"]) == ("new2", dt.datetime(2024, 2, 3), "x")   # dates and source of the insert
    assert got["b", 2]["updated_at"] == OLD and got["b", 2]["title"] == "Keep"


def test_upsert_is_idempotent_by_url(catalogue, incoming):
    keyed = incoming.where("url IS NOT NULL")
    once = J.upsert_jobs(catalogue, keyed, AS_OF)
    twice = J.upsert_jobs(once, keyed, AS_OF)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_upsert_with_a_hot_url(spark, incoming):
    """A third of the catalogue has one url: the join is split, and no row is lost."""
    jobs = spark.range(6000).select(
        "id", F.lit("T").alias("title"), F.lit("C").alias("company"), F.lit("L").alias("location"), F.repeat(F.lit("d"), 50).alias("description"),
        F.when(F.col("id") % 3 == 0, "a").otherwise(F.col("id").cast("string")).alias("url"), F.lit(OLD).alias("posted_date"),
        F.lit("S").alias("salary"), F.lit("src").alias("source"), F.lit("t").alias("job_type"), F.lit(True).alias("is_active"),
        F.lit(OLD).alias("created_at"), F.lit(OLD).alias("updated_at"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = J.upsert_jobs(jobs.repartition(8), incoming.where("url = 'a'"), AS_OF)
        assert got.groupBy("title").count().orderBy("title").collect() == [("T", 4000), ("last", 2000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_insert_if_absent_never_updates(catalogue, incoming):
    got = {(r["url"], r["title"]) for r in J.insert_jobs_if_absent(catalogue, incoming, AS_OF).collect()}
    assert got == {("a", "T"), ("b", "Keep"), (None, "T"), ("n", "new1"), (None, "loose")}


def test_dedupe_and_combine_keep_the_first(spark):
    feed = spark.createDataFrame([("x", "f1", 1), ("x", "f2", 2), (None, "f3", 3)], "link string, t string, seq int")
    table = spark.createDataFrame([("x", "t1", 0), ("y", "t2", 1), (None, "t3", 2)], "link string, t string, seq int")
    assert {(r["link"], r["t"]) for r in J.combine_jobs(feed, table, ["seq"]).collect()} == {("x", "f1"), ("y", "t2"), (None, "f3")}


def test_job_filters(spark):
    rows = [job(1, "a", location="Remote"), job(2, "b", location="New York"), job(3, "c", location="Berlin", active=False),
            job(4, "d", title="Data Engineer", description=None), job(5, "e", posted=None), job(6, "f", posted=dt.datetime(2024, 2, 20))]
    jobs = spark.createDataFrame(rows, JOB)

    def ids(df):
        return [r["id"] for r in df.collect()]
    assert ids(J.filter_location(jobs, "york")) == [2] and ids(J.filter_location(jobs, "YORK", include_remote=True)) == [1, 2]
    assert ids(J.filter_location(jobs, "n_w")) == [2] and ids(J.filter_location(jobs, "")) == [1, 2, 3, 4, 5, 6]
    assert ids(J.filter_keywords(jobs, "data eng")) == [4]
    assert ids(J.filter_posted_within(jobs, 10, AS_OF)) == [6] and len(ids(J.filter_posted_within(jobs, 0, AS_OF))) == 6
    assert ids(J.list_jobs(jobs, AS_OF)) == [5, 6, 1, 2, 4]                  # missing dates come first, then the newest
    assert [r["link"] for r in J.search_jobs(jobs, limit=2).collect()] == ["e", "f"]
    texts = jobs.withColumn("updated", F.when(F.col("id") == 1, "soon").otherwise("2024-02-28"))
    assert len(ids(J.filter_posted_within(texts, 10, AS_OF, "updated"))) == 5  # what is no date is dropped


def test_filters_reach_the_scan(spark, tmp_path, capsys):
    spark.createDataFrame([job(1, "a")], JOB).write.parquet(str(tmp_path / "jobs"))
    listed = J.list_jobs(spark.read.parquet(str(tmp_path / "jobs")), AS_OF, days_posted=30).select("id", "title")
    listed.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(posted_date" in plan and "EqualTo(is_active,true)" in plan and "TakeOrderedAndProject" in plan
    assert "salary" not in plan


def test_feed_defaults(spark, tmp_path):
    response = {"totalCount": 2, "jobs": [
        {"title": "A", "location": "L", "snippet": "S", "salary": "", "source": "board", "type": "", "link": "u1", "updated": "2024-02-01", "company": "", "id": "1"},
        {"title": "B", "link": "u2", "updated": "", "company": "Co", "salary": "$1", "type": "Part-time", "id": "2"},
        {"title": "C", "link": "u3", "updated": "not a date", "id": "3"}]}
    (tmp_path / "page.json").write_text(json.dumps(response))
    rows = feed_source.explode_feed(feed_source.read_feed(spark, str(tmp_path)))
    got = {r["url"]: r for r in feed_source.ingest_job_feed(rows, AS_OF).collect()}
    assert (got["u1"]["company"], got["u1"]["salary"], got["u1"]["job_type"], got["u1"]["tags"], got["u1"]["source"]) == (
        "Unknown", "Not specified", "Full-time", [], "feed")
    assert got["u1"]["posted_date"] == dt.datetime(2024, 2, 1) and got["u2"]["posted_date"] == NOW and got["u3"]["posted_date"] is None
    assert (got["u2"]["company"], got["u2"]["salary"], got["u2"]["job_type"]) == ("Co", "$1", "Part-time")
    kept = {r["url"]: r["source"] for r in feed_source.ingest_job_feed(rows, AS_OF, keep_source=True).collect()}
    assert kept == {"u1": "board", "u2": "feed", "u3": "feed"}


RESUME = ("id bigint, user_id bigint, file_name string, text string, is_latest boolean, status string, analysis string, "
          "upload_date timestamp, created_at timestamp, updated_at timestamp")


def cv(i, user, day, latest=False, status="uploaded", analysis=None):
    t = dt.datetime(2024, 1, day)
    return (i, user, f"{i}.pdf", "t", latest, status, analysis, t, t, OLD)


def test_resume_versions(spark):
    stored = spark.createDataFrame([cv(1, 1, 1), cv(2, 1, 5, True), cv(3, 2, 2, True)], RESUME)
    assert {r["id"] for r in S.mark_latest(stored).where("is_latest").collect()} == {2, 3}
    got = {r["id"]: r for r in S.add_resume_version(stored, spark.createDataFrame([cv(4, 1, 9, True)], RESUME), AS_OF).collect()}
    assert [got[i]["is_latest"] for i in (1, 2, 3, 4)] == [False, False, True, True]
    assert got[2]["updated_at"] == NOW and got[1]["updated_at"] == OLD and got[3]["updated_at"] == OLD
    assert [r["id"] for r in S.user_resumes(stored, 1).collect()] == [2, 1]
    assert S.resume_content(stored, user_id=1).collect()[0]["file_name"] == "2.pdf"
    assert [r["id"] for r in S.resume_by_id(stored, 3).collect()] == [3] and S.owned_by(stored, 1).count() == 2


def test_attach_and_pending(spark):
    stored = spark.createDataFrame([cv(1, 1, 1, status="processed", analysis="x"), cv(2, 1, 2, status="processed"), cv(3, 1, 3)], RESUME)
    assert {r["id"] for r in S.needs_analysis(stored).collect()} == {2, 3} and S.needs_analysis(stored, "mid").count() == 3
    results = spark.createDataFrame([(1, "processed", None), (3, "processed", "y")], "id bigint, status string, analysis string")
    got = {r["id"]: (r["status"], r["analysis"], r["updated_at"]) for r in S.attach_analysis(stored, results, AS_OF).collect()}
    assert got == {1: ("processed", None, NOW), 2: ("processed", None, OLD), 3: ("processed", "y", NOW)}


def test_stale(spark):
    df = spark.createDataFrame([(["s"] * 10, "n", ["p"], ["e"]), (["s"] * 9, "n", [], []), (None, "", [], []), (["s"] * 10, "n", None, [])],
                               "skills array<string>, name string, projects array<string>, education array<string>")
    assert [r["is_stale"] for r in S.stale_analysis(df).collect()] == [False, True, True, True]


def test_keys_and_references(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None), (4, 1)], "id int, user_id int")
    users = spark.createDataFrame([(1, "Ann", "ann@x.co"), (2, "Bob", "bob@x.co")], "id int, username string, email string")
    assert [r["id"] for r in integrity.orphans(child, "user_id", users).collect()] == [2]
    gone = users.where("id = 1")
    assert {r["id"] for r in integrity.cascade_delete(child, "user_id", gone).collect()} == {2, 3}
    assert {(r["id"], r["user_id"]) for r in integrity.cascade_delete(child, "user_id", gone, set_null=True).collect()} == {
        (1, None), (2, 9), (3, None), (4, None)}
    assert [tuple(r) for r in integrity.duplicate_keys(child, "user_id").collect()] == [(1, 2)]
    signups = spark.createDataFrame([("ANN@x.co", "Ann"), ("ann@x.co", "Bob")], "email string, username string")
    assert [r["username"] for r in integrity.existing_account(signups, users).collect()] == ["Ann"]


REC = "user_id bigint, resume_id bigint, job_id bigint, match_score double, created_at timestamp"


def test_replace_recommendations(spark):
    stored = spark.createDataFrame([(1, 1, 1, 5.0, OLD), (1, 2, 1, 6.0, OLD), (2, 1, 1, 7.0, OLD)], REC)
    new = spark.createDataFrame([(1, 1, 8, 1.0, NOW, 1), (1, 1, 8, 2.0, NOW, 2), (1, 1, 9, 3.0, NOW, 3)], REC + ", seq int")
    got = {tuple(r)[:4] for r in R.replace_recommendations(stored, new).collect()}
    assert got == {(1, 2, 1, 6.0), (2, 1, 1, 7.0), (1, 1, 8, 2.0), (1, 1, 9, 3.0)}


def test_ranking_keeps_candidate_order_on_ties(spark):
    rows = [(1, 10, 50.0), (1, 11, 90.0), (1, 12, 50.0), (2, 10, 10.0)]
    m = spark.createDataFrame(rows, "resume_id int, job_id int, match_score double").withColumn("updated", F.lit("2024-02-28"))
    assert [(r["job_id"], r["rank"]) for r in R.top_n_per_resume(m.where("resume_id = 1"), 2).orderBy("rank").collect()] == [(11, 1), (10, 2)]
    assert R.rank_matches(m, AS_OF, min_score=50, days_posted=7).count() == 3
    assert R.rank_matches(m, AS_OF, days_posted=1).count() == 0
    s = {r["resume_id"]: tuple(r)[1:] for r in R.match_batch_summary(m).collect()}
    assert s == {1: (pytest.approx(190 / 3), 3, 3), 2: (10.0, 0, 1)}


def test_user_recommendations(spark):
    recs = spark.createDataFrame([(1, 1, 1, 5.0, OLD), (1, 1, 2, 9.0, OLD), (1, 1, 3, 9.0, NOW), (2, 1, 1, 1.0, OLD)], REC)
    jobs = spark.createDataFrame([job(1, "a"), job(2, "b"), job(3, "c"), job(4, "d", active=False)], JOB)
    assert [r["job_id"] for r in R.user_recommendations(recs, jobs, 1).collect()] == [3, 2, 1]
    assert R.user_recommendations(recs, jobs, limit=1).count() == 2


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x" * 10)
    (tmp_path / "in" / "big.pdf").write_bytes(b"x" * 30)
    (tmp_path / "in" / "b.txt").write_bytes(b"x")
    assert [r["file_name"] for r in scan_resume_files(spark, str(tmp_path / "in"), max_bytes=20).collect()] == ["a.pdf"]
    df = spark.createDataFrame([(1, 1, ["r"]), (2, 2, [])], "user_id bigint, month int, recommendation_reasons array<string>")
    assert [r[0] for r in json_columns(df).select("recommendation_reasons").collect()] == ['["r"]', "[]"]
    out = str(tmp_path / "out" / "job_recommendations")
    write_scored(df, out, ["month"])
    write_scored(df.where("month = 1").withColumn("user_id", F.lit(9).cast("bigint")), out, ["month"], mode="overwrite")
    got = scan_table(spark, str(tmp_path / "out"), "job_recommendations").select("user_id", "recommendation_reasons").collect()
    assert {r["user_id"] for r in got} == {9, 2}      # only the written partition was replaced


def test_store_recommendations_finds_or_adds_the_job(spark):
    from vitaloom.operators.jobs import link_id
    from vitaloom.operators.recommendations import store_recommendations

    jobs = spark.createDataFrame([(1, "known", "u1"), (2, "twin", "u1")], "id long, title string, url string").selectExpr(
        "*", "timestamp'2024-01-01' created_at", "timestamp'2024-01-01' updated_at")
    stored = spark.createDataFrame([(7, 70, 5, 1.0), (8, 80, 5, 2.0)], "user_id long, resume_id long, job_id long, match_score double")
    new = spark.createDataFrame([(7, 70, "u1", "x", 3.0, 1), (7, 70, "u2", "new", 4.0, 2), (7, 70, "u2", "later", 5.0, 3), (9, 90, None, "none", 6.0, 4)],
                                "user_id long, resume_id long, url string, title string, match_score double, seq int")
    catalogue, kept = store_recommendations(stored, new, jobs, "2024-02-01 00:00:00")
    fresh = spark.range(1).select(link_id(F.lit("u2"))).first()[0]
    assert fresh < 0
    assert sorted((r["id"], r["title"], r["url"]) for r in catalogue.collect()) == [(fresh, "new", "u2"), (1, "known", "u1"), (2, "twin", "u1")]
    assert sorted(tuple(r) for r in kept.collect()) == [(7, 70, fresh, 5.0), (7, 70, 1, 3.0), (8, 80, 5, 2.0)]
