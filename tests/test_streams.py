"""Streams: the same rows as the batch operators, also when a batch runs again."""

import json

from pyspark.sql import functions as F

from tests.test_tables import AS_OF, JOB, job
from vitaloom.operators.jobs import upsert_jobs
from vitaloom.plans.analyze import analyze_resumes
from vitaloom.sources.feed import explode_feed, ingest_job_feed, read_feed
from vitaloom.streaming import streams


def page(path, name, *jobs):
    (path / name).write_text(json.dumps({"totalCount": len(jobs), "jobs": [
        {"title": t, "link": u, "updated": "2024-02-01", "id": str(i)} for i, u, t in jobs]}))


def test_feed_stream_equals_batch_and_restarts(spark, tmp_path):
    inbox, log, state = tmp_path / "inbox", str(tmp_path / "log"), str(tmp_path / "state")
    inbox.mkdir()
    base = spark.createDataFrame([job(1, "a")], JOB)

    def rows(stream):
        flat = explode_feed(read_feed(spark, str(inbox), stream))
        return ingest_job_feed(flat.withColumn("seq", F.col("id").cast("int")), AS_OF).drop("position", "tags")

    def run():
        streams.stream_upsert_jobs(rows(True), log, state, once=True).awaitTermination()

    page(inbox, "1.json", (1, "a", "one"), (2, "n", "two"))
    run()
    page(inbox, "2.json", (3, "n", "three"), (4, "m", "four"))
    run()
    run()                                                       # nothing new: nothing is written twice
    logged = streams.read_log(spark, log, rows(False))
    assert logged.select("batch_id").distinct().count() == 2 and logged.count() == 4
    key = ["url", "title", "posted_date", "updated_at"]
    got = streams.catalogue_with_log(base, logged, AS_OF).select(*key)
    want = upsert_jobs(base, rows(False), AS_OF).select(*key)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r["url"]: r["title"] for r in got.collect()} == {"a": "one", "n": "three", "m": "four"}


def test_dedupe_analysis_and_logins(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-03")], "url string, d string").select(
        "url", F.to_timestamp("d").alias("posted_date")).coalesce(1).write.parquet(str(tmp_path / "jobs"))
    source = spark.readStream.schema("url string, posted_date timestamp").parquet(str(tmp_path / "jobs"))

    def run(stream, name, mode="append"):
        streams.write_log(stream, str(tmp_path / name), str(tmp_path / (name + "-state")), mode, once=True).awaitTermination()
        return streams.read_log(spark, str(tmp_path / name), stream)

    assert sorted(r["url"] for r in run(streams.stream_dedupe_jobs(source), "deduped").collect()) == ["a", "b"]

    texts = spark.createDataFrame([("Jane Doe\nSkills: python",), ("",)], "text string")
    texts.write.parquet(str(tmp_path / "texts"))
    analysed = run(analyze_resumes(spark.readStream.schema(texts.schema).parquet(str(tmp_path / "texts"))), "analysed")
    assert sorted(map(str, analysed.drop("batch_id").collect())) == sorted(map(str, analyze_resumes(texts).collect()))

    logins = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-05"), (2, "2024-01-02")], "user_id bigint, d string").select(
        "user_id", F.to_timestamp("d").alias("ts"))
    logins.write.parquet(str(tmp_path / "logins"))
    stream = spark.readStream.schema(logins.schema).parquet(str(tmp_path / "logins"))
    got = streams.last_login_from_log(run(streams.stream_last_login(stream), "last", "update")).collect()
    assert {r["user_id"]: str(r["last_login"])[:10] for r in got} == {1: "2024-01-05", 2: "2024-01-02"}


def batches(path, rows):
    """Rows ``(seq, url, title, stamp)`` as five files, one for each batch."""
    for at, batch in enumerate(rows):
        (path / f"{at}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "url", "title", "stamp"), r))) for r in batch))
        yield at


ROWS = [[(1, "a", "a1", "2024-01-05"), (2, "n", "n1", "2024-01-05")], [(3, "n", "n2", "2024-02-05"), (4, None, "loose", "2024-02-05")],
        [(5, "m", "m1", "2024-03-05")], [(6, "n", "n3", "2024-04-05"), (7, "n", "n4", "2024-04-05")], [(8, "a", "a2", "2024-05-05"), (9, "k", "k1", "2024-05-05")]]


def feed(spark, inbox):
    stream = spark.readStream.schema("seq int, url string, title string, stamp timestamp").json(str(inbox))
    return stream.select("*", *[F.lit(x).alias(x) for x in ("company", "location", "description", "salary", "job_type", "source")],
                         F.col("stamp").alias("posted_date"), F.lit(True).alias("is_active"))


def test_compacted_log_equals_batch_after_batch(spark, tmp_path):
    inbox, log, state, base = tmp_path / "inbox", str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "base")
    inbox.mkdir()
    jobs = spark.createDataFrame([job(1, "a"), job(2, "b")], JOB)
    stream, want = feed(spark, inbox), jobs
    for at in batches(inbox, ROWS):
        streams.stream_upsert_jobs(stream, log, state, once=True).awaitTermination()
        batch = streams.read_log(spark, log, stream).where(F.col("batch_id") == at).drop("batch_id")
        want = spark.createDataFrame(upsert_jobs(want, batch, ROWS[at][0][3]).collect(), jobs.schema)
        if at in (1, 3):
            assert streams.compact_log(spark, log, base, jobs, stream, stamp="stamp") == at
            assert streams.compact_log(spark, log, base, jobs, stream, stamp="stamp") == at
            assert [p.name for p in (tmp_path / "base").iterdir()] == [f"upto={at}"] and not list((tmp_path / "log").glob("batch_id=*"))
        # a compaction that did not end is not read
        (tmp_path / "base" / "upto=99").mkdir(parents=True, exist_ok=True)
        got = streams.current_catalogue(spark, log, base, jobs, stream, stamp="stamp")
        (tmp_path / "base" / "upto=99").rmdir()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    times = {r["url"]: (str(r["created_at"])[:10], str(r["updated_at"])[:10]) for r in got.collect()}
    assert times["n"] == ("2024-01-05", "2024-04-05") and times["a"] == ("2024-01-01", "2024-05-05") and times["b"] == ("2024-01-01", "2024-01-01")


def test_a_link_that_returns_after_months_is_not_new(spark, tmp_path):
    inbox, log, state = tmp_path / "inbox", str(tmp_path / "log"), str(tmp_path / "state")
    inbox.mkdir()
    known = spark.createDataFrame([("a",), ("z",)], "url string")
    stream = feed(spark, inbox)
    for _ in batches(inbox, ROWS):
        streams.write_new_jobs(stream, log, state, known, order=("seq",), once=True).awaitTermination()
    got = sorted((r["batch_id"], r["seq"], r["url"], r["title"], str(r["stamp"])[:10]) for r in streams.read_log(spark, log, stream).collect())
    assert got == [(0, 2, "n", "n1", "2024-01-05"), (1, 4, None, "loose", "2024-02-05"), (2, 5, "m", "m1", "2024-03-05"), (4, 9, "k", "k1", "2024-05-05")]
