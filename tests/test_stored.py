"""Work that is not done twice, and tables changed in place."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from vitaloom.operators import recommendations, reuse
from vitaloom.operators.resumes import attach_analysis
from vitaloom.plans.analyze import analysis_type, analyze_pending, analyze_resumes
from vitaloom.sources.buckets import BUCKET, read_buckets, update_buckets, with_bucket, write_buckets

AS_OF = "2024-03-01 00:00:00"


def counting(spark, column="length"):
    """A computation that counts the rows it works on."""
    seen = spark.sparkContext.accumulator(0)

    def compute(df):
        def run(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf.assign(length=pdf["text"].str.len().astype("int64"))
        return df.select("id", "content_key", "text").mapInPandas(run, "id long, content_key string, text string, length long")

    return compute, seen


def test_a_second_run_works_on_what_is_new(spark):
    store = spark.createDataFrame([], "content_key string, length long")
    rows = lambda n: spark.range(n).select("id", F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    compute, seen = counting(spark)
    _, store = reuse.reuse(rows(900), store, compute, "v1")
    assert seen.value == 900
    found, added = reuse.reuse(rows(1000), store, compute, "v1")
    assert seen.value == 1000 and added.count() == 100
    assert found.where("length IS NULL").count() == 0 and found.count() == 1000
    again, none = reuse.reuse(rows(1000), store.unionByName(added), compute, "v1")
    assert seen.value == 1000 and none.count() == 0 and again.where("length <> length(text)").count() == 0


def test_equal_texts_are_worked_on_once_and_other_versions_again(spark):
    rows = spark.createDataFrame([(1, "same"), (2, "same"), (3, None), (4, ""), (5, "other")] + [(10 + i, "hot") for i in range(500)], "id long, text string")
    store = spark.createDataFrame([], "content_key string, length long")
    compute, seen = counting(spark)
    found, store = reuse.reuse(rows, store, compute, "v1")
    assert seen.value == 4 and store.count() == 4
    assert {(r["id"], r["length"]) for r in found.where("id < 10").collect()} == {(1, 4), (2, 4), (3, None), (4, 0), (5, 5)}
    assert found.where("length = 3").count() == 500
    assert reuse.reuse(rows, store, compute, "v2")[1].count() == 4 and reuse.reuse(rows, store, compute, "v1", level="mid")[1].count() == 4
    assert reuse.reuse(rows, store, compute, "v1")[1].count() == 0


def test_key_is_a_hash_of_all_it_depends_on(spark):
    key = lambda *a, **b: spark.range(1).select(reuse.content_key(F.lit("t"), *a, **b)).first()[0]
    assert key("v") == hashlib.sha256(b"v\x1f\x1ft").hexdigest() and key("v", level="mid") == hashlib.sha256(b"v\x1fmid\x1ft").hexdigest()
    assert spark.range(1).select(reuse.content_key(F.lit(None).cast("string"), "v")).first()[0] is None


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def stored(spark, path, n=200, buckets=8):
    df = spark.range(n).select("id", (F.col("id") % 7).alias("v"))
    write_buckets(df, path, ["id"], buckets)
    return df.schema


def add(old, changes):
    return old.join(changes.select("id", F.col("v").alias("_v")), "id", "left").withColumn("v", F.coalesce("_v", "v")).drop("_v")


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = stored(spark, path)
    before = files(path)
    changes = spark.createDataFrame([(3, 100), (77, 200)], "id long, v long")
    touched = update_buckets(spark, path, schema, ["id"], 8, changes, add)
    after = files(path)
    same = {f for f in before if f"{BUCKET}=" in f and int(f.split(f"{BUCKET}=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 2 and same and all(after[f] == before[f] for f in same)
    assert all(f not in before for f in after if int(f.split(f"{BUCKET}=")[1].split("/")[0]) in touched)
    got = {r["id"]: r["v"] for r in read_buckets(spark, path, schema).collect()}
    assert got == {i: {3: 100, 77: 200}.get(i, i % 7) for i in range(200)}
    update_buckets(spark, path, schema, ["id"], 8, changes, add)
    assert {r["id"]: r["v"] for r in read_buckets(spark, path, schema).collect()} == got


def test_buckets_that_lose_all_rows_and_empty_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = stored(spark, path, n=40, buckets=5)
    before = files(path)
    assert update_buckets(spark, path, schema, ["id"], 5, spark.createDataFrame([], "id long, v long"), add) == [] and files(path) == before
    gone = with_bucket(spark.range(40), ["id"], 5).where(f"{BUCKET} = 2").select("id", F.lit(0).cast("long").alias("v"))
    assert update_buckets(spark, path, schema, ["id"], 5, gone, lambda old, changes: old.join(changes.select("id"), "id", "left_anti")) == [2]
    assert read_buckets(spark, path, schema).count() == 40 - gone.count() and read_buckets(spark, path, schema, [2]).count() == 0
    assert update_buckets(spark, path, schema, ["id"], 5, gone, lambda old, changes: old.unionByName(changes)) == [2]
    assert read_buckets(spark, path, schema).count() == 40


def test_a_run_that_failed_is_run_again(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["user_id", "resume_id"]
    rows = "user_id long, resume_id long, job_id long, score long"
    old = spark.createDataFrame([(u, r, j, 1) for u in range(6) for r in range(3) for j in range(4)], rows)
    write_buckets(old, path, keys, 8)
    new = spark.createDataFrame([(u, 1, j, 9, j) for u in range(6) for j in (2, 8)] + [(9, 9, 9, 9, 1)], rows + ", seq int")
    half = {"n": 0}

    def failing(stored, changes):
        half["n"] += 1
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        update_buckets(spark, path, old.schema, keys, 8, new, failing)
    assert read_buckets(spark, path, old.schema).count() == old.count()
    want = sorted(tuple(r) for r in recommendations.replace_recommendations(old, new).collect())
    for _ in range(2):
        update_buckets(spark, path, old.schema, keys, 8, new, recommendations.replace_recommendations)
        assert sorted(tuple(r) for r in read_buckets(spark, path, old.schema).collect()) == want


def test_keys_that_are_not_in_the_changes_are_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = stored(spark, path, n=20, buckets=8)
    moved = lambda old, changes: old.withColumn("id", F.col("id") + 1000)
    with pytest.raises(ValueError):
        update_buckets(spark, path, schema, ["id"], 8, spark.createDataFrame([(1, 1)], "id long, v long"), lambda o, c: moved(o, c).unionByName(
            spark.range(50).select("id", F.lit(0).cast("long").alias("v"))))


def test_analyses_are_attached_in_place(spark, tmp_path):
    path = str(tmp_path / "resumes")
    text = "Jane Doe\njane@mail.example.com\nSkills\npython, docker, sql\nExperience\nAcme - Engineer Jan 2018 - Mar 2020\n- Built 3 tools"
    source = spark.createDataFrame([(i, "pending", text + f" {i}" if i else None) for i in range(30)], "id long, status string, text string")
    source = source.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")).withColumn("analysis", F.lit(None).cast(analysis_type(spark)))
    write_buckets(source, path, ["id"], 4)
    before = files(path)
    few = analyze_pending(spark, path, source.schema, 4, AS_OF, pending=F.col("id") == 5)
    assert len(few) == 1 and sum(f in before for f in files(path)) > 0
    rows = read_buckets(spark, path, source.schema)
    assert rows.where("status = 'processed'").select("id").collect()[0][0] == 5 and rows.where("analysis IS NOT NULL").count() == 1
    analyze_pending(spark, path, source.schema, 4, AS_OF)
    rows = read_buckets(spark, path, source.schema)
    assert rows.where("status = 'processed' AND updated_at = '2024-03-01'").count() == 29 and rows.where("id = 0 AND status = 'pending' AND analysis IS NULL").count() == 1
    want = analyze_resumes(source.drop("analysis").where("id > 0")).select("id", "analysis.score", "analysis.extractedInfo.skills")
    assert sorted(tuple(map(str, r)) for r in rows.where("id > 0").select("id", "analysis.score", "analysis.extractedInfo.skills").collect()) == sorted(tuple(map(str, r)) for r in want.collect())
    assert analyze_pending(spark, path, source.schema, 4, AS_OF) == []
    again = attach_analysis(rows, rows.where("id = 5").select("id", "status", "analysis"), AS_OF)
    assert again.schema == rows.schema and again.count() == 30
