"""Pairing: exact results against brute force, whatever the vectors look like."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaloom.functions.encoders import dense, encode_hashed, encode_with
from vitaloom.operators.pairs import CANDIDATE_LEVELS, JOB_LEVELS, _totals, job_side, match_pairs, resume_side, search_space, top_matches
from vitaloom.plans.recommend import candidate_jobs


def unit(v):
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def make(spark, n_resumes, n_jobs, shape, seed=1):
    rng = np.random.default_rng(seed)
    r, j = rng.normal(size=(n_resumes, 16)), rng.normal(size=(n_jobs, 16))
    if shape == "clustered":
        centres = rng.normal(size=(8, 16)) * 6
        r, j = r + centres[rng.integers(0, 8, n_resumes)], j + centres[rng.integers(0, 8, n_jobs)]
    if shape == "hot":                       # a third of the jobs, and of the resumes, are copies
        j[: n_jobs // 3], r[: n_resumes // 3] = j[0], r[0]
    if shape == "zero":
        j[::5], r[::7] = 0.0, 0.0
    r, j = unit(r), unit(j)
    people = [(i, r[i].tolist(), float(rng.integers(0, 101)), str(rng.choice(CANDIDATE_LEVELS + ["other"]))) for i in range(n_resumes)]
    jobs = [(i, j[i].tolist(), str(rng.choice(JOB_LEVELS)), bool(rng.integers(0, 2))) for i in range(n_jobs)]
    return (spark.createDataFrame(people, "resume_id bigint, resume_vector array<double>, ats_score double, candidate_level string"),
            spark.createDataFrame(jobs, "job_id bigint, job_vector array<double>, job_level string, snippet boolean"))


def brute_force(spark, people, jobs, k, low=0.0):
    pairs = people.select("resume_id").crossJoin(jobs.select("job_id"))
    best = {}
    for m in match_pairs(pairs, people, jobs).where(F.col("match_score") >= low).collect():
        best.setdefault(m["resume_id"], []).append((-m["match_score"], m["job_id"]))
    return {(r, j, -s) for r, found in best.items() for s, j in sorted(found)[:k]}


@pytest.mark.parametrize("shape", ["random", "clustered", "hot", "zero"])
def test_top_matches_equal_brute_force(spark, shape):
    people, jobs = make(spark, 60, 240, shape)
    got = top_matches(people, jobs, k=7, block_rows=25, chunk_rows=16, cell_rows=20)
    assert {(r["resume_id"], r["job_id"], r["match_score"]) for r in got.collect()} == brute_force(spark, people, jobs, 7)


def test_top_matches_with_minimum_score_and_few_jobs(spark):
    people, jobs = make(spark, 20, 30, "random")
    got = top_matches(people, jobs, k=50, min_score=35.0, block_rows=8, chunk_rows=8, cell_rows=5)
    assert {(r["resume_id"], r["job_id"], r["match_score"]) for r in got.collect()} == brute_force(spark, people, jobs, 50, 35.0)


def test_top_matches_without_rows(spark):
    people, jobs = make(spark, 3, 3, "random")
    assert top_matches(people, jobs.where("job_id < 0")).count() == 0
    assert top_matches(people.where("resume_id < 0"), jobs).count() == 0


def test_clustered_vectors_meet_few_groups(spark):
    """Work follows the output: blocks go only to the chunks whose resumes can use them."""
    rng = np.random.default_rng(5)
    centres = unit(rng.normal(size=(12, 16)))
    near = lambda n: unit(centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 16)) * 0.004)
    jobs = spark.createDataFrame([(i, v.tolist(), "mid", False, i) for i, v in enumerate(near(2400))],
                                 "job_id bigint, job_vector array<double>, job_level string, snippet boolean, seq bigint")
    people = spark.createDataFrame([(i, v.tolist(), 70.0, "mid") for i, v in enumerate(near(600))],
                                   "resume_id bigint, resume_vector array<double>, ats_score double, candidate_level string")
    visits, chunks, blocks = search_space(people, jobs, 5, 0.0, block_rows=60, chunk_rows=40, cell_rows=50)
    assert blocks.count() > 40 and chunks.count() > 15 and 3 * visits.count() < blocks.count() * chunks.count()
    got = top_matches(people, jobs, k=5, block_rows=60, chunk_rows=40, cell_rows=50)
    asked = people.where("resume_id % 40 = 0")
    want = brute_force(spark, asked, jobs.drop("seq"), 5)
    assert {(r["resume_id"], r["job_id"], r["match_score"]) for r in got.where("resume_id % 40 = 0").collect()} == want


def test_top_matches_plan_has_no_pair_join(spark):
    people, jobs = make(spark, 5, 5, "random")
    plan = top_matches(people, jobs)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "WindowGroupLimit" in plan


def test_block_scores_equal_the_column_scores(spark):
    people, jobs = make(spark, 12, 40, "clustered", seed=4)
    pairs = people.select("resume_id").crossJoin(jobs.select("job_id"))
    got = match_pairs(pairs, people, jobs).orderBy("resume_id", "job_id").collect()
    p, j = people.orderBy("resume_id").toPandas(), jobs.orderBy("job_id").toPandas()
    sims = np.stack(p["resume_vector"]) @ np.stack(j["job_vector"]).T
    codes = np.array([CANDIDATE_LEVELS.index(x) if x in CANDIDATE_LEVELS else len(CANDIDATE_LEVELS) for x in p["candidate_level"]])
    want = _totals(sims, j["snippet"].to_numpy(), p["ats_score"].to_numpy(), codes, np.array([JOB_LEVELS.index(x) for x in j["job_level"]]))
    assert [r["raw_score"] for r in got] == pytest.approx(want.ravel().tolist())


def test_candidates_are_feed_first_then_newest(spark):
    jobs = spark.range(1, 80).select(
        "id", F.lit("Engineer").alias("title"), F.lit("X").alias("location"), F.lit("d").alias("description"), F.lit("s").alias("salary"),
        F.lit("src").alias("source"), F.lit("t").alias("job_type"), F.concat(F.lit("u"), F.col("id")).alias("url"),
        F.timestamp_seconds(F.col("id") * 86400).alias("posted_date"), F.lit("c").alias("company"), F.lit(True).alias("is_active"))
    got = candidate_jobs(jobs).orderBy("seq").collect()
    assert len(got) == 50 and got[0]["link"] == "u79" and got[-1]["link"] == "u30"
    assert candidate_jobs(jobs, limit=None).count() == 79
    feed = candidate_jobs(jobs.where("id = 79")).withColumn("title", F.lit("from feed"))
    both = {r["link"]: r["title"] for r in candidate_jobs(jobs, feed=feed).collect()}
    assert len(both) == 50 and both["u79"] == "from feed"


def test_encoders(spark):
    df = spark.createDataFrame([(1, "alpha beta beta"), (2, None)], "id int, text string")
    coded = encode_hashed(df, features=64).withColumn("dense", dense(F.col("vector"), 64))
    v = {r["id"]: r for r in coded.collect()}
    assert sorted(x["weight"] for x in v[1]["vector"]) == pytest.approx([1 / 5 ** 0.5, 2 / 5 ** 0.5]) and v[2]["vector"] is None
    assert [v[1]["dense"][x["bucket"]] for x in v[1]["vector"]] == [x["weight"] for x in v[1]["vector"]] and len(v[1]["dense"]) == 64
    assert sum(1 for x in v[1]["dense"] if x) == 2 and v[2]["dense"] is None
    assert encode_hashed(df.selectExpr("id", "'' AS text")).first()["vector"] == []
    own = encode_with(df, lambda: (lambda texts: np.array([[len(t), 1.0] for t in texts])))
    assert [r["vector"] for r in own.orderBy("id").collect()] == [[15.0, 1.0], None]


def test_missing_inputs_agree_on_both_paths(spark):
    """Null vectors, scores and levels: the same defined scores from given pairs and from the search, never full marks."""
    rng = np.random.default_rng(5)
    people = [(i, "text", None if i % 3 == 0 else rng.normal(size=4).tolist(), None if i % 4 == 0 else 60.0, None if i % 5 == 0 else "senior") for i in range(12)]
    jobs = [(i, "Engineer", "word " * 120, None if i % 3 == 1 else rng.normal(size=4).tolist()) for i in range(9)]
    p = resume_side(spark.createDataFrame(people, "id long, text string, vector array<double>, ats_score double, candidate_level string"))
    j = job_side(spark.createDataFrame(jobs, "id long, title string, description string, vector array<double>"))
    every = spark.range(12).withColumnRenamed("id", "resume_id").crossJoin(spark.range(9).withColumnRenamed("id", "job_id"))
    given = {(r["resume_id"], r["job_id"]): r for r in match_pairs(every, p, j).collect()}
    found = {(r["resume_id"], r["job_id"]): r for r in top_matches(p, j, k=9).collect()}
    assert given.keys() == found.keys() and len(given) == 108
    for key, r in given.items():
        assert (r["match_score"], r["similarity"]) == (found[key]["match_score"], found[key]["similarity"])
        assert r["match_score"] < 100
        if key[0] % 3 == 0 or key[1] % 3 == 1:
            assert r["similarity"] == 0
    none = job_side(spark.createDataFrame([(1, "a", "b", None)], "id long, title string, description string, vector array<double>"))
    assert top_matches(p, none).count() == 12


def test_whole_catalogue_is_not_sorted_or_limited(spark):
    jobs = spark.range(5).selectExpr("id", "'t' title", "'l' location", "'d' description", "'s' salary", "'x' source", "'j' job_type", "concat('u', id) url",
                                     "timestamp_seconds(id) posted_date", "'c' company", "true is_active")
    plan = candidate_jobs(jobs, limit=None)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "GlobalLimit" not in plan and "Window" not in plan


def test_feed_ids_are_their_own(spark):
    jobs = spark.createDataFrame([(1, "table job")], "id long, title string").selectExpr(
        "id", "title", "'l' location", "'d' description", "'s' salary", "'x' source", "'j' job_type", "'table-url' url", "timestamp'2024-01-01' posted_date",
        "'c' company", "true is_active")
    feed = spark.createDataFrame([(0, "feed job", "feed-url", "1"), (1, "odd id", "odd-url", "not a number")], "seq long, title string, link string, id string")
    got = candidate_jobs(jobs, feed=feed).orderBy("seq").collect()
    assert [r["title"] for r in got] == ["feed job", "odd id", "table job"]
    assert got[2]["job_id"] == 1 and got[0]["job_id"] < 0 and got[1]["job_id"] < 0 and got[0]["job_id"] != got[1]["job_id"]
