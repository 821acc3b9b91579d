"""Many searches through the index: what LIKE finds, one by one."""

import random

from pyspark.sql import functions as F

from vitaloom.operators.jobs import filter_keywords
from vitaloom.operators.keyword_index import search_many

JOBS = "id long, title string, description string"


def catalogue(spark, n, seed=1):
    rng = random.Random(seed)
    words = ["data", "Date", "engineer", "ENGINE", "c++", "node.js", "é", "100%", "a_b", "xyz", "q", "東京"]
    return spark.createDataFrame([(i, rng.choice([None, " ".join(rng.choices(words, k=2))]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 12)))]))
                                  for i in range(n)], JOBS)


def test_equals_like_one_by_one(spark):
    jobs = catalogue(spark, 200)
    searches = ["data", "Engineer", "engine data", "é", "q", "ta e", "d%e", "xy_", "%", "", "__", "no such words", "C++", "a_b", "東京", "d_t", "dat% q", "\\%"]
    got = {(r["search"], r["id"]) for r in search_many(jobs, spark.createDataFrame([(s,) for s in [*searches, None, "data"]], "keywords string")).collect()}
    want = {(s, r["id"]) for s in searches for r in (filter_keywords(jobs, s) if s not in ("%", "__") else jobs.where(
        F.lower("title").like(f"%{s}%") | F.lower("description").like(f"%{s}%"))).collect()}
    assert got == want and len({s for s, _ in got}) >= 15


def test_a_thousand_searches_without_a_cross_join(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, name(), f"{name()} {name()} common words {i}") for i in range(3000)]
    jobs = spark.createDataFrame(rows, JOBS)
    searches = [rng.choice(rows)[1][:5] for _ in range(700)] + [f"words {i}" for i in range(300)]
    out = search_many(jobs, spark.createDataFrame([(s,) for s in searches], "keywords string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert {(r["search"], r["id"]) for r in out.collect()} == {(s, i) for s in set(searches) for i, t, d in rows if s in t or s in d}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "keywords string")
    assert search_many(catalogue(spark, 5), none).count() == 0
    assert search_many(spark.createDataFrame([], JOBS), spark.createDataFrame([("a",), ("",)], "keywords string")).count() == 0
