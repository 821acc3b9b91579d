"""A vocabulary as a table: the same hits as one expression for each term."""

import random

from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions.vocabulary import find_skills
from vitaloom.operators.terms import find_terms

SKILLS = fixed.TECHNICAL_SKILLS + fixed.SOFT_SKILLS


def table(spark, terms):
    return spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, ord int")


def test_same_hits_as_the_expressions(spark):
    rng = random.Random(3)
    pieces = SKILLS + ["pythonic", "C++x", "Node.JS", "node. js", "ci/cd", ".net", "c#", "É", "java-script", "go,", "r&d", "-"]
    rows = [(i, rng.choice([" ", ", ", "/", "\n", ""]).join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "python " * 50_000), (None, "python")], "doc_id long, text string")
    got = {r["doc_id"]: r["terms"] for r in find_terms(docs, table(spark, SKILLS)).where("doc_id IS NOT NULL").collect()}
    want = {r["doc_id"]: r["s"] or [] for r in docs.where("doc_id IS NOT NULL").select("doc_id", find_skills(F.lower("text")).alias("s")).collect()}
    assert got == want and sum(map(len, got.values())) > 1000
    assert find_terms(docs, table(spark, SKILLS)).count() == docs.count()


def test_a_hundred_thousand_terms(spark):
    rng = random.Random(4)
    terms = [f"term{i}" if i % 3 else f"skill {i} of-{i % 100}" for i in range(100_000)]
    said = [[rng.choice(terms) for _ in range(5)] for _ in range(60)]
    docs = spark.createDataFrame([(i, " and ".join(s).title() + " skill 12 of") for i, s in enumerate(said)], "doc_id int, text string")
    out = find_terms(docs, table(spark, terms))
    place = {t: i for i, t in enumerate(terms)}
    for r in out.collect():
        assert r["terms"] == sorted(set(said[r["doc_id"]]), key=place.get)
    assert len(out._jdf.queryExecution().analyzed().toString()) < 20_000


def test_extra_columns_repeated_terms_and_no_terms(spark):
    docs = spark.createDataFrame([(1, "b a", "x", 5)], "doc_id int, text string, terms string, ord int")
    got = find_terms(docs, spark.createDataFrame([("A", 3), ("a", 1), ("b", 2), ("++", 0), (None, 9)], "term string, ord int"))
    assert got.columns == ["doc_id", "text", "ord", "terms"] and got.first()["terms"] == ["a", "b"]
    assert find_terms(docs, spark.createDataFrame([], "term string, ord int")).first()["terms"] == []
