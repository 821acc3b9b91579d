"""Work that must follow the size of the input: each step once for a row, and tables in the form that large ones have."""

import math

from pyspark.sql import functions as F

from catalog import match_queries, stream_queries
from vitaloom.functions import vectors
from vitaloom.functions.encoders import dense, encode_hashed
from vitaloom.operators import pairs
from vitaloom.operators.resumes import attach_analysis
from vitaloom.plans.analyze import ideal_vectors
from vitaloom.streaming import streams


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def write(spark, folder, name, rows, schema, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.parquet(f"{folder}/{name}.parquet")


def customers(spark, folder, n=4):
    write(spark, folder, "customer", [(i, f"c{i}", 100.0 * i, "BUILDING") for i in range(1, n + 1)], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


def documents(spark, folder, files=1):
    write(spark, folder, "documents", [(1, "alpha beta beta"), (2, None), (3, ""), (4, "led teams and built python tools")], "doc_id long, text string", files)


def test_a_stream_reads_a_table_of_one_file_and_a_folder_of_files(spark, tmp_path):
    documents(spark, tmp_path, files=3)
    part = next(p for p in (tmp_path / "documents.parquet").glob("part-*.parquet"))
    (tmp_path / "single").mkdir()
    (tmp_path / "single" / "documents.parquet").write_bytes(part.read_bytes())
    (tmp_path / "single" / "other.parquet").write_bytes(part.read_bytes())
    for folder, n in ((tmp_path, 4), (tmp_path / "single", spark.read.parquet(str(part)).count())):
        log = str(folder / "log")
        stream = stream_queries.source(spark, str(folder), "documents")
        streams.write_log(stream, log, str(folder / "state"), once=True).awaitTermination()
        assert streams.read_log(spark, log, stream).count() == n


def test_encode_runs_the_encoder_once_for_a_row(spark, tmp_path):
    customers(spark, tmp_path)
    documents(spark, tmp_path)
    coded = match_queries.QUERIES["encode"](spark, str(tmp_path))
    # one projection for each of the two kinds of texts; the sort needs no comparator
    assert plan_of(coded).count("md5(") == 2 and "array_sort" not in plan_of(coded)
    by_doc = {}
    for r in coded.collect():
        by_doc.setdefault(r["doc_id"], []).append(r["weight"])
    assert sorted(by_doc["d1"]) == [round(1 / math.sqrt(5), 6), round(2 / math.sqrt(5), 6)] and not {"d2", "d3"} & set(by_doc)


def test_dense_looks_no_bucket_up(spark):
    df = spark.createDataFrame([(1, [(5, 0.5), (2, 0.25)]), (2, []), (3, None)], "id int, v array<struct<bucket: int, weight: double>>")
    filled = df.select("id", dense(F.col("v"), 8).alias("v"))
    assert "element_at" not in plan_of(filled) and "map_from_entries" not in plan_of(filled)
    assert {r["id"]: r["v"] for r in filled.collect()} == {1: [0.0, 0.0, 0.25, 0.0, 0.0, 0.5, 0.0, 0.0], 2: [0.0] * 8, 3: None}


def test_ideal_sentences_meet_the_buckets_of_their_words_only(spark):
    def encoder(df):
        return encode_hashed(df, features=64).withColumn("vector", dense(F.col("vector"), 64))

    df = encoder(spark.createDataFrame([(1, "led a team of ten"), (2, "nothing here"), (3, ""), (4, None)], "id int, text string"))
    words = ["led a team", "built one tool", "", "nothing"]
    found = df.withColumns({"few": ideal_vectors(spark, encoder, words)}).select("id", vectors.similarities(F.col("vector"), F.col("few"), sparse=True).alias("s"), "few")
    rows = {r["id"]: r for r in found.collect()}
    assert [len(v) for v in rows[1]["few"]] == [3, 3, 0, 1]
    # the same sums over all buckets
    whole = {r["id"]: r["vector"] for r in encoder(spark.createDataFrame(list(enumerate(words)), "id int, text string")).collect()}
    own = {r["id"]: r["vector"] for r in df.collect()}
    for i in (1, 2, 3):
        assert all(abs(s - sum(a * b for a, b in zip(own[i], whole[k]))) < 1e-12 for k, s in enumerate(rows[i]["s"]))
    assert rows[4]["s"] == [None] * 4


def test_lean_pairs_carry_floats_and_score_as_unit_vectors_do(spark):
    people = spark.createDataFrame([(1, "a", [1.0, 2.0, 3.0], 50.0, "mid"), (2, "b", [0.0, 0.0, 0.0], 10.0, None), (3, "c", None, None, "entry"), (4, "d", [0.5, None, 0.25], 90.0, "senior"),
                                    (5, "e", [1.0], 90.0, "senior")], "id long, text string, vector array<float>, ats_score double, candidate_level string")
    jobs = spark.createDataFrame([(7, "Senior Engineer", "python", [0.3, 0.1, 0.9]), (8, "Intern", "sql", [0.1, None, 0.2]), (9, "x", "y", None)],
                                 "id long, title string, description string, vector array<float>")
    lean = pairs.resume_side(people, lean=True)
    assert dict(lean.dtypes)["resume_vector"] == "array<float>"
    both = people.selectExpr("id AS resume_id").crossJoin(jobs.selectExpr("id AS job_id"))
    plain = pairs.match_pairs(both, pairs.resume_side(people), pairs.job_side(jobs))
    few = pairs.match_pairs(both, lean, pairs.job_side(jobs))
    assert few.columns == plain.columns and sorted(map(tuple, few.collect())) == sorted(map(tuple, plain.collect()))


def test_visits_make_no_more_tasks_than_a_driver_can_keep():
    assert [pairs.tasks_of(n, 12) for n in (0, 5, 1000, 10_000)] == [1, 5, 62, 625]
    assert pairs.tasks_of(10_000_000, 12) <= 5_000


def test_analyses_are_not_broadcast(spark):
    stored = spark.createDataFrame([(1, None, None), (2, "uploaded", None)], "id long, status string, analysis struct<score: double>").selectExpr("*", "current_timestamp() AS updated_at")
    found = spark.createDataFrame([(2, "processed", (5.0,))], "id long, status string, analysis struct<score: double>")
    out = attach_analysis(stored, found, "2024-03-01 00:00:00")
    assert "Broadcast" not in plan_of(out)
    assert {r["id"]: (r["status"], r["analysis"] and r["analysis"]["score"]) for r in out.collect()} == {1: (None, None), 2: ("processed", 5.0)}


def test_text_tables_in_one_split_are_dealt_to_all_cores(spark, tmp_path):
    """A small file of many rows is one split; the work on its texts is not left to one task."""
    from catalog import inputs

    spark.range(500).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    df = inputs.load(spark, str(tmp_path), "customer")
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and df.distinct().count() == df.count() == 500


def test_vectors_of_given_pairs_travel_once_to_a_cell_and_not_with_every_pair(spark):
    """The lists of pairs are spread behind the last shuffle: 300 resumes in 8 groups of jobs, 40 jobs in 4 of resumes at least."""
    people = spark.range(300).selectExpr("id", "'a' AS text", "array(CAST(id AS FLOAT), 1F) AS vector", "50D AS ats_score", "'mid' AS candidate_level")
    jobs = spark.range(40).selectExpr("id", "'Engineer' AS title", "'python' AS description", "array(1F, CAST(id AS FLOAT)) AS vector")
    both = people.selectExpr("id AS resume_id").crossJoin(jobs.selectExpr("id AS job_id"))
    told = pairs.match_pairs(both, pairs.resume_side(people, lean=True), pairs.job_side(jobs, lean=True))
    plan = plan_of(told)
    lookup = plan[plan.index("ShuffledHashJoin"):]
    assert "explode(_pairs" in lookup[:lookup.index("Exchange")]
    rows = {(r["resume_id"], r["job_id"]): r["similarity"] for r in told.collect()}
    assert len(rows) == 12_000
    assert all(abs(s - (i + j) / math.sqrt((i * i + 1) * (1 + j * j))) < 1e-9 for (i, j), s in rows.items())


def test_given_pairs_of_any_ids_meet_in_any_number_of_groups(spark, monkeypatch):
    """Ids of two types, repeated and missing ids and further columns of a pair, as in a plain join."""
    people = spark.createDataFrame([(1, "a", [1.0, 2.0], 50.0, "mid"), (2, "b", [2.0, 1.0], 10.0, None), (2, "c", None, None, "entry"), (None, "d", [1.0, 1.0], 1.0, "mid")],
                                   "id int, text string, vector array<float>, ats_score double, candidate_level string")
    jobs = spark.createDataFrame([(7, "Engineer", "python", [0.5, 0.25]), (7, "Engineer", "sql", [0.0, 1.0]), (8, "Intern", "sql", None), (None, "x", "y", [1.0, 0.0])],
                                 "id long, title string, description string, vector array<float>")
    both = spark.createDataFrame([(1, 7, "p"), (1, 7, "p"), (2, 7, "q"), (2, 8, None), (3, 7, "r"), (1, 9, "s"), (None, 7, "t"), (1, None, "u")], "resume_id long, job_id int, note string")
    for few in (True, False):
        if few:
            monkeypatch.setattr(pairs, "NUMBERS_OF_GROUP", 7)
        mine, theirs = pairs.resume_side(people, lean=True), pairs.job_side(jobs, lean=True)
        assert pairs.grid(theirs)[0] == (10 if few else pairs.JOB_GROUPS)
        got = pairs.match_pairs(both, mine, theirs)
        plain = both.join(pairs.resume_side(people), "resume_id").join(pairs.job_side(jobs), "job_id")
        want = pairs.scored(plain, F.coalesce(vectors.similarity(F.col("resume_vector"), F.col("job_vector")), F.lit(0.0))).drop("resume_vector", "job_vector")
        assert got.dtypes == want.dtypes and got.count() == 10
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        monkeypatch.undo()


def pair_tables(spark, folder):
    """Small tables of all kinds that pairs come from: by their files' size Spark would send any of them to all tasks."""
    customers(spark, folder)
    write(spark, folder, "part", [(i, f"part {i}", "Brand#1", "STEEL", i, 900.0 + i) for i in range(1, 6)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    write(spark, folder, "orders", [(i, 1 + i % 4) for i in range(8)], "o_orderkey long, o_custkey long")
    write(spark, folder, "lineitem", [(i % 8, 1 + i % 5) for i in range(30)], "l_orderkey long, l_partkey long")
    write(spark, folder, "embeddings", [(i, [1.0 * i, 1.0], "a") for i in range(3)], "vec_id int, embedding array<float>, label string")


def sent_to_all(df):
    """The keys of joins for which one side is sent to all tasks, but for the vectors."""
    found = [line.split("Join", 1)[1] for line in plan_of(df).splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoop" in line]
    return [j for j in found if not j.startswith(" [vec#")]


def test_reasons_of_pairs_send_no_table_to_all_tasks(spark, tmp_path):
    pair_tables(spark, tmp_path)
    told = match_queries.QUERIES["match_reasons"](spark, str(tmp_path))
    assert sent_to_all(told) == []
    assert sorted((r["resume_id"], r["job_id"]) for r in told.collect()) == sorted({(1 + (i % 8) % 4, 1 + i % 5) for i in range(30)})


def test_texts_of_pairs_are_sent_to_cells_and_not_to_all_tasks(spark, tmp_path):
    pair_tables(spark, tmp_path)
    ruled = match_queries.QUERIES["rule_reasons"](spark, str(tmp_path))
    assert sent_to_all(ruled) == [] and "ShuffledHashJoin [_cell" in plan_of(ruled)
    pairs_of = sorted({(1 + (i % 8) % 4, 1 + i % 5) for i in range(30)})
    assert sorted((r["resume_id"], r["job_id"]) for r in ruled.collect()) == pairs_of
    # the lists of skills and the bits name the same skills
    hits = {(r["resume_id"], r["job_id"]): r["value"] for r in match_queries.QUERIES["cap_matched_skills"](spark, str(tmp_path)).collect()}
    assert sorted(hits) == pairs_of and {bool(v) for v in hits.values()} == {True, False}
    assert all(("Matches your skills: " in r["value"]) == bool(hits[r["resume_id"], r["job_id"]]) for r in ruled.collect())


def test_a_summary_works_on_texts_once(spark, tmp_path):
    """Verdicts and matches read the features that were written once; the last plan has no work on texts."""
    pair_tables(spark, tmp_path)
    told = match_queries.QUERIES["recommend_summary"](spark, str(tmp_path))
    assert not any(word in plan_of(told) for word in ("regexp", "RLIKE", "customer.parquet"))
    assert sorted(r["resume_id"] for r in told.collect()) == [1, 2, 3, 4]


def test_visits_of_a_group_of_blocks_leave_the_best_rows_of_each_resume_only(spark, monkeypatch):
    """Vectors travel to cells of a grid, not with every visit, and a resume has ``k`` rows for each group of blocks, however many of them it visits."""
    monkeypatch.setattr(pairs, "BLOCKS_BYTES", 8_000)
    monkeypatch.setattr(pairs, "CHUNKS_BYTES", 1_500)
    rows = lambda n, step: [(i, [math.cos(i * step), math.sin(i * step), 0.1]) for i in range(n)]
    people = spark.createDataFrame(rows(70, 0.7), "resume_id long, resume_vector array<double>").selectExpr("*", "50D AS ats_score", "'mid' AS candidate_level")
    jobs = spark.createDataFrame(rows(500, 0.3), "job_id long, job_vector array<double>").selectExpr("*", "'mid' AS job_level", "true AS snippet", "job_id AS seq")
    visits, chunks, blocks = pairs.search_space(people, jobs, 4, 0.0, block_rows=30, chunk_rows=10, cell_rows=100)
    groups = pairs._groups(visits, chunks, blocks)
    assert groups[0] == 2 and groups[1] >= 2 and blocks.count() > 10
    found = pairs._met_blocks(visits, chunks, blocks, 4, 0.0)
    assert plan_of(found).count("MapInPandas") == 0 and "CoGroups" in plan_of(found) and found.count() <= 2 * 4 * 70
    got = pairs.top_matches(people, jobs.drop("seq"), 4, block_rows=30, chunk_rows=10, cell_rows=100)
    every = pairs.match_pairs(people.select("resume_id").crossJoin(jobs.select("job_id")), people, jobs.drop("seq")).collect()
    want = {}
    for r in every:
        want.setdefault(r["resume_id"], []).append((-r["match_score"], r["job_id"]))
    assert {(r["resume_id"], -r["match_score"], r["job_id"]) for r in got.collect()} == {(i, *x) for i, found in want.items() for x in sorted(found)[:4]}
