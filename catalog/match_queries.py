"""Queries over resume x job pairs, vectors, scores and recommendations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog.features_sql import W, bands, by_level, features, ladder, lit
from catalog.inputs import (AS_OF, CORPUS, CORPUS_VECTORS, JOB_VECTORS, JOBS, PAIRS, PEOPLE, RESUMES, for_duckdb, load, table)
from catalog.text_queries import job_seniority_sql, joined
from vitaloom import fixed_messages as say
from vitaloom import fixed_values as fixed
from vitaloom.functions import advice, matching, scores, vectors, vocabulary
from vitaloom.functions.encoders import dense, encode_hashed
from vitaloom.functions.levels import resolve_level
from vitaloom.functions.text import word_count
from vitaloom.operators import reuse, rules
from vitaloom.operators.features import extract_features
from vitaloom.operators.pairs import grid, job_side, match_pairs, met_pairs, resume_side, top_matches
from vitaloom.operators.recommendations import match_batch_summary
from vitaloom.plans.analyze import analysis_type, analyze_pending, analyze_resumes, ideal_vectors, score_features
from vitaloom.plans.recommend import CHECKED, candidate_jobs, recommend_jobs, recommendation_summary
from vitaloom.session import cut_lineage, shared_folder
from vitaloom.sources.buckets import read_buckets, write_buckets

QUERIES, SQL = {}, {}
D = for_duckdb
c = F.col


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


# --------------------------------------------------------------------- pairs
def people(spark, d):
    return table(spark, d, PEOPLE, merge="customer", customer="c_custkey")


def jobs_with_vectors(spark, d):
    """Both sides are dealt by job and joined where they lie, none is sent to all tasks."""
    known = table(spark, d, JOB_VECTORS, part="p_partkey").withColumnRenamed("job_id", "id")
    return table(spark, d, JOBS, part="p_partkey").hint("merge").join(known, "id")


def shown_pairs(spark, d):
    return table(spark, d, PAIRS, merge="orders")


def scored_pairs(spark, d):
    return match_pairs(shown_pairs(spark, d), resume_side(people(spark, d), lean=True), job_side(jobs_with_vectors(spark, d), lean=True))


SKILL_BITS = {n: list(dict.fromkeys(w.lower() for w in ws)) for n, ws in (("technical", fixed.TECHNICAL_SKILLS), ("soft", fixed.SOFT_SKILLS))}
MATCH_BITS = list(dict.fromkeys(fixed.MATCH_TERMS))


def pair_texts(spark, d):
    """Pairs with the per-side columns the text matchers need, computed once per side; what pairs compare are sets of bits."""
    bits = vocabulary.found_bits
    terms, long_words = vocabulary.match_terms, vocabulary.long_words
    low = F.lower(matching.job_text(c("title"), c("description")))
    left = people(spark, d).select(
        c("id").alias("resume_id"), "ats_score", "candidate_level", terms(F.lower("text")).alias("resume_terms"),
        long_words(c("text")).alias("resume_words"), vocabulary.find_skills(F.lower("text"), fixed.TECHNICAL_SKILLS).alias("technical"),
        vocabulary.find_skills(F.lower("text"), fixed.SOFT_SKILLS).alias("soft"),
        bits(lambda t: F.contains(F.lower("text"), F.lit(t)), MATCH_BITS).alias("resume_bits"))
    left = left.select("*", *[vocabulary.item_bits(F.transform(n, F.lower), names).alias(f"{n}_bits") for n, names in SKILL_BITS.items()],
                       *[F.size(n).alias(f"n_{n}") for n in SKILL_BITS])
    right = table(spark, d, JOBS).select(
        c("id").alias("job_id"), low.alias("job_low"), terms(low).alias("job_terms"), long_words(c("description")).alias("job_words"),
        "salary", matching.job_age_days(c("posted_date"), F.lit(AS_OF)).alias("age"), bits(lambda t: F.contains(low, F.lit(t)), MATCH_BITS).alias("job_bits"),
        *[bits(lambda t: F.contains(low, F.lit(t)), names).alias(f"job_{n}_bits") for n, names in SKILL_BITS.items()])
    # a job's texts: as read, in lower case and as words
    chars = table(spark, d, JOBS).select(F.length(matching.job_text(c("title"), c("description"))).alias("n"))
    return met_pairs(shown_pairs(spark, d), left, right, grid(chars, c("n")))


def _curve(sim, steps, tail):
    return "CASE " + " ".join(f"WHEN {sim} >= {at} THEN {base} + ({sim} - {at}) * {slope}" for at, base, slope in steps) + f" ELSE {sim} * {tail} END"


PENALTY_SQL = "CASE " + " ".join(f"WHEN candidate_level = {lit(cand)} AND job_level = {lit(job)} THEN {p}"
                                 for cand, row in fixed.SENIORITY_PENALTY.items() for job, p in row.items()) + " ELSE 0.0 END"
LEVEL_SQL = "CASE " + " ".join(f"WHEN raw >= {at} THEN {lit(n)}" for at, n in fixed.MATCH_LEVELS[:-1]) + " ELSE 'poor' END"
JOB_SIDE = f"""SELECT j.*, CAST(v.vector AS DOUBLE[]) AS job_vector, {job_seniority_sql()} AS job_level,
  len(list_filter(regexp_split_to_array(concat(title, ' ', description), '\\s+'), lambda w: w <> '')) < 100 AS snippet
  FROM ({D(JOBS)}) j JOIN ({D(JOB_VECTORS)}) v ON v.job_id = j.id"""


def score_pairs_sql(pairs):
    """CTEs ``person``, ``job`` and ``pair``, the last with every score column of the pairs."""
    return f"""person AS (SELECT id AS resume_id, text, coalesce(ats_score, 0) AS ats_score, coalesce(candidate_level, 'entry') AS candidate_level, CAST(vector AS DOUBLE[]) AS resume_vector FROM ({D(PEOPLE)})),
job AS ({JOB_SIDE}),
pair AS (SELECT *, round(least(100.0, greatest(0.0, semantic + quality - penalty)), 9) AS raw FROM (SELECT *,
    CASE WHEN snippet THEN {_curve('similarity', fixed.SNIPPET_CURVE, fixed.SNIPPET_TAIL)}
      ELSE {_curve('similarity', fixed.FULL_CURVE, fixed.FULL_TAIL)} END AS semantic,
    ats_score / 100.0 * CASE WHEN snippet THEN 10.0 ELSE 15.0 END AS quality, CAST({PENALTY_SQL} AS DOUBLE) AS penalty
  FROM (SELECT p.resume_id, j.id AS job_id, r.text, j.title, j.description, ats_score, candidate_level, job_level, snippet,
      coalesce(round(list_cosine_similarity(resume_vector, job_vector), 12), 0) AS similarity
    FROM {pairs} p JOIN person r ON r.resume_id = p.resume_id JOIN job j ON j.id = p.job_id)))"""


PAIR_SQL = f"WITH {score_pairs_sql(f'({D(PAIRS)})')} "


def pair_query(name, build, expr):
    """One value per pair from the scored pairs."""
    QUERIES[name] = lambda spark, d: scored_pairs(spark, d).select("resume_id", "job_id", build().alias("value"))
    SQL[name] = f"{PAIR_SQL} SELECT resume_id, job_id, {expr} AS value FROM pair"


pair_query("cosine", lambda: F.round("similarity", 6), "round(similarity, 6)")
pair_query("semantic_score", lambda: F.round(matching.semantic_score(c("similarity"), c("snippet")), 4), "round(semantic, 4)")
pair_query("ats_contribution", lambda: F.round(matching.ats_contribution(c("ats_score"), c("snippet")), 4), "round(quality, 4)")
pair_query("seniority_penalty", lambda: matching.seniority_penalty(c("candidate_level"), c("job_level")), "penalty")


@query("match_pairs", f"{PAIR_SQL} SELECT resume_id, job_id, round(raw, 1) AS match_score, job_level, snippet FROM pair")
def _(spark, d):
    return scored_pairs(spark, d).select("resume_id", "job_id", "match_score", "job_level", "snippet")


@query("match_score", f"""{PAIR_SQL} SELECT resume_id, job_id, round(raw, 1) AS match_score, round(similarity * 100, 1) AS semantic_similarity,
  round(quality, 1) AS ats_contribution, penalty AS seniority_penalty, {LEVEL_SQL} AS match_level FROM pair""")
def _(spark, d):
    return scored_pairs(spark, d).select("resume_id", "job_id", "match_score", "semantic_similarity", "ats_contribution",
                                         "seniority_penalty", "match_level")


@query("match_batch_summary", f"""{PAIR_SQL} SELECT resume_id, round(sum(CAST(round(round(raw, 1) * 10) AS BIGINT)) / (count(*) * 10), 4) AS avg_score,
  count(*) FILTER (round(raw, 1) >= 50) AS good_matches, count(*) AS total FROM pair GROUP BY resume_id""")
def _(spark, d):
    return match_batch_summary(scored_pairs(spark, d)).withColumn("avg_score", F.round("avg_score", 4))


TERMS = "[" + ", ".join(lit(t) for t in fixed.MATCH_TERMS) + "]"
COMMON = f"list_filter({TERMS}, lambda t: contains(lower(text), t) AND contains(lower(concat(title, ' ', description)), t))"
PAIR_TEXT_SQL = f"""WITH person AS (SELECT *, list_filter({TERMS}, lambda t: contains(lower(text), t)) AS rt FROM ({D(PEOPLE)})),
job AS (SELECT *, lower(concat(title, ' ', description)) AS job_low,
  list_filter({TERMS}, lambda t: contains(lower(concat(title, ' ', description)), t)) AS jt FROM ({D(JOBS)})),
shared AS (SELECT p.resume_id, p.job_id, list_filter(rt, lambda t: list_contains(jt, t)) AS common
  FROM ({D(PAIRS)}) p JOIN person r ON r.id = p.resume_id JOIN job j ON j.id = p.job_id),
kept AS (SELECT *, list_filter(common, lambda t, i: len(list_filter(common[1:i - 1], lambda m: contains(m, t))) = 0) AS matched FROM shared),
best AS (SELECT *, list_transform(list_sort(list_transform(matched, lambda t, i: {{'n': -length(t), 'i': i, 't': t}})),
  lambda r: r.t)[1:5] AS top FROM kept) """


@query("matched_terms", PAIR_TEXT_SQL + "SELECT resume_id, job_id, coalesce(array_to_string(matched, '|'), '') AS value FROM kept")
def _(spark, d):
    return pair_texts(spark, d).select("resume_id", "job_id", joined(vocabulary.matched_by_bits(c("resume_bits"), c("job_bits"), MATCH_BITS)).alias("value"))


@query("topk_terms", PAIR_TEXT_SQL + "SELECT resume_id, job_id, coalesce(array_to_string(top, '|'), '') AS value FROM best")
def _(spark, d):
    return pair_texts(spark, d).select("resume_id", "job_id", joined(vocabulary.topk_by_bits(c("resume_bits"), c("job_bits"), MATCH_BITS)).alias("value"))


def _cases(rows, col, fill="{}"):
    return "CASE " + " ".join(f"WHEN {col} >= {at} THEN {lit(text)}" for at, text in rows if at is not None) + (
        f" ELSE {lit(rows[-1][1])}" if rows[-1][0] is None else "") + " END"


def reasons_sql(top):
    gap = ("CASE " + " ".join(
        f"WHEN penalty >= {at} THEN " + " || ".join(
            [lit(part) if k % 2 == 0 else part for k, part in enumerate(_weave(text.split("%s"), ["job_level", "candidate_level"]))])
        for at, text in say.GAP_REASONS) + " END")
    return f"""list_filter([{gap}, CASE WHEN penalty >= 20 THEN {_cases(say.GAP_QUALITY, 'raw')} ELSE {_cases(say.QUALITY, 'raw')} END,
    {_cases(say.SIMILARITY_REASONS, 'similarity')}, {_cases(say.RESUME_QUALITY_REASONS, 'ats_score')},
    CASE WHEN len({top}) > 0 THEN {lit(say.SKILL_REASON)} || array_to_string({top}, ', ') END], lambda r: r IS NOT NULL)"""


def _weave(parts, values):
    out = [parts[0]]
    for part, value in zip(parts[1:], values):
        out += [value, part]
    return out


@query("match_reasons", PAIR_TEXT_SQL.replace("WITH person AS", "WITH person0 AS").replace("job AS (SELECT", "job0 AS (SELECT").replace(
    "JOIN person r", "JOIN person0 r").replace("JOIN job j", "JOIN job0 j") + f", {score_pairs_sql(f'({D(PAIRS)})')} " + f"""
  SELECT p.resume_id, p.job_id, array_to_string({reasons_sql('top')}, '|') AS value FROM pair p JOIN best b
  ON b.resume_id = p.resume_id AND b.job_id = p.job_id""")
def _(spark, d):
    low = F.lower(matching.job_text(c("title"), c("description")))
    told = match_pairs(shown_pairs(spark, d),
                       resume_side(people(spark, d), more=[vocabulary.match_terms(F.lower("text")).alias("resume_terms")], lean=True),
                       job_side(jobs_with_vectors(spark, d), more=[vocabulary.match_terms(low).alias("job_terms")], lean=True))
    reasons = matching.match_reasons(c("similarity"), c("ats_score"), c("raw_score"), c("seniority_penalty"), c("candidate_level"),
                                     c("job_level"), c("resume_terms"), c("job_terms"))
    return told.select("resume_id", "job_id", joined(reasons).alias("value"))


WORDS_SQL = f"""WITH person AS (SELECT id, coalesce(ats_score, 0) AS ats_score, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'),
  lambda w: length(w) > 3)) AS rw FROM ({D(PEOPLE)})),
job AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(description), '\\s+'), lambda w: length(w) > 3)) AS jw FROM ({D(JOBS)})),
pair AS (SELECT p.resume_id, p.job_id, ats_score, len(jw) AS n, list_filter(jw, lambda w: list_contains(rw, w)) AS common
  FROM ({D(PAIRS)}) p JOIN person r ON r.id = p.resume_id JOIN job j ON j.id = p.job_id) """


@query("common_words", WORDS_SQL + "SELECT resume_id, job_id, coalesce(array_to_string(common, '|'), '') AS value FROM "
                                   "(SELECT resume_id, job_id, list_sort(common) AS common FROM pair)")
def _(spark, d):
    both = F.array_intersect("job_words", "resume_words")
    return pair_texts(spark, d).select("resume_id", "job_id", joined(F.array_sort(both)).alias("value"))


@query("match_keyword", WORDS_SQL + f"""SELECT resume_id, job_id, round(raw, 1) AS match_score, round(len(common) / n * 100, 1) AS keyword_overlap,
  round(ats_score / 100 * 40, 1) AS ats_contribution, {LEVEL_SQL} AS match_level,
  'Keyword overlap: ' || len(common) || ' common terms' AS reasons
  FROM (SELECT *, least(100.0, len(common) / n * 60 + ats_score / 100 * 40) AS raw FROM pair)""")
def _(spark, d):
    m = matching.match_keyword(c("resume_words"), c("job_words"), c("ats_score"))
    return pair_texts(spark, d).select("resume_id", "job_id", m.alias("m")).select(
        "resume_id", "job_id", "m.match_score", "m.keyword_overlap", "m.ats_contribution", "m.match_level", joined(c("m.reasons")).alias("reasons"))


def _skill_list(found, names):
    return f"list_filter([{', '.join(lit(n) for n in names)}], lambda t: list_contains({found}, t))"


RULES_SQL = features(PEOPLE.replace("SELECT r.id, r.text", "SELECT r.id AS doc_id, r.id, r.text")) + f""", person AS (
  SELECT src.id, coalesce(src.ats_score, 0) AS ats_score, {_skill_list('skills', fixed.TECHNICAL_SKILLS)} AS technical, {_skill_list('skills', fixed.SOFT_SKILLS)} AS soft
  FROM features JOIN src USING (doc_id)),
job AS (SELECT id, lower(concat(title, ' ', description)) AS low, salary,
  (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(posted_date)) / 86400e6 AS age FROM ({D(JOBS)})),
hits AS (SELECT p.resume_id, p.job_id, ats_score, technical, soft, salary, age, list_filter(technical, lambda t: contains(low, t)) AS th,
  list_filter(soft, lambda t: contains(low, t)) AS sh FROM ({D(PAIRS)}) p JOIN person r ON r.id = p.resume_id JOIN job j ON j.id = p.job_id),
ruled AS (SELECT *, least(100.0, coalesce(len(th) / nullif(len(technical), 0) * 40, 0) + coalesce(len(sh) / nullif(len(soft), 0) * 15, 0)
  + ats_score / 100 * 20 + CASE WHEN age <= 7 THEN 15 WHEN age <= 14 THEN 12 WHEN age <= 30 THEN 8 ELSE 4 END
  + CASE WHEN coalesce(salary, '') NOT IN ('', 'Not specified') THEN 10 ELSE 0 END) AS score FROM hits) """


def _skills_found(name):
    return vocabulary.shared_bits(c(f"{name}_bits"), c(f"job_{name}_bits"), SKILL_BITS[name])


def _rule_score():
    return matching.match_rules_counted(c("salary"), c("age"), _skills_found("technical"), c("n_technical"), _skills_found("soft"), c("n_soft"), c("ats_score"))


@query("match_rules", RULES_SQL + "SELECT resume_id, job_id, round(score, 1) AS match_score FROM ruled")
def _(spark, d):
    return pair_texts(spark, d).select("resume_id", "job_id", F.round(_rule_score(), 1).alias("match_score"))


@query("rule_reasons", RULES_SQL + """SELECT resume_id, job_id, coalesce(array_to_string(list_filter([CASE WHEN score >= 80 THEN
    'Excellent match for your skills and experience' WHEN score >= 60 THEN 'Good match for your profile' WHEN score >= 40 THEN
    'Moderate match - consider applying' END, CASE WHEN len(th) > 0 THEN 'Matches your skills: ' || array_to_string(th[1:3], ', ') END,
    CASE WHEN floor(age) <= 3 THEN 'Recently posted - apply quickly!' END], lambda r: r IS NOT NULL), '|'), '') AS value FROM ruled""")
def _(spark, d):
    scored = pair_texts(spark, d).withColumn("score", _rule_score())
    named = F.when(_skills_found("technical") > 0, vocabulary.cap_matched_skills(c("technical"), c("job_low"))).otherwise(F.array().cast("array<string>"))
    return scored.select("resume_id", "job_id", joined(matching.rule_reasons_named(c("score"), named, c("age"))).alias("value"))


@query("skill_contains", RULES_SQL + "SELECT resume_id, job_id, coalesce(array_to_string(th, '|'), '') AS value FROM hits")
def _(spark, d):
    return pair_texts(spark, d).select("resume_id", "job_id", joined(vocabulary.contained_skills(c("technical"), c("job_low"))).alias("value"))


@query("cap_matched_skills", RULES_SQL + "SELECT resume_id, job_id, coalesce(array_to_string(th[1:3], '|'), '') AS value FROM hits")
def _(spark, d):
    return pair_texts(spark, d).select("resume_id", "job_id", joined(vocabulary.cap_matched_skills(c("technical"), c("job_low"))).alias("value"))


# Every resume with the whole catalogue, not only with the jobs it was shown.
RULE_HITS_SQL = RULES_SQL.split("hits AS (")[0] + """
skill_of_job AS (SELECT *, list_filter([{names}], lambda t: contains(low, t)) AS job_skills FROM job),
hits AS (SELECT p.id AS resume_id, j.id AS job_id, ats_score, technical, soft, salary, age, list_intersect(technical, job_skills) AS th, list_intersect(soft, job_skills) AS sh
  FROM person p, skill_of_job j),
ruled AS (""".replace("{names}", ", ".join(lit(n) for n in dict.fromkeys([*fixed.TECHNICAL_SKILLS, *fixed.SOFT_SKILLS]))) + RULES_SQL.split("ruled AS (")[1]


@query("rule_matches", RULE_HITS_SQL + """SELECT resume_id, job_id, match_score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, job_id) AS rank
  FROM (SELECT resume_id, job_id, round(score, 1) AS match_score FROM ruled)) WHERE rank <= 20""")
def _(spark, d):
    who = people(spark, d).select(c("id").alias("resume_id"), "ats_score", *rules.rule_resume_columns(), F.lit(False).alias("encoded"))
    jobs = table(spark, d, JOBS).select(c("id").alias("job_id"), c("id").alias("seq"), *rules.rule_job_columns("posted_date", AS_OF), F.lit(False).alias("encoded"))
    order = Window.partitionBy("resume_id").orderBy(F.desc("match_score"), "job_id")
    return rules.rule_matches(who, jobs).select("resume_id", "job_id", "match_score", F.row_number().over(order).cast("bigint").alias("rank"))


# ------------------------------------------------------------------- vectors
IDEAL_SQL = """(SELECT label, list(x ORDER BY pos) AS v FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label,
  unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos) GROUP BY label)"""


def ideals(spark, d):
    """Mean vector per label as one array of unit vectors: labels x dimensions values, as a scalar subquery."""
    flat = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    means = flat.groupBy("label", "pos").agg(F.avg(c("x").cast("double")).alias("x"))
    one = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return one.agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "v"))), lambda s: vectors.unit(s["v"])).alias("all")).scalar()


def corpus_vectors(spark, d, sql=CORPUS_VECTORS):
    return table(spark, d, sql).withColumn("ideals", ideals(spark, d))


def semantic_sql(k=5):
    return f"""near AS (SELECT doc_id, avg(s) AS mean_top FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r
  FROM (SELECT doc_id, list_cosine_similarity(CAST(vector AS DOUBLE[]), v) AS s FROM ({D(CORPUS_VECTORS)}), {IDEAL_SQL}))
  WHERE r <= {k} GROUP BY doc_id)"""


@query("topk_mean_similarity", f"WITH {semantic_sql()} SELECT doc_id, round(mean_top, 6) AS value FROM near")
def _(spark, d):
    sims = vectors.similarities(c("vector"), c("ideals"))
    return corpus_vectors(spark, d).select("doc_id", F.round(vectors.topk_mean_similarity(sims, 5), 6).alias("value"))


@query("semantic_to_ideal", f"WITH {semantic_sql()} SELECT doc_id, CASE WHEN mean_top IS NOT NULL THEN round(least(20.0, mean_top * 22), 4) END AS value FROM near")
def _(spark, d):
    return corpus_vectors(spark, d).select("doc_id", F.round(vectors.semantic_to_ideal(c("vector"), c("ideals")), 4).alias("value"))


ENCODED_SQL = f"""words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^{W}]+'), lambda w: w <> '')) AS word FROM ({D(CORPUS)})),
counted AS (SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 7))::BIGINT % 4096 AS INT) AS bucket, count(*) AS n FROM words GROUP BY ALL)"""


@query("encode", f"""WITH {ENCODED_SQL} SELECT doc_id, bucket,
  round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM counted""")
def _(spark, d):
    # of a plain explode Spark infers filters on the vectors, which it pushes below the encoder: it would run three times
    coded = encode_hashed(table(spark, d, CORPUS)).select("doc_id", F.explode_outer("vector").alias("x")).where("x IS NOT NULL")
    return coded.select("doc_id", c("x.bucket").alias("bucket"), F.round("x.weight", 6).alias("weight"))


# Few buckets, so that the encoder's vectors are short enough to be plain arrays.
BUCKETS = 256
COUNTED_SQL = f"""words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^{W}]+'), lambda w: w <> '')) AS word FROM (
    SELECT doc_id, text FROM ({D(CORPUS)}) UNION ALL SELECT concat('ideal', CAST(i AS VARCHAR)), s
    FROM (SELECT unnest(range({len(fixed.IDEAL_SENTENCES)})) AS i, unnest([{', '.join(lit(x) for x in fixed.IDEAL_SENTENCES)}]) AS s))),
counted AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 7))::BIGINT % {BUCKETS} AS bucket, count(*) AS n FROM words GROUP BY ALL),
scaled AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM counted)"""


@query("semantic_to_sentences", f"""WITH {COUNTED_SQL}, sims AS (
  SELECT c.doc_id, i.doc_id AS ideal, coalesce(sum(d.w * i.w), 0) AS s FROM (SELECT doc_id FROM ({D(CORPUS)})) c
  CROSS JOIN (SELECT * FROM scaled WHERE starts_with(doc_id, 'ideal')) i LEFT JOIN scaled d ON d.doc_id = c.doc_id AND d.bucket = i.bucket
  GROUP BY ALL)
SELECT doc_id, round(least(20.0, avg(s) * 22), 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) AS r FROM sims)
WHERE r <= 5 GROUP BY doc_id""")
def _(spark, d):
    def encoder(df):
        return encode_hashed(df, features=BUCKETS).withColumn("vector", dense(c("vector"), BUCKETS))

    points = vectors.semantic_to_ideal(c("vector"), c("ideals"), sparse=True)
    return encoder(table(spark, d, CORPUS)).withColumn("ideals", ideal_vectors(spark, encoder)).select("doc_id", F.round(points, 4).alias("value"))


@query("candidate_pairs", f"""WITH {score_pairs_sql(f'(SELECT r.id AS resume_id, j.id AS job_id FROM ({D(PEOPLE)}) r, ({D(JOBS)}) j)')}
  SELECT resume_id, job_id, match_score, round(similarity, 6) AS similarity, CAST(rank AS BIGINT) AS rank FROM (SELECT *,
    row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, job_id) AS rank
    FROM (SELECT *, round(raw, 1) AS match_score FROM pair)) WHERE rank <= 20""")
def _(spark, d):
    best = top_matches(resume_side(people(spark, d)), job_side(jobs_with_vectors(spark, d)))
    return best.select("resume_id", "job_id", "match_score", F.round("similarity", 6).alias("similarity"), c("rank").cast("bigint").alias("rank"))


# -------------------------------------------------------------------- scores
H, L, R = fixed.HYBRID, fixed.LEGACY, fixed.RULES
LEVEL = "level"
RATIO = "(quantified_bullets / nullif(total_bullets, 0))"
PROJECTS = "len(projects)"
DETAILS = "(2 + CAST(institution IS NOT NULL AS INT) + CAST(graduation_year IS NOT NULL AS INT))"
LINK = "(linkedin IS NOT NULL OR github IS NOT NULL)"
EITHER = "(email IS NOT NULL OR phone IS NOT NULL)"


def _steps(value, steps):
    return by_level(LEVEL, {k: ladder(value, v) for k, v in steps.items()})


def _rows(value, rows):
    return by_level(LEVEL, {k: bands(value, v) for k, v in rows.items()})


HYBRID_SQL = {
    "ml_semantic_score": "least(20.0, mean_top * 22)", "file_type_score": "5.0",
    "layout_score": "CASE layout WHEN 'complex' THEN 2.0 WHEN 'multi_column' THEN 4.0 ELSE 6.0 END",
    "sections_score": ladder("len(sections)", H["sections"]), "date_consistency_score": "date_score",
    "contact_info_score": f"CASE WHEN has_contact THEN CASE WHEN {LINK} THEN 3.0 ELSE 2.0 END WHEN {EITHER} THEN 1.0 ELSE 0.0 END",
    "bullet_density_score": f"CASE WHEN jobs > 0 THEN {bands('(total_bullets / nullif(jobs, 0))', fixed.BULLET_DENSITY)} ELSE 0.0 END",
    "summary_score": "summary", "skills_clarity_score": ladder("len(skills)", H["skills_clarity"]),
    "experience_completeness_score": by_level(LEVEL, {
        "entry": f"CASE WHEN jobs = 1 THEN CASE WHEN {PROJECTS} >= 3 THEN 4.0 ELSE 2.0 END ELSE {ladder('jobs', H['experience']['entry'])} END",
        "mid": ladder("jobs", H["experience"]["mid"]), "senior": ladder("jobs", H["experience"]["senior"])}),
    "projects_detail_score": _steps(PROJECTS, H["projects"]), "hard_skills_score": ladder("len(skills)", H["hard_skills"]),
    "action_verbs_score": ladder("len(verbs)", H["action_verbs"]), "quantification_score": ladder(RATIO, H["quantification"]),
    "education_details_score": by_level(LEVEL, {
        "entry": f"CASE WHEN degrees = 0 THEN 0.0 ELSE {ladder(DETAILS, H['education_entry'], '1.0')} END",
        "mid": "CASE degrees WHEN 0 THEN 0.0 ELSE 5.0 END", "senior": "CASE degrees WHEN 0 THEN 2.0 ELSE 6.0 END"}),
    "certifications_score": "certificates", "grammar_score": "grammar", "tone_score": "tone",
    "length_score": _rows("word_count", fixed.LENGTH_BANDS), "tailoring_bonus": "CASE WHEN tailored THEN 2.0 ELSE 0.0 END",
    "leadership_bonus": "CASE WHEN leads THEN 1.5 ELSE 0.0 END", "oss_bonus": "CASE WHEN open_source THEN 0.5 ELSE 0.0 END",
    "contact_penalty": "CASE WHEN has_contact THEN 0.0 ELSE -10.0 END", "dates_penalty": "date_penalty"}
VERBS_NUMBERS = "CASE " + " ".join(f"WHEN len(verbs) >= {v} AND len(numbers) >= {n} THEN {p}" for v, n, p in R["verbs_and_numbers"]) + " ELSE 0.0 END"


RULES_SCORE = f"""least(100.0, CASE WHEN has_contact THEN 8.0 WHEN {EITHER} THEN 4.0 ELSE 0.0 END
  + {ladder('len(sections)', R['sections'], 'len(sections) / 6 * 12')} + least(len(verbs) / 12 * 15, 15.0) + least(len(numbers) / 10 * 18, 18.0)
  + {bands('word_count', R['words'], '6.0')} + {ladder('len(sections)', R['section_bonus'])} + {VERBS_NUMBERS} + {ladder('len(skills)', R['skills'])})"""


LEVELED = "leveled AS (SELECT *, CASE WHEN experience_level IN ('entry', 'mid', 'senior') THEN experience_level ELSE 'entry' END AS level FROM features)"
# Rows without a vector are scored by the rules and have no parts.
PARTS = ", ".join(f"CASE WHEN mean_top IS NOT NULL THEN CAST({expr} AS DOUBLE) END AS {name}" for name, expr in HYBRID_SQL.items())
BASE = " + ".join(n for n in HYBRID_SQL if not n.endswith(("bonus", "penalty")))
SCORED_SQL = features() + f""", {semantic_sql()}, {LEVELED},
parts AS (SELECT leveled.*, mean_top, {PARTS} FROM leveled JOIN near USING (doc_id)),
scored AS (SELECT *, {BASE} AS base, CASE WHEN mean_top IS NOT NULL THEN round(least(100.0, greatest(0.0, {BASE} + tailoring_bonus
  + leadership_bonus + oss_bonus + contact_penalty + dates_penalty)), 1) ELSE {RULES_SCORE} END AS score FROM parts),
final AS (SELECT *, CASE WHEN mean_top IS NOT NULL THEN score END AS total FROM scored) """


def featured(spark, d):
    return extract_features(corpus_vectors(spark, d))


def semantic():
    return vectors.semantic_to_ideal(c("vector"), c("ideals"))


def scored_corpus(spark, d):
    return score_features(featured(spark, d), semantic=semantic())


@query("ats_score_hybrid", SCORED_SQL + "SELECT doc_id, round(base, 1) AS base_score, total AS total_score, "
       + ", ".join(f"round({n}, 1) AS {n}" for n in HYBRID_SQL) + " FROM final")
def _(spark, d):
    return scored_corpus(spark, d).select("doc_id", "breakdown.base_score", "breakdown.total_score",
                                          *[c(f"breakdown.{n}") for n in HYBRID_SQL])


@query("category_rollup", SCORED_SQL + "SELECT doc_id, " + ", ".join(
    f"round({' + '.join(members)}, 1) AS {name}" for name, members in scores.CATEGORIES.items()) + " FROM final")
def _(spark, d):
    return scored_corpus(spark, d).select("doc_id", "breakdown.category_scores.*")


NAMED = "(institution IS NOT NULL AND degrees > 0)"
LEGACY_SQL = {
    "contact_info_score": f"CASE WHEN has_contact THEN 3.0 WHEN {EITHER} THEN 1.5 ELSE 0.0 END",
    "professional_identity_score": f"CAST(name IS NOT NULL AS INT) + CAST({LINK} AS INT)",
    "sections_score": ladder("len(sections)", L["sections"]),
    "education_score": by_level(LEVEL, {
        "entry": f"CASE WHEN degrees = 0 THEN 0.0 WHEN {NAMED} THEN 6.0 ELSE 2.0 END",
        "mid": f"CASE WHEN degrees = 0 THEN 0.0 WHEN {NAMED} THEN 5.0 ELSE 2.5 END", "senior": "CASE WHEN degrees = 0 THEN 0.0 ELSE 4.0 END"}),
    "work_experience_score": by_level(LEVEL, {
        "entry": f"CASE jobs WHEN 0 THEN {ladder(PROJECTS, L['no_job_projects'])} WHEN 1 THEN {ladder(PROJECTS, L['one_job_projects'])} "
                 f"ELSE {ladder('jobs', L['experience']['entry'])} END",
        "mid": ladder("jobs", L["experience"]["mid"]), "senior": ladder("jobs", L["experience"]["senior"])}),
    "projects_score": _steps(PROJECTS, L["projects"]), "action_verbs_score": ladder("len(verbs)", L["action_verbs"]),
    "skills_score": ladder("len(skills)", L["skills"]),
    "quantification_score": f"CASE WHEN total_bullets > 0 THEN {ladder(RATIO, L['quantification'])} ELSE {ladder('len(numbers)', L['numbers'])} END",
    "content_density_score": bands("word_count", fixed.LEGACY_DENSITY), "bullet_points_score": _rows("total_bullets", fixed.LEGACY_BULLETS)}


@query("ats_score_legacy", features() + f""", {semantic_sql(3)}, {LEVELED}, parts AS (SELECT doc_id, coalesce(mean_top, 0) * 20 AS ml,
  {', '.join(f'CAST({e} AS DOUBLE) AS {n}' for n, e in LEGACY_SQL.items())} FROM leveled JOIN near USING (doc_id))
  SELECT doc_id, round(ml, 1) AS ml_semantic_score, {', '.join(f'round({n}, 1) AS {n}' for n in LEGACY_SQL)},
  round({' + '.join(LEGACY_SQL)}, 1) AS rule_based_score, round(least(100.0, greatest(0.0, ml + {' + '.join(LEGACY_SQL)})), 1) AS total_score FROM parts""")
def _(spark, d):
    f = featured(spark, d).withColumn("level", resolve_level(c("experience_level")))
    mean = vectors.semantic_to_ideal(c("vector"), c("ideals"), k=3, weight=1.0, most=None)
    return f.withColumn("_mean", mean).select("doc_id", scores.ats_score_legacy(f, c("level"), c("_mean")).alias("s")).select("doc_id", "s.*")


def rules_scored_sql(source):
    """Scores without an encoder; ``final`` keeps the unrounded score, which the messages use."""
    return features(source) + f", {LEVELED}, final AS (SELECT *, {RULES_SCORE} AS score FROM leveled) "


@query("ats_score_rules", features() + f"SELECT doc_id, round({RULES_SCORE}, 4) AS score FROM features")
def _(spark, d):
    f = featured(spark, d)
    return f.select("doc_id", F.round(scores.ats_score_rules(f), 4).alias("score"))


STATUS_SQL = "CASE " + " ".join(f"WHEN score >= {at} THEN {lit(n)}" for at, n, _ in fixed.STATUS[:-1]) + f" ELSE {lit(fixed.STATUS[-1][1])} END"
MESSAGE_SQL = "CASE " + " ".join(f"WHEN score >= {at} THEN {lit(m)}" for at, _, m in fixed.STATUS[:-1]) + f" ELSE {lit(fixed.STATUS[-1][2])} END"


@query("ats_status", SCORED_SQL + f"SELECT doc_id, round(score, 1) AS score, {STATUS_SQL} AS status, {MESSAGE_SQL} AS status_message FROM final")
def _(spark, d):
    return scored_corpus(spark, d).select("doc_id", "score", "status", "status_message")


def _case(*pairs):
    return "CASE " + " ".join(f"WHEN {cond} THEN {text}" for cond, text in pairs) + " END"


def _fill(template, *values):
    """A message with its numbers, as SQL concatenation."""
    text, out = template.replace("%%", "\0"), []
    for i, part in enumerate(text.replace("%s", "%d").split("%d")):
        out.append(lit(part.replace("\0", "%")))
        if i < len(values):
            out.append(f"CAST({values[i]} AS VARCHAR)")
    return " || ".join(out)


I, A = say.INSIGHT, say.ADVICE
LABEL = by_level("level", {k: lit(v) for k, v in say.LEVEL_LABELS.items()})
NV, NN, NS, NSEC = "len(verbs)", "len(numbers)", "len(skills)", "len(sections)"
INSIGHTS_SQL = "list_filter([" + ", ".join([
    _case(*[(f"score >= {at}" if at else "true", _fill(t, LABEL)) for at, t in say.HEADLINES]),
    _case(("has_contact", lit(I["contact"]))),
    _case(("linkedin IS NOT NULL AND github IS NOT NULL", lit(I["both_links"])), (LINK, lit(I["one_link"]))),
    _case(("degrees = 1", lit(I["degree"]))),
    _case(("jobs >= 3", _fill(I["jobs_3"], "jobs")), ("jobs = 2", _fill(I["jobs_2"], "jobs")), ("jobs = 1", lit(I["jobs_1"]))),
    _case((f"{PROJECTS} >= 3", _fill(I["projects_3"], PROJECTS)), (f"{PROJECTS} = 2", _fill(I["projects_2"], PROJECTS)),
          (f"{PROJECTS} = 1", lit(I["projects_1"]))),
    _case((f"{NSEC} >= 5", _fill(I["sections_5"], NSEC)), (f"{NSEC} >= 3", _fill(I["sections_3"], NSEC))),
    _case((f"{NV} >= 10", _fill(I["verbs_10"], NV)), (f"{NV} >= 5", _fill(I["verbs_5"], NV))),
    _case((f"{NN} >= 5", _fill(I["numbers_5"], NN)), (f"{NN} >= 3", _fill(I["numbers_3"], NN))),
    _case((f"{NS} >= 10", _fill(I["skills_10"], NS)), (f"{NS} >= 5", _fill(I["skills_5"], NS))),
    _case(("word_count BETWEEN 400 AND 900", lit(I["length_good"])), ("word_count BETWEEN 300 AND 399", lit(I["length_fair"]))),
]) + "], lambda x: x IS NOT NULL)"

B, Q = "total_bullets", "quantified_bullets"
START_SQL = ", ".join([
    _case(("name IS NULL", lit(A["name"]))),
    _case((f"NOT {LINK} AND level = 'entry'", lit(A["links_entry"])), (f"NOT {LINK}", lit(A["links"]))),
    _case(("email IS NULL", lit(A["email"]))), _case(("phone IS NULL", lit(A["phone"]))),
    _case(("degrees = 0", lit(A["education"])), ("institution IS NULL", lit(A["institution"]))),
    _case(("level = 'entry' AND jobs = 0 AND len(projects) < 3", lit(A["entry_jobs_0"])), ("level = 'entry' AND jobs = 1", lit(A["entry_jobs_1"])),
          *[(f"level = 'mid' AND jobs = {n}", lit(A[f"mid_jobs_{n}"])) for n in (0, 1, 2)],
          ("level = 'senior' AND jobs < 3", lit(A["senior_jobs_few"])), ("level = 'senior' AND jobs = 3", lit(A["senior_jobs_3"]))),
    _case(("level = 'entry' AND jobs = 0 AND len(projects) < 3", lit(A["entry_jobs_0_projects"]))),
    _case(*[(f"level = 'entry' AND len(projects) = {n}", lit(A[f"entry_projects_{n}"])) for n in (0, 1, 2)],
          ("level = 'mid' AND len(projects) = 0 AND jobs < 3", lit(A["mid_projects_0"])), ("level = 'mid' AND len(projects) = 1", lit(A["mid_projects_1"])),
          ("level = 'senior' AND len(projects) = 0", lit(A["senior_projects_0"]))),
    _case(*[(f"level = '{lv}' AND {B} < {n}", _fill(A[f"{lv}_bullets_{k}"], B)) for lv, n, k in (
        ("entry", 10, "low"), ("entry", 12, "fair"), ("mid", 20, "low"), ("mid", 25, "fair"), ("senior", 30, "low"), ("senior", 35, "fair"))])])
END_SQL = ", ".join([
    _case((f"{NV} < 5", lit(A["verbs_low"])), (f"{NV} < 10", lit(A["verbs_fair"]))),
    _case((f"{RATIO} < 0.3", _fill(A["quantified_low"], Q, B)), (f"{RATIO} < 0.5", _fill(A["quantified_fair"], Q, B)),
          (f"{RATIO} < 0.7", _fill(A["quantified_good"], Q, B)), (f"{B} = 0 AND {NN} < 3", lit(A["numbers_low"])),
          (f"{B} = 0 AND {NN} < 5", lit(A["numbers_fair"]))),
    _case(*[(f"word_count < {n}", lit(A[f"words_{n}"])) for n in (200, 300, 400)],
          *[(f"word_count > {n}", lit(A[f"words_{n}"])) for n in (1200, 900)]),
    _case((f"{NS} < 5", lit(A["skills_low"])), (f"{NS} < 8", lit(A["skills_fair"]))),
    _case(("score < 50", lit(A["score_low"])), ("score < 70", lit(A["score_fair"])))])
SECTIONS_SQL = ("list_transform(list_filter(['experience', 'education', 'skills', 'summary'], lambda s: NOT list_contains(sections, s)), "
                f"lambda s: {_fill(A['section'], 'concat(upper(s[1]), s[2:])')})")
REPEATED_SQL = (f"list_filter(list_transform(verbs, lambda v, i: CASE WHEN verb_counts[i] > 2 THEN "
                f"{_fill(A['repeated'], 'concat(upper(v[1]), v[2:])', 'verb_counts[i]')} END), lambda x: x IS NOT NULL)")
def advised_sql(scored):
    return scored + f""", told AS (SELECT *, list_filter(list_concat([{START_SQL}], {SECTIONS_SQL}, {REPEATED_SQL}, [{END_SQL}]),
  lambda x: x IS NOT NULL) AS said FROM final),
advised AS (SELECT *, {INSIGHTS_SQL} AS insights, CASE WHEN len(list_filter(said, lambda a: contains(lower(a), 'bullet'))) > 0 THEN said
  ELSE list_append(said, {lit(A['bullets'])}) END AS advice FROM told) """


ADVISED_SQL = advised_sql(SCORED_SQL)


@query("insights", ADVISED_SQL + "SELECT doc_id, array_to_string(insights, '|') AS value FROM advised")
def _(spark, d):
    return scored_corpus(spark, d).select("doc_id", joined(c("insights")).alias("value"))


@query("recommendations", ADVISED_SQL + "SELECT doc_id, array_to_string(advice, '|') AS value FROM advised")
def _(spark, d):
    return scored_corpus(spark, d).select("doc_id", joined(c("recommendations")).alias("value"))


GOOD = "(" + " OR ".join(f"contains(lower(x), '{w}')" for w in fixed.QUALITY_WORDS) + ")"
BAD = "(" + " OR ".join(f"contains(lower(x), '{w}')" for w in fixed.DRAWBACK_WORDS) + ")"


@query("highlight_insights", ADVISED_SQL + f"""SELECT doc_id, array_to_string(insights[1:5], '|') AS key_insights,
  coalesce(array_to_string(list_filter(insights, lambda x: {GOOD} OR NOT {BAD})[1:6], '|'), '') AS qualities,
  array_to_string(advice[1:6], '|') AS improvements FROM advised""")
def _(spark, d):
    h = advice.highlight_insights(c("insights"), c("recommendations"))
    return scored_corpus(spark, d).select("doc_id", h.alias("h")).select(
        "doc_id", *[joined(c(f"h.{n}")).alias(n) for n in ("key_insights", "qualities", "improvements")])


def analysis_sql(scored):
    return advised_sql(scored) + f"""SELECT doc_id, trim(text) <> '' AS success, round(score, 1) AS score, {STATUS_SQL} AS status, level, array_to_string(insights, '|') AS insights,
  array_to_string(advice, '|') AS recommendations, CAST(word_count AS BIGINT) AS words, CAST(len(sections) AS BIGINT) AS sections,
  CAST(len(skills) AS BIGINT) AS skills, CAST(len(verbs) AS BIGINT) AS verbs, CAST(len(numbers) AS BIGINT) AS numbers, has_contact,
  CAST({B} AS BIGINT) AS bullets, CAST({Q} AS BIGINT) AS quantified, name, email, phone, location, linkedin, github,
  experience_level, years, CAST(jobs AS BIGINT) AS jobs, CAST({PROJECTS} AS BIGINT) AS projects FROM advised"""


def flat_analysis(df, *more):
    a, m, i = "analysis.", "analysis.metrics.", "analysis.extractedInfo."
    long = {"words": m + "wordCount", "sections": m + "sectionsFound", "skills": m + "skillsFound", "verbs": m + "actionVerbs",
            "numbers": m + "quantifiableMetrics", "bullets": m + "totalBullets", "quantified": m + "quantifiedBullets"}
    return df.select(
        *more, "doc_id", "success", a + "score", a + "status", c(a + "targetLevel").alias("level"), joined(c(a + "insights")).alias("insights"),
        joined(c(a + "recommendations")).alias("recommendations"), *[c(v).cast("bigint").alias(k) for k, v in long.items()],
        c(m + "contactInfoPresent").alias("has_contact"), *[c(i + n) for n in ("name", "email", "phone", "location", "linkedin", "github")],
        c(i + "experienceLevel").alias("experience_level"), c(i + "yearsOfExperience").alias("years"),
        F.size(i + "work_experience").cast("bigint").alias("jobs"), F.size(i + "projects").cast("bigint").alias("projects"))


@query("analyze_resumes", analysis_sql(SCORED_SQL))
def _(spark, d):
    return flat_analysis(analyze_resumes(corpus_vectors(spark, d), semantic=semantic()))


STORED_RESUMES = f"SELECT id, CAST(id AS VARCHAR(20)) AS doc_id, status, text, updated_at FROM ({RESUMES}) AS resumes"
STORED_SQL = analysis_sql(rules_scored_sql(STORED_RESUMES)).replace("SELECT doc_id, trim(text) <> '' AS success,", "SELECT doc_id, 'processed' AS resume_status,")


@query("analyze_pending", STORED_SQL)
def _(spark, d):
    """Resumes in buckets, analysed in two runs: first what was uploaded, then whatever is still pending."""
    path, source = shared_folder(spark, "resumes"), table(spark, d, STORED_RESUMES)
    schema = source.withColumn("analysis", F.lit(None).cast(analysis_type(spark))).schema
    write_buckets(source.withColumn("status", F.when(c("status") != "processed", c("status"))).withColumn("analysis", F.lit(None).cast(schema["analysis"].dataType)), path, ["id"], 16)
    for pending in (c("status") == "uploaded", None):
        analyze_pending(spark, path, schema, 16, AS_OF, pending=pending)
    stored = read_buckets(spark, path, schema).withColumnRenamed("status", "resume_status").withColumn("success", F.lit(True))
    return flat_analysis(stored, "resume_status").drop("success")


# Which texts have been worked on before: those of one language.
REUSED_SQL = features("SELECT concat('d', CAST(doc_id AS VARCHAR)) AS doc_id, text FROM documents") + """
SELECT doc_id, sha256(concat('v1', chr(31), 'entry', chr(31), src.text)) AS content_key,
  sha256(concat('v1', chr(31), 'entry', chr(31), src.text)) IN (SELECT sha256(concat('v1', chr(31), 'entry', chr(31), text)) FROM documents WHERE lang = 'en') AS known,
  CAST(word_count AS BIGINT) AS words, array_to_string(skills, '|') AS skills FROM features JOIN src USING (doc_id)"""


@query("reuse_features", REUSED_SQL)
def _(spark, d):
    """Features by content: a first run over the texts of one language, a second over all, which computes the rest."""
    docs = load(spark, d, "documents").select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("doc_id"), "text", "lang")
    compute = lambda df: df.withColumns({"words": word_count(c("text")).cast("bigint"), "skills": joined(vocabulary.find_skills(F.lower("text")))})
    empty = spark.createDataFrame([], "content_key string, words long, skills string")
    _, store = reuse.reuse(docs.where("lang = 'en'"), empty, compute, "v1", level="entry", id="doc_id")
    found, _ = reuse.reuse(docs, store, compute, "v1", level="entry", id="doc_id")
    known = store.select("content_key", F.lit(True).alias("known"))
    return found.join(known, "content_key", "left").select("doc_id", "content_key", F.coalesce("known", F.lit(False)).alias("known"), "words", "skills")


# --------------------------------------------------------- recommendation plan
RESUME_VECTORS = CORPUS_VECTORS.replace("SELECT c.doc_id,", "SELECT c.number AS id, c.doc_id,").replace(
    "UNION ALL SELECT concat('d', CAST(doc_id AS VARCHAR(20))) AS doc_id, doc_id AS number, text FROM {documents}", "")

RECOMMEND_SQL = ADVISED_SQL + f""", person AS (
  SELECT CAST(doc_id[2:] AS BIGINT) AS resume_id, a.text, round(score, 1) AS ats_score, experience_level AS candidate_level,
    CAST(v.vector AS DOUBLE[]) AS resume_vector FROM advised a JOIN ({D(CORPUS_VECTORS)}) v USING (doc_id)
  WHERE starts_with(doc_id, 'r') AND (CAST(len(skills) >= 3 AS INT) + CAST(len(sections) >= 2 AS INT) + CAST({EITHER} AS INT)
    + CAST(jobs > 0 OR degrees > 0 AS INT) + CAST(word_count BETWEEN 200 AND 2000 AS INT)) >= 3),
listed AS (SELECT *, row_number() OVER (ORDER BY posted_date DESC NULLS FIRST, id) AS seq FROM (SELECT * FROM ({JOB_SIDE})
  WHERE is_active AND (lower(title) LIKE '%engineer%' OR lower(description) LIKE '%engineer%')
  ORDER BY posted_date DESC NULLS FIRST, id LIMIT 50)),
job AS (SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1),
allpairs AS (SELECT resume_id, id AS job_id FROM person, job),
{score_pairs_sql('allpairs').split('job AS (', 1)[1].split('pair AS', 1)[1].join(['pair AS', ''])},
ranked AS (SELECT p.*, j.seq, j.url, row_number() OVER (PARTITION BY resume_id ORDER BY round(raw, 1) DESC, j.seq) AS rank
  FROM pair p JOIN job j ON j.id = p.job_id WHERE round(raw, 1) >= 5),
top AS (SELECT *, list_filter({COMMON}, lambda t, i: len(list_filter({COMMON}[1:i - 1], lambda m: contains(m, t))) = 0) AS matched
  FROM ranked WHERE rank <= 20),
named AS (SELECT *, list_transform(list_sort(list_transform(matched, lambda t, i: {{'n': -length(t), 'i': i, 't': t}})), lambda r: r.t)[1:5] AS best
  FROM top)
SELECT resume_id, job_id, url AS link, round(raw, 1) AS match_score, candidate_level, job_level, CAST(rank AS BIGINT) AS rank,
  array_to_string({reasons_sql('best')}, '|') AS reasons FROM named"""


# The whole catalogue instead of a search: every active job, one per link.
RECOMMEND_ALL_SQL = RECOMMEND_SQL.replace("WHERE is_active AND (lower(title) LIKE '%engineer%' OR lower(description) LIKE '%engineer%')\n"
                                          "  ORDER BY posted_date DESC NULLS FIRST, id LIMIT 50)", "WHERE is_active)")
SHOWN = ["resume_id", "job_id", "link", "match_score", "candidate_level", "job_level"]


def scored_resumes(spark, d):
    return score_features(extract_features(corpus_vectors(spark, d, RESUME_VECTORS)), semantic=semantic())


def recommended(spark, d, candidates):
    return recommend_jobs(scored_resumes(spark, d), candidates, table(spark, d, JOB_VECTORS), AS_OF, min_score=5)


def shown(best):
    return best.select(*SHOWN, c("rank").cast("bigint").alias("rank"), joined(c("reasons")).alias("reasons"))


@query("recommend_jobs", RECOMMEND_SQL)
def _(spark, d):
    return shown(recommended(spark, d, candidate_jobs(table(spark, d, JOBS), keywords="engineer")))


@query("recommend_jobs_all", RECOMMEND_ALL_SQL)
def _(spark, d):
    return shown(recommended(spark, d, candidate_jobs(table(spark, d, JOBS), limit=None)))


# The same with rules for every pair that lacks a vector on either side.
MIXED_SQL = RECOMMEND_ALL_SQL.replace("ranked AS (SELECT p.*, j.seq, j.url, row_number()", f"""known AS (
  SELECT r.*, {_skill_list('a.skills', fixed.TECHNICAL_SKILLS)} AS technical, {_skill_list('a.skills', fixed.SOFT_SKILLS)} AS soft
  FROM person r JOIN advised a ON a.doc_id = concat('r', CAST(r.resume_id AS VARCHAR))),
read AS (SELECT *, lower(concat(title, ' ', description)) AS low, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(posted_date)) / 86400e6 AS age FROM job),
skilled AS (SELECT *, list_filter([{', '.join(lit(n) for n in dict.fromkeys([*fixed.TECHNICAL_SKILLS, *fixed.SOFT_SKILLS]))}], lambda t: contains(low, t)) AS job_skills FROM read),
hits AS (SELECT p.resume_id, j.id AS job_id, j.seq, j.url, candidate_level, job_level, ats_score, technical, soft, salary, age,
    list_intersect(technical, job_skills) AS th, list_intersect(soft, job_skills) AS sh
  FROM known p, skilled j WHERE resume_vector IS NULL OR job_vector IS NULL),
ruled AS ({RULES_SQL.split('ruled AS (')[1].rstrip()},
ruledtop AS (SELECT resume_id, job_id, url AS link, round(score, 1) AS match_score, candidate_level, job_level, seq,
  list_concat(list_filter([CASE WHEN score >= 80 THEN 'Excellent match for your skills and experience' WHEN score >= 60 THEN 'Good match for your profile' WHEN score >= 40 THEN
    'Moderate match - consider applying' END], lambda r: r IS NOT NULL), CASE WHEN len(th) > 0 THEN ['Matches your skills: ' || array_to_string(list_filter(technical, lambda t: list_contains(th, t))[1:3], ', ')] ELSE [] END,
    CASE WHEN floor(age) <= 3 THEN ['Recently posted - apply quickly!'] ELSE [] END) AS why
  FROM ruled WHERE round(score, 1) >= 5),
ranked AS (SELECT p.*, j.seq, j.url, row_number()""").replace("FROM pair p JOIN job j ON j.id = p.job_id WHERE", """FROM pair p JOIN job j ON j.id = p.job_id JOIN person r ON r.resume_id = p.resume_id
  WHERE r.resume_vector IS NOT NULL AND j.job_vector IS NOT NULL AND""").replace("row_number() OVER (PARTITION BY resume_id ORDER BY round(raw, 1) DESC, j.seq)", "row_number() OVER (PARTITION BY p.resume_id ORDER BY round(raw, 1) DESC, j.seq)")
MIXED_SQL = MIXED_SQL[:MIXED_SQL.rindex("SELECT resume_id, job_id, url AS link")] + """SELECT * EXCLUDE (seq) REPLACE (CAST(rank AS BIGINT) AS rank) FROM (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY match_score DESC, seq) AS rank FROM (
  SELECT resume_id, job_id, url AS link, round(raw, 1) AS match_score, candidate_level, job_level, seq, 'vectors' AS method, array_to_string({reasons}, '|') AS reasons FROM named
  UNION ALL SELECT resume_id, job_id, link, match_score, candidate_level, job_level, seq, 'rules', array_to_string(why, '|') FROM ruledtop)) WHERE rank <= 20""".replace("{reasons}", reasons_sql("best"))


@query("recommend_jobs_mixed", MIXED_SQL)
def _(spark, d):
    best = recommend_jobs(scored_resumes(spark, d), candidate_jobs(table(spark, d, JOBS), limit=None), table(spark, d, JOB_VECTORS), AS_OF, min_score=5, rules=True)
    return best.select(*SHOWN, "method", c("rank").cast("bigint").alias("rank"), joined(c("reasons")).alias("reasons"))


SUMMARY_SQL = RECOMMEND_SQL.replace("SELECT resume_id, job_id, url AS link, round(raw, 1) AS match_score", f""", checked AS (
  SELECT CAST(doc_id[2:] AS BIGINT) AS resume_id, round(score, 1) AS ats_score, CAST(len(skills) >= 3 AS INT) + CAST(len(sections) >= 2 AS INT)
    + CAST({EITHER} AS INT) + CAST(jobs > 0 OR degrees > 0 AS INT) + CAST(word_count BETWEEN 200 AND 2000 AS INT) AS passed
  FROM advised WHERE starts_with(doc_id, 'r')),
told2 AS (SELECT resume_id, job_id, url AS link, round(raw, 1) AS match_score""") + f""")
SELECT c.resume_id, passed >= {fixed.FORMAT_CHECKS_NEEDED} AS success, CASE WHEN passed >= {fixed.FORMAT_CHECKS_NEEDED} THEN {lit(fixed.FORMAT_OK)}
  ELSE {_fill(fixed.FORMAT_BAD, '(5 - passed)')} END AS reason, ats_score, count(n.job_id) AS recommended_jobs
FROM checked c LEFT JOIN told2 n USING (resume_id) GROUP BY ALL"""


@query("recommend_summary", SUMMARY_SQL)
def _(spark, d):
    # verdicts and matches read the same features: written once, texts are not worked on again and the last plan is small
    scored = cut_lineage(scored_resumes(spark, d).select("id", "text", "vector", "score", "experience_level", *CHECKED), "scored")
    best = recommend_jobs(scored, candidate_jobs(table(spark, d, JOBS), keywords="engineer"), table(spark, d, JOB_VECTORS), AS_OF, min_score=5)
    return recommendation_summary(scored, best)
