"""Ladders on feature rows, without text."""

import pytest
from pyspark.sql import functions as F

from vitaloom.functions import advice, matching, scores, vectors
from vitaloom.plans.analyze import analyze_resumes

ENTRY = "array<struct<institution string, degree string, field string, graduation_year string>>"
SCHEMA = (f"n int, word_count int, name string, email string, phone string, linkedin string, github string, has_contact boolean, "
          f"sections array<string>, education {ENTRY}, work_experience array<string>, projects array<string>, "
          f"action_verbs array<string>, repetitive_verbs map<string,int>, numbers array<string>, skills array<string>, "
          f"total_bullets int, quantified_bullets int, layout struct<score double>, dates struct<score double, penalty double>, "
          f"summary_points double, certification_points double, grammar_points double, tone_points double, tailored boolean, "
          f"leads boolean, open_source boolean")


def row(n=0, words=0, contact=False, link=None, sections=0, degree=None, jobs=0, projects=0, verbs=0, numbers=0, skills=0,
        bullets=0, quantified=0, name=None, layout=6.0, repeated=None):
    mail = "a@b.co" if contact else None
    return (n, words, name, mail, mail, link, None, contact, ["s"] * sections, [degree] if degree else [], ["j"] * jobs,
            ["p"] * projects, ["v"] * verbs, repeated or {}, ["1"] * numbers, ["k"] * skills, bullets, quantified, (layout,),
            (4.0, 0.0), 5.0, 0.0, 5.0, 3.0, False, False, False)


@pytest.fixture(scope="module")
def evaluate(spark):
    def run(build, *rows):
        df = spark.createDataFrame([r[1:] and (i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
        return [r["v"] for r in df.select("n", build(df).alias("v")).orderBy("n").collect()]
    return run


@pytest.mark.parametrize("part, field, level, cases", [
    ("sections_score", "sections", "entry", {2: 0.0, 3: 1.5, 4: 3.0, 5: 4.0, 6: 5.0}),
    ("skills_clarity_score", "skills", "entry", {9: 0.0, 10: 1.0, 15: 2.5, 20: 4.0, 25: 5.0, 30: 6.0}),
    ("hard_skills_score", "skills", "mid", {9: 0.0, 10: 2.0, 15: 4.0, 20: 6.0, 25: 8.0}),
    ("action_verbs_score", "verbs", "entry", {4: 0.0, 5: 1.0, 8: 2.0, 10: 3.0, 12: 4.0, 15: 5.0}),
    ("experience_completeness_score", "jobs", "entry", {0: 0.0, 1: 2.0, 2: 6.0, 3: 8.0}),
    ("experience_completeness_score", "jobs", "mid", {1: 0.0, 2: 3.0, 3: 6.0, 4: 8.0}),
    ("experience_completeness_score", "jobs", "senior", {2: 0.0, 3: 3.0, 4: 6.0, 5: 8.0}),
    ("projects_detail_score", "projects", "entry", {0: 0.0, 1: 1.0, 2: 1.0, 3: 3.0, 4: 4.0, 5: 5.0}),
    ("projects_detail_score", "projects", "senior", {0: 0.0, 1: 1.0, 2: 3.0, 3: 5.0}),
    ("length_score", "words", "entry", {299: 0.0, 300: 1.0, 399: 1.0, 400: 2.0, 800: 2.0, 801: 1.0, 1001: 0.0}),
    ("length_score", "words", "mid", {499: 0.0, 500: 1.0, 600: 2.0, 1000: 2.0, 1200: 1.0, 1201: 0.0}),
    ("length_score", "words", "senior", {599: 0.0, 600: 1.0, 800: 2.0, 1200: 2.0, 1400: 1.0, 1401: 0.0}),
])
def test_hybrid_ladders(evaluate, part, field, level, cases):
    got = evaluate(lambda f: scores.ats_score_hybrid(f, F.lit(level), F.lit(0.0))[part], *[row(**{field: n}) for n in cases])
    assert got == list(cases.values())


def test_hybrid_ratios_and_details(evaluate):
    def part(name, level="entry"):
        return lambda f: scores.ats_score_hybrid(f, F.lit(level), F.lit(0.0))[name]
    assert evaluate(part("quantification_score"), *[row(bullets=20, quantified=q) for q in (2, 3, 4, 6, 8, 10)], row()) == [
        0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 0.0]
    assert evaluate(part("bullet_density_score"), *[row(jobs=2, bullets=b) for b in (1, 2, 4, 6, 8, 10, 12, 14, 15)], row(bullets=4)) == [
        0.0, 1.0, 2.5, 4.0, 5.0, 5.0, 4.0, 2.5, 1.0, 0.0]
    full, half = ("I", "D", "F", "2020"), (None, "D", "F", None)
    assert evaluate(part("education_details_score"), row(degree=full), row(degree=half), row()) == [6.0, 5.0, 0.0]
    assert evaluate(part("education_details_score", "senior"), row(degree=half), row()) == [6.0, 2.0]
    assert evaluate(part("contact_info_score"), row(contact=True, link="x"), row(contact=True), row()) == [3.0, 2.0, 0.0]
    assert evaluate(part("experience_completeness_score"), row(jobs=1, projects=3)) == [4.0]


def test_hybrid_total_is_clamped_and_rounded(evaluate):
    best = row(words=500, contact=True, link="x", sections=6, degree=("I", "D", "F", "2020"), jobs=3, projects=5, verbs=15, skills=30,
               bullets=12, quantified=12)
    got = evaluate(lambda f: scores.ats_score_hybrid(f, F.lit("entry"), F.lit(20.0)), best, row(layout=2.0))
    assert got[0]["base_score"] == 106.0 and got[0]["total_score"] == 100.0
    assert got[0]["category_scores"]["formatting"] == 28.0
    # 5 file + 2 layout + 4 dates + 5 summary + 5 grammar + 3 tone + 20 - 10 contact
    assert got[1]["total_score"] == 34.0 and got[1]["category_scores"]["penalties"] == -10.0


def test_legacy(evaluate):
    def total(level="entry"):
        return lambda f: scores.ats_score_legacy(f, F.lit(level), F.lit(0.5))
    got = evaluate(total(), row(jobs=1, projects=3, bullets=12, quantified=1, words=700), row(numbers=7))
    assert (got[0]["work_experience_score"], got[0]["bullet_points_score"], got[0]["quantification_score"], got[0]["content_density_score"],
            got[0]["projects_score"], got[0]["ml_semantic_score"]) == (9.0, 24.0, 1.0, 4.0, 5.0, 10.0)
    assert got[0]["total_score"] == 53.0
    assert (got[1]["work_experience_score"], got[1]["quantification_score"]) == (2.0, 3.0)
    assert [x["bullet_points_score"] for x in evaluate(total("senior"), *[row(bullets=b) for b in (11, 12, 15, 20, 25, 28, 46)])] == [
        0.0, 4.0, 8.0, 16.0, 20.0, 24.0, 4.0]


def test_rules_score(evaluate):
    got = evaluate(scores.ats_score_rules, row(), row(words=500, contact=True, sections=6, verbs=15, numbers=12, skills=25),
                   row(words=1100, sections=2, verbs=4, numbers=3))
    assert got[0] == 2.0 and got[1] == 100.0
    assert got[2] == pytest.approx(4 + 5 + 5.4 + 10 + 3)


def test_status(spark):
    df = spark.createDataFrame([(float(x),) for x in (85, 84.9, 75, 65, 55, 45, 44.9)], "s double")
    assert [r[0] for r in df.select(scores.ats_status(F.col("s"))["status"]).collect()] == [
        "excellent", "very-good", "very-good", "good", "fair", "needs-improvement", "poor"]


def test_advice_lines(evaluate):
    got = evaluate(lambda f: advice.recommendations(f, F.lit(40.0), F.lit("entry")),
                   row(bullets=11, quantified=5, verbs=7, repeated={"led": 3}, jobs=2, projects=4))[0]
    assert got == [
        "📛 Add your full name at the top of your resume", "🔗 Add LinkedIn profile (essential) or GitHub (if technical)",
        "⚠️ Add your email address at the top of your resume", "⚠️ Add your phone number for easy contact",
        "🎓 Add an Education section with your degree, institution, and graduation year",
        "� Add a few more details (currently 11, aim for 15-20)", "📝 Add a 'Experience' section to improve structure",
        "📝 Add a 'Education' section to improve structure", "📝 Add a 'Skills' section to improve structure",
        "📝 Add a 'Summary' section to improve structure", "🔄 Replace repetitive 'Led' verb (used 3 times) - use it max 2 times",
        "💪 Add more action verbs to better showcase your achievements",
        "📊 Quantify more bullets: 5/11 have metrics - aim for 50%+ (add %, $, or specific numbers)",
        "📄 Your resume is too short - add more details about your experience, achievements, and impact",
        "🔧 List more relevant technical and soft skills (e.g., programming languages, tools, frameworks)",
        "⭐ Focus on adding quantifiable achievements and action verbs first - these have the biggest impact"]
    quiet = evaluate(lambda f: advice.recommendations(f, F.lit(90.0), F.lit("senior")),
                     row(name="A", link="x", contact=True, degree=("I", "D", "F", "1"), jobs=4, projects=1, bullets=35, quantified=30,
                         verbs=10, words=500, skills=8))[0]
    assert [x for x in quiet if "section" not in x] == ["✨ Use bullet points to make your resume easier to scan by ATS systems"]


def test_insights_and_highlights(evaluate):
    got = evaluate(lambda f: advice.insights(f, F.lit(80.0), F.lit("mid")), row(contact=True, jobs=2, skills=5, words=300))[0]
    assert got == ["Excellent Mid-Level resume optimization for ATS systems", "Complete contact information present",
                   "Good work history with 2 experiences", "Diverse skill set (5 skills identified)",
                   "Acceptable resume length but could be more detailed"]


def test_highlight_precedence(spark):
    lines = ["add this", "Good, but add", "neutral", "weak"]
    df = spark.createDataFrame([(lines, ["r"] * 8)], "i array<string>, r array<string>")
    h = df.select(advice.highlight_insights(F.col("i"), F.col("r")).alias("h")).first()["h"]
    assert h["qualities"] == ["Good, but add", "neutral"] and h["key_insights"] == lines and len(h["improvements"]) == 6


@pytest.mark.parametrize("snippet, cases", [
    (True, {-0.1: -18.0, 0.2: 36.0, 0.25: 45.0, 0.3: 50.0, 0.4: 60.0, 0.5: 67.5, 0.6: 75.0, 1.0: 100.0}),
    (False, {-0.1: -11.67, 0.2: 23.34, 0.3: 35.0, 0.4: 45.0, 0.5: 55.0, 0.6: 62.5, 0.7: 70.0, 1.0: 85.0}),
])
def test_semantic_curves(spark, snippet, cases):
    df = spark.createDataFrame([(k,) for k in cases], "s double")
    got = [r[0] for r in df.select(matching.semantic_score(F.col("s"), F.lit(snippet))).collect()]
    assert got == pytest.approx(list(cases.values()))


def test_penalty_matrix(spark):
    want = {"student": [0, 0, 20, 40, 50], "intern": [0, 0, 20, 40, 50], "entry": [0, 0, 20, 35, 45], "mid": [0, 0, 0, 5, 20],
            "senior": [0, 0, 0, 0, 5], "principal": [0, 0, 0, 0, 0]}
    jobs = ["intern", "entry", "mid", "senior", "principal"]
    df = spark.createDataFrame([(c, j) for c in want for j in jobs], "c string, j string")
    got = [r[0] for r in df.select(matching.seniority_penalty(F.col("c"), F.col("j"))).collect()]
    assert got == [p for c in want for p in want[c]]


def test_match_reasons_order(spark):
    df = spark.createDataFrame([(0.7, 80.0, 65.0, 35.0), (0.5, 60.0, 50.0, 5.0), (0.1, 0.0, 10.0, 0.0)], "s double, a double, m double, p double")
    terms = F.array(F.lit("python"), F.lit("docker"))
    got = [r[0] for r in df.select(matching.match_reasons(F.col("s"), F.col("a"), F.col("m"), F.col("p"), F.lit("entry"), F.lit("senior"),
                                                          terms, F.when(F.col("p") > 1, terms).otherwise(F.array(F.lit("x"))))).collect()]
    assert got[0] == ["⚠️ This is a senior-level position, but you're entry-level - significant experience gap",
                      "Good skills match, but position requires more experience",
                      "Strong semantic alignment between your resume and job requirements",
                      "Your resume is well-optimized for ATS systems", "Matching skills: python, docker"]
    assert got[1][:2] == ["This is a senior-level position - you may need to stretch to meet requirements", "Good match - worth applying"]
    assert got[2] == ["Limited match - may not be the best fit"]


def test_rule_matching(spark):
    df = spark.createDataFrame([("python and communication", "$5", 7.0), ("java", "Not specified", 7.1), ("", None, 31.0)],
                               "t string, pay string, age double")
    tech, soft = F.array(F.lit("Python"), F.lit("Go")), F.array(F.lit("communication"))
    got = df.select(matching.match_rules(F.col("t"), F.col("pay"), F.col("age"), tech, soft, F.lit(50.0)).alias("m"),
                    matching.rule_reasons(F.lit(60.0), F.col("t"), F.col("age") - 4, tech).alias("r")).collect()
    assert [x["m"] for x in got] == [20 + 15 + 10 + 15 + 10, 10 + 12, 10 + 4]
    assert got[0]["r"] == ["Good match for your profile", "Matches your skills: Python", "Recently posted - apply quickly!"]
    assert got[2]["r"] == ["Good match for your profile"]


def test_keyword_match(spark):
    df = spark.createDataFrame([(["alpha", "beta"], ["alpha", "gamma", "delta", "omega"]), ([], [])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(matching.match_keyword(F.col("a"), F.col("b"), F.lit(50.0))).collect()]
    assert (got[0]["match_score"], got[0]["keyword_overlap"], got[0]["match_level"], got[0]["reasons"]) == (
        35.0, 25.0, "fair", ["Keyword overlap: 1 common terms"])
    assert got[1]["match_score"] == 20.0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]]), ([0.0, 0.0], [[1.0, 0.0]])],
                               "v array<double>, o array<array<double>>")
    got = df.select(vectors.unit(F.col("v")).alias("u"), vectors.topk_mean_similarity(vectors.similarities(F.col("v"), F.col("o")), 2).alias("m")).collect()
    assert got[0]["u"] == pytest.approx([0.6, 0.8]) and got[0]["m"] == pytest.approx(0.9)
    assert got[1]["u"] == [0.0, 0.0] and got[1]["m"] == 0.0


def test_analysis_of_missing_text(spark):
    df = spark.createDataFrame([(1, "Jane Doe\nSkills"), (2, " \n"), (3, None)], "id int, text string")
    got = {r["id"]: r for r in analyze_resumes(df).collect()}
    assert got[1]["success"] and got[1]["analysis"]["extractedInfo"]["name"] == "Jane Doe"
    assert not got[2]["success"] and got[2]["analysis"] is None and got[3]["analysis"] is None


def test_analysis_plan_stays_in_the_jvm_without_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    plan = analyze_resumes(df, semantic=F.lit(1.0))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_missing_semantic_points_are_not_full_marks(spark):
    from vitaloom.functions.vectors import semantic_to_ideal

    ideals = F.array(F.array(F.lit(1.0), F.lit(0.0)))
    df = spark.createDataFrame([(1, "Built tools\nled teams", [1.0, 0.0]), (2, "Built tools\nled teams", None)], "id int, text string, vector array<double>")
    points = [r[0] for r in df.orderBy("id").select(semantic_to_ideal(F.col("vector"), ideals)).collect()]
    assert points == [20.0, None]
    assert df.select(semantic_to_ideal(F.col("vector"), F.array().cast("array<array<double>>"))).first()[0] is None
    with_vectors = {r["id"]: r["analysis"] for r in analyze_resumes(df, semantic=semantic_to_ideal(F.col("vector"), ideals)).collect()}
    plain = {r["id"]: r["analysis"] for r in analyze_resumes(df).collect()}
    assert with_vectors[2]["score"] == plain[2]["score"] < 100 and with_vectors[2]["scoreBreakdown"] is None
    assert with_vectors[1]["scoreBreakdown"]["ml_semantic_score"] == 20.0


def test_clamp_keeps_null(spark):
    from vitaloom.functions.text import clamp

    rows = spark.createDataFrame([(1, -5.0), (2, 50.0), (3, 500.0), (4, None)], "id int, v double").orderBy("id").select(clamp(F.col("v"), 0, 100)).collect()
    assert [r[0] for r in rows] == [0.0, 50.0, 100.0, None]
