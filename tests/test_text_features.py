"""Per-document operators on authored texts; every expectation is worked out by hand."""

import time

import pytest
from pyspark.sql import functions as F

from vitaloom.functions import bullets, contact, levels, quality, sections, vocabulary
from vitaloom.functions.text import has_any, has_text, word_count


def test_word_count_and_blank_texts(texts):
    assert texts(lambda t, low: word_count(t), "a  b\nc", "", "   ", "café  x") == [3, 0, 0, 2]
    assert texts(lambda t, low: has_text(t), "x", "", " \n\t", None) == [True, False, False, False]


def test_name_is_first_plain_line_of_the_first_five(texts):
    got = texts(lambda t, low: contact.extract_name(t),
                "\n  Jane Doe \nx", "12 Main St\nme@x.com\nRavi Kumar\n", "1\n2\n3\n4\n5\nToo Late",
                "one two three four five\nGitHub page\nok name")
    assert got == ["Jane Doe", "Ravi Kumar", None, "ok name"]


def test_contact_details(texts):
    t = "mail a.b+c@x-y.co.uk now, call +1 (743) 555-3824; LinkedIn: @jane-doe, GITHUB.com/jd9; Austin, TX and New York, Texas"
    assert texts(lambda t, low: contact.extract_email(t), t, "no at") == ["a.b+c@x-y.co.uk", None]
    assert texts(lambda t, low: contact.extract_phone(t), t, "12") == ["+1 (743) 555-3824", None]
    assert texts(lambda t, low: contact.extract_linkedin(t), t, "linkedin.com/in/zed", "none") == ["jane-doe", "zed", None]
    assert texts(lambda t, low: contact.extract_github(t), t, "Github: me", "none") == ["jd9", "me", None]
    # the first pattern wins even where the second would match earlier
    assert texts(lambda t, low: contact.extract_location(t), t, "Reno, NV", "x") == ["New York, Texas", "Reno, NV", None]


def test_sections_are_substring_hits_in_fixed_order(texts):
    got = texts(lambda t, low: vocabulary.find_sections(low), "SKILLS and Portfolio", "about licensing licenses", "zzz")
    assert got == [["skills", "projects"], ["summary", "certifications"], []]
    assert texts(lambda t, low: vocabulary.missing_sections(vocabulary.find_sections(low)), "skills degree") == [
        ["experience", "summary"]]


def test_skills_need_word_edges(texts):
    got = texts(lambda t, low: vocabulary.find_skills(low), "Python, node.js; JavaScript", "c++ developer", "c++x and c#1",
                "pythonic javas", "machine learning ops, redis pub/sub", "cafégo goé")
    assert got[0] == ["python", "javascript", "node.js", "node"]
    assert got[1] == ["c"]          # an edge after "+" needs a word character
    assert got[2] == ["c++", "c#", "c"]
    assert got[3] == []
    assert got[4] == ["redis", "machine learning", "redis pub/sub"]
    assert got[5] == []             # edges are Unicode-aware


def test_phrases_are_searched_only_where_their_first_word_is(texts):
    """Edges and marks at the first word of a phrase, and phrases that begin with no plain word."""
    names = ["arc weld", ".net core", "c++", "café bar", "a1_b c", "weld"]
    got = texts(lambda t, low: vocabulary.find_skills(low, names), "arc weld", "xarc weld", "arc welds", "the x.net core", "c++x", "un café bar", "a1_b c",
                "e\u0301arc weld", "arc\u0301 weld", "arc  weld", "", None)
    assert got == [["arc weld", "weld"], ["weld"], [], [".net core"], ["c++"], ["café bar"], ["a1_b c"], ["weld"], ["weld"], ["weld"], [], None]


def searched(spark, build):
    """How often the column ``low`` is searched for a string in the plan of another."""
    df = spark.createDataFrame([("x",)], "low string").select(build(F.col("low")).alias("v"))
    return df._jdf.queryExecution().analyzed().toString().lower().count("contains(low#")


def test_words_that_hold_another_are_not_searched(spark, texts):
    assert searched(spark, lambda low: has_any(low, ["skills", "technical skills", "skills"])) == 1
    assert texts(lambda t, low: has_any(low, ["skills", "technical skills"]), "technical skills", "skill", None) == [True, False, None]


def test_categories_lower_a_skill_once(spark):
    df = spark.createDataFrame([(["Python", "REACT", "unheard of", None],), (None,), ([],)], "skills array<string>")
    counts = df.select(vocabulary.skill_category_counts(F.col("skills")).alias("n"), vocabulary.uncategorized_skills(F.col("skills")).alias("rest"))
    assert counts._jdf.queryExecution().analyzed().toString().count("lower(") == 2
    got = counts.collect()
    assert got[0]["n"]["languages"] == 1 and got[0]["n"]["frameworks"] == 1 and got[0]["n"]["cloud"] == 0 and got[0]["rest"] == ["unheard of"]
    assert got[1]["rest"] is None and got[2]["n"]["languages"] == 0 and got[2]["rest"] == []


def test_sections_and_names_are_lowered_once(spark):
    df = spark.createDataFrame([("x",)], "text string").select(sections.extract_education(F.col("text")).alias("e"), contact.extract_name(F.col("text")).alias("n"))
    assert df._jdf.queryExecution().analyzed().toString().count("lower(") == 2


def test_patterns_run_where_their_fixed_part_is(texts):
    """Texts with the fixed part but no match, and without a text."""
    assert texts(lambda t, low: contact.extract_email(t), "a@b", "x @ y.com", None) == [None, None, None]
    assert texts(lambda t, low: contact.extract_phone(t), "555-3824", "743.555 3824", "٧٤٣٥٥٥٣٨٢٤", None) == [None, "743.555 3824", "٧٤٣٥٥٥٣٨٢٤", None]
    assert texts(lambda t, low: levels.max_stated_years(low), "this year", "4 years experience", None) == [0, 4, 0]
    assert texts(lambda t, low: levels.sum_date_ranges(low), "no range", "20 of them", "2011-2013", None) == [0, 0, 2, 20]


def test_tone_counts_words_of_any_script_and_blank(texts):
    """Blanks beside the ends of sentences, other blanks than the space, and signs of two code units."""
    five = "é\u00a0b\u2003c 😀😀 d"
    got = texts(lambda t, low: quality.tone_score(t, low), f"  {five} ... ! x. ", "a b c . d", " ".join([five] * 6) + " ?!", " . ")
    assert got == [3.0, 1.5, 2.5, 1.5]


def test_skills_vocabulary_is_an_argument(texts):
    assert texts(lambda t, low: vocabulary.find_skills(low, ["weld", "arc weld", "mig"]), "arc weld, mig") == [
        ["weld", "arc weld", "mig"]]


def test_verbs_and_their_counts(texts):
    text = "Led x. led y, LED z; built. misled"
    assert texts(lambda t, low: vocabulary.find_action_verbs(low), text) == [["led", "built"]]
    assert texts(lambda t, low: vocabulary.action_verb_frequency(low), text, "none") == [{"led": 3, "built": 1}, {}]
    phrases = texts(lambda t, low: vocabulary.action_verb_frequency(low, ["rolled out", "plan", "c++ built"]), "Rolled out a plan, rolled out more; trolled out")
    assert phrases == [{"rolled out": 2, "plan": 1}]
    assert texts(lambda t, low: vocabulary.repetitive_verbs(vocabulary.action_verb_frequency(low)), text) == [{"led": 3}]


def test_numbers(texts):
    assert texts(lambda t, low: vocabulary.find_numbers(t), "5 10k, 30% a1 7.5 $9") == [["5", "10k", "30", "7", "5", "9"]]


def test_bullets_take_their_continuation_lines(texts):
    text = "intro\n- one\n  more\n\n* two 5%\n-\n  • three\r\nafter"
    got = texts(lambda t, low: bullets.split_bullets(t), text, "- only", "none", "")
    assert got[0] == ["- one   more", "* two 5% -", "  • three\r after"]
    assert got[1:] == [["- only"], [], []]
    assert texts(lambda t, low: bullets.quantified_bullets(bullets.split_bullets(t)), text, "- from 10 up\nto 50",
                 "- cut by 3\n- over 9\n- 12 things") == [1, 1, 2]


def test_section_bounds(texts):
    # the first start word in list order wins, not the earliest one
    pad = "x" * 60
    text = "qualifications " + pad + " education " + pad + " skills rest"
    got = texts(lambda t, low: sections.education_section(t, low), text, "education then skills at once", "none")
    assert got[0] == "education " + pad + " "
    assert got[1] == "education then skills at once"     # an end word nearer than 50 characters does not count
    assert got[2] is None
    project = "we like projects\n  Projects\nA | B\n" + pad + "\nSkills\nx"
    assert texts(lambda t, low: sections.project_section(t, low), project) == ["Projects\nA | B\n" + pad]


def jobs_of(texts, *values):
    return texts(lambda t, low: sections.extract_experience(sections.experience_section(t, low)), *values)


def test_experience_dated_line_skips_the_line_below(texts):
    text = "Experience\nAcme - Engineer Jan 2018 - Mar 2020\n- not read\n- Built x\n  long continuation line\nshort"
    (got,) = jobs_of(texts, text)
    assert [tuple(e) for e in got] == [("Acme", "Engineer", "Jan 2018 - Mar 2020", "Built x long continuation line")]


def test_experience_forms(texts):
    three = "Experience\nEngineer\nAcme Corp\nFeb 2020 – Present\n- Did a\nLead\nOther\nMar 2021 - Current"
    assert [tuple(e) for e in jobs_of(texts, three)[0]] == [
        ("Acme Corp", "Engineer", "Feb 2020 – Present", "Did a"), ("Other", "Lead", "Mar 2021 - Current", "")]
    piped = "Work Experience\nAcme | Dev, Sept. 2019 - Dec 2020"
    assert [tuple(e) for e in jobs_of(texts, piped)[0]] == [("Acme", "Dev,", "Sept. 2019 - Dec 2020", "")]
    plain = "Experience\nSome Shop\n- Sold things"
    assert [tuple(e) for e in jobs_of(texts, plain)[0]] == [("Some Shop", "Unknown", None, "Sold things")]
    # a date with nothing before it leaves no organisation and no role: the entry is lost
    assert jobs_of(texts, "Experience\nJan 2020 - Present\nskipped") == [[]]
    # blank lines count as the lines looked ahead to
    gap = "Experience\nEngineer\n\nJan 2020 - Present"
    assert [tuple(e) for e in jobs_of(texts, gap)[0]] == [("Unknown", "Engineer", "Jan 2020 - Present", "")]
    assert jobs_of(texts, "nothing here", None) == [[], []]


def test_experience_bulleted_dated_line(texts):
    (got,) = jobs_of(texts, "Experience\n- Acme Jan 2020 - Present")
    assert [tuple(e) for e in got] == [("Unknown", "Acme", "Jan 2020 - Present", "Acme Jan 2020 - Present")]


def test_projects(texts):
    text = ("Projects\nTracker | Python, React,\nNode.js\nA subtitle that is long enough\n- Built api\nhttp://x\n- \n- More\n"
            "Plain line\nOther | Go\nRust\nshort one\n")
    (got,) = texts(lambda t, low: sections.extract_projects(sections.project_section(t, low)), text)
    assert [tuple(p) for p in got] == [
        ("Tracker", "Python, React, Node.js", "A subtitle that is long enough Built api More"), ("Other", "Go Rust", "")]


def test_education(texts):
    got = texts(lambda t, low: sections.extract_education(sections.education_section(t, low)),
                "Education: IIT Madras, B.Tech CSE 2019 to 2023", "Education\nMaster of civil works", "Education and more",
                "Education to be", "none")
    assert [tuple(e) for e in got[0]] == [("B.Tech", "CSE", "IIT Madras", "2023")]
    assert [tuple(e) for e in got[1]] == [("Master", "Civil", None, None)]
    assert got[2] == []
    assert [tuple(e) for e in got[3]] == [("be", "Computer Science", None, None)]    # "be" reads as a degree
    assert got[4] == []


@pytest.mark.parametrize("text, bullet_count, expected", [
    ("Undergraduate with 9 years of experience", 30, ("student", 0)),
    ("internal tools, 12 years experience", 0, ("entry", 12)),
    ("one year", 30, ("entry", 0)),
    ("2 years of experience", 10, ("entry", 2)),
    ("2 years of experience", 15, ("mid", 3)),
    ("2 years of experience", 25, ("senior", 7)),
    ("3 years experience", 0, ("mid", 3)),
    ("2+ years of experience, associate", 0, ("mid", 3)),
    ("7 years of experience", 0, ("senior", 7)),
    ("10 years of experience", 0, ("principal", 10)),
    ("senior staff, 3 years of experience", 0, ("principal", 3)),
    ("2015 - 2018, 2020 - present", 0, ("senior", 8)),
    ("2001-2024", 0, ("principal", 20)),
])
def test_levels(texts, text, bullet_count, expected):
    (got,) = texts(lambda t, low: levels.detect_level(low, F.lit(bullet_count)), text)
    assert tuple(got) == expected


def test_resolve_level(texts):
    assert texts(lambda t, low: levels.resolve_level(t), "mid", "student", "principal", "senior") == [
        "mid", "entry", "entry", "senior"]
    assert texts(lambda t, low: levels.resolve_level(F.lit("mid"), t), "senior", "", "experienced", None) == [
        "senior", "mid", "entry", "mid"]


@pytest.mark.parametrize("title, body, level", [
    ("Summer Intern", "", "intern"), ("Tutor", "for a graduate student", "mid"), ("Art Director", "", "principal"),
    ("Contractor", "", "principal"), ("Engineering Manager", "", "principal"), ("Junior Developer", "", "entry"),
    ("Engineer", "level i role", "entry"), ("Engineer", "level i or ii role", "mid"), ("Graduate Analyst", "", "entry"),
    ("Senior Graduate", "", "senior"), ("Cook", "no experience required", "entry"), ("Senior Cook", "", "senior"),
    ("Senior Cook", "7+ years", "principal"), ("Senior Cook", "5-8 years", "senior"), ("Data Analyst", "", "mid"),
    ("Cook", "10+ years", "principal"), ("Cook", "5 plus years", "senior"), ("Cook", "3 to 5 years", "mid"),
    ("Cook", "1 years", "entry"), ("Cook", "strategic work", "principal"), ("Cook", "code review", "senior"),
    ("Cook", "collaborate", "mid"), ("Cook", "guidance given", "entry"), ("Programmer", "will train", "entry"),
    ("Programmer", "will train, proven track record", "mid"), ("Cook", "", "mid"), (None, None, "mid"),
])
def test_job_seniority(spark, title, body, level):
    df = spark.createDataFrame([(title, body)], "title string, body string")
    assert df.select(levels.detect_job_seniority(F.col("title"), F.col("body"))).first()[0] == level


def test_layout(texts):
    got = texts(lambda t, low: quality.analyze_layout(t), "|" * 51, "|" * 50, "\t" * 31, "x" * 101, "x" * 100, "x" * 150 + "\n")
    assert [tuple(x) for x in got] == [("complex", 2.0), ("single_column", 6.0), ("complex", 2.0), ("multi_column", 4.0),
                                       ("single_column", 6.0), ("single_column", 6.0)]


@pytest.mark.parametrize("durations, years, expected", [
    ([], [], (2.0, 0.0)), (["Jan 2020 - Mar 2021"], [], (4.0, 0.0)), (["Jan 2020", "3/2021"], [], (3.0, 0.0)),
    (["Jan 2020", "3/2021"], ["2019"], (2.0, 0.0)), ([None], [], (1.0, -5.0)), ([None, "Jan 2020"], [], (4.0, 0.0)),
    ([None, " ", "2020-01"], [], (4.0, -5.0)), (["soon"], [None], (1.0, 0.0)),
])
def test_date_consistency(spark, durations, years, expected):
    df = spark.createDataFrame([([(d,) for d in durations], [(y,) for y in years])],
                               "jobs array<struct<duration string>>, degrees array<struct<graduation_year string>>")
    assert tuple(df.select(quality.date_consistency(F.col("jobs"), F.col("degrees"))).first()[0]) == expected


def test_grammar(texts):
    small = "this line starts with a small letter\n"
    got = texts(lambda t, low: quality.grammar_score(t, low), "Fine.", small, small * 3, "A  b" * 6, "A  b" * 11, "teh x", "Teh x adress",
                small * 13, "- this is a bullet and stays free of errors", "i.e. this line is free of errors too", "seperate recieve refered occured")
    assert got == [5.0, 4.0, 3.0, 4.0, 3.0, 3.0, 2.0, 0.0, 5.0, 5.0, 0.0]


def test_tone(texts):
    def sentence(n):
        return " ".join(["word"] * n) + ". "
    got = texts(lambda t, low: quality.tone_score(t, low), "Too short.", sentence(25), sentence(26), sentence(31), sentence(36),
                "it was done here by one of the men ok. ", "it was seen and was left " + "x " * 13)
    assert got == [1.5, 3.0, 2.5, 2.0, 1.5, 2.5, 2.0]


def test_small_detectors(texts):
    assert texts(lambda t, low: quality.detect_tailoring(low), "Seeking a job", "x") == [True, False]
    assert texts(lambda t, low: quality.detect_leadership(low), "led and trained", "led only", "") == [True, False, False]
    assert texts(lambda t, low: quality.detect_oss(low), "across", "x") == [True, False]
    assert texts(lambda t, low: quality.certifications_score(low), "cfa", "cfa cpa", "cfa cpa licenses", "cfa cpa comptia", "") == [
        1.5, 3.0, 4.0, 4.0, 0.0]
    words = " ".join(["w"] * 40)
    assert texts(lambda t, low: quality.summary_score(t, low), "Summary " + words, "profile " + " ".join(["w"] * 19), "objective a",
                 "about me", "none", "x " * 400 + "summary " + " ".join(["w"] * 9)) == [5.0, 3.5, 0.5, 0.5, 0.0, 2.0]


def test_search_keywords(spark):
    rows = [(["agile", "python", "react", "rest", "communication", "tailwind"],), ([],), (["golf", "golf"],)]
    df = spark.createDataFrame(rows, "skills array<string>")
    got = [r[0] for r in df.select(vocabulary.search_keywords(F.col("skills"))).collect()]
    # "tailwind" is a framework and, through "ai", data science: it appears once, in the first place
    assert got == ["rest react tailwind python agile communication", "software developer", "golf"]
    soft = spark.createDataFrame([(["leadership", "communication", "teamwork", "analytical", "mentoring", "negotiation"],)], "skills array<string>")
    assert soft.select(vocabulary.search_keywords(F.col("skills"))).first()[0] == "leadership communication teamwork analytical mentoring"


def test_matched_terms_skip_parts_of_longer_ones(texts):
    got = texts(lambda t, low: vocabulary.matched_terms(vocabulary.match_terms(low), vocabulary.match_terms(F.lit("javascript and java, sql server api"))),
                "JavaScript, SQL Server, Java, API")
    assert got == [["javascript", "sql server", "api"]]
    assert texts(lambda t, low: vocabulary.topk_terms(F.split(t, ",")), "aa,bbbb,cc,dddd,e,ff,ggg") == [["bbbb", "dddd", "ggg", "aa", "cc"]]


def test_long_sections_are_read_in_linear_time(texts):
    """200,000 lines, and entries that begin and end around the borders of blocks of lines."""
    n = 200_000
    start = time.perf_counter()
    (got,) = texts(lambda t, low: sections.extract_experience(t), "Acme - Dev Jan 2018 - Mar 2020\nskipped\n" + "\n".join(f"- did {i}" for i in range(n)))
    assert [(e["organization"], e["description"]) for e in got] == [("Acme", " ".join(f"did {i}" for i in range(n)))]
    (got,) = texts(lambda t, low: sections.extract_projects(t), "Tool | Go\n" + "\n".join(f"- did {i}" for i in range(n)))
    assert [(e["name"], e["description"]) for e in got] == [("Tool", " ".join(f"did {i}" for i in range(n)))]
    assert time.perf_counter() - start < 120
    size = sections.BLOCK
    for before in range(size - 3, size + 3):
        text = "\n" * before + "Acme - Dev Jan 2018 - Mar 2020\nskipped\n- a\n- b\nEngineer\nShop\nFeb 2020 - Present\n- c"
        (got,) = texts(lambda t, low: sections.extract_experience(t), text)
        assert [tuple(e) for e in got] == [("Acme", "Dev", "Jan 2018 - Mar 2020", "a b"), ("Shop", "Engineer", "Feb 2020 - Present", "c")]
        (got,) = texts(lambda t, low: sections.extract_projects(t), "One | A\n" + "- x\n" * before + "Two | B,\nC\n- y")
        assert [tuple(e) for e in got] == [("One", "A", " ".join("x" * before)), ("Two", "B, C", "y")]


def test_bits_keep_the_terms_that_lists_keep(texts):
    """Over terms that hide one another, lie in different numbers of bits, and a text that is null."""
    names = [f"x{i}y" for i in range(70)] + ["javascript", "java", "x1", "sql"]
    sides = ["x1y x69y javascript", "java sql x69y", "javascript x1y x1 x69y sql x30y", "", None]
    other = F.lit("javascript, sql, x1y, x69y and x30y")
    bits = lambda t: vocabulary.found_bits(lambda n: F.contains(t, F.lit(n)), names)
    lists = lambda t: vocabulary.matched_terms(vocabulary.match_terms(t, names), vocabulary.match_terms(other, names))
    assert texts(lambda t, low: vocabulary.matched_by_bits(bits(t), bits(other), names), *sides) == texts(lambda t, low: lists(t), *sides)
    assert texts(lambda t, low: vocabulary.topk_by_bits(bits(t), bits(other), names, 3), *sides) == texts(lambda t, low: vocabulary.topk_terms(lists(t), 3), *sides)
    both = vocabulary.shared_bits
    assert texts(lambda t, low: both(bits(t), bits(other), names), *sides) == texts(
        lambda t, low: F.size(F.array_intersect(vocabulary.match_terms(t, names), vocabulary.match_terms(other, names))), *sides)
    assert texts(lambda t, low: both(vocabulary.item_bits(F.split(t, " "), names), bits(other), names), *sides) == [3, 3, 6, 0, 0]
