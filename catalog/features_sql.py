"""The text features in DuckDB SQL, written independently of the Spark expressions.

Lines are rows here, the parsers are recursive queries, and word edges are
spelled out, because the regular expressions of the two engines differ.
"""

import re

from catalog.inputs import CORPUS, for_duckdb
from vitaloom import fixed_values as fixed

W = r"\p{L}\p{M}\p{N}_"


def lit(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def sql_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def any_of(col, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(w)})" for w in words) + ")"


def how_many(col, words) -> str:
    return "(" + " + ".join(f"CAST(contains({col}, {lit(w)}) AS INT)" for w in words) + ")"


def ladder(value, steps, otherwise="0.0") -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {at} THEN {p}" for at, p in steps) + f" ELSE {otherwise} END"


def bands(value, rows, otherwise="0.0") -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {a}" + (f" AND {value} <= {b}" if b is not None else "") + f" THEN {p}"
                              for a, b, p in rows) + f" ELSE {otherwise} END"


def by_level(level, choices) -> str:
    return (f"CASE {level} WHEN 'entry' THEN {choices['entry']} WHEN 'mid' THEN {choices['mid']} "
            f"ELSE {choices['senior']} END")


def words(col) -> str:
    return rf"len(list_filter(regexp_split_to_array({col}, '\s+'), lambda w: w <> ''))"


def strip(col) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def first(col, pattern, group=0) -> str:
    return f"nullif(regexp_extract({col}, {lit(pattern)}, {group}), '')"


def occurrences(col, word) -> str:
    return f"((length({col}) - length(replace({col}, {lit(word)}, ''))) // {len(word)})"


def phrases_found(low, vocabulary) -> str:
    """Entries with blanks or punctuation that stand between word edges."""
    tests = []
    for t in vocabulary:
        if not re.fullmatch(r"\w+", t):
            after = f"([^{W}]|$)" if re.match(r"\w", t[-1]) else f"[{W}]"
            tests.append(f"CASE WHEN contains({low}, {lit(t)}) AND regexp_matches({low}, "
                         f"{lit(f'(^|[^{W}])' + re.escape(t) + after)}) THEN {lit(t)} END")
    return f"[{', '.join(tests)}]"


def section(starts, ends) -> str:
    start = "coalesce(" + ", ".join(f"nullif(strpos(low, {lit(w)}), 0)" for w in starts) + ")"
    hits = ", ".join(f"nullif(strpos(substring(low, p + 50), {lit(w)}), 0)" for w in ends)
    return (f"(SELECT substring(text, p, coalesce(least({hits}) + 49, length(text))) FROM (SELECT {start} AS p))")


def project_section() -> str:
    # the heading starts a line, after at most five blanks
    start = "coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches(low, {lit(r'(?m)^\s{0,5}' + w + r'\b')}) THEN "
        f"length(regexp_extract(low, {lit(r'(?s)^(.*?(?:^|\n)\s{0,5})' + w + r'\b')}, 1)) + 1 END"
        for w in fixed.PROJECT_START) + ")"
    hits = ", ".join(
        f"CASE WHEN regexp_matches(rest, {lit(r'(?m)^\s{0,5}' + w + r'\b')}) THEN "
        f"length(regexp_extract(rest, {lit(r'(?s)^(.*?)(?:^|\n)\s{0,5}' + w + r'\b')}, 1)) + 1 END"
        for w in fixed.PROJECT_END)
    return (f"(SELECT substring(text, p, coalesce(least({hits}) + 49, length(text))) FROM "
            f"(SELECT p, substring(low, p + 50) AS rest FROM (SELECT {start} AS p)))")


BULLET = r"^\s*[•\-*◦▪]\s+"
MONTHS = "(?i)" + fixed.MONTH_RANGE
SIGNS = sql_list(fixed.BULLET_SIGNS)
QUANTIFIED = "|".join(f"(?:{p})" for p in fixed.QUANTIFIED)


def detect_level_sql(low, bullets, n) -> str:
    """Text 'level:years'."""
    return f"""CASE WHEN {any_of(low, fixed.STUDENT_PHRASES)} THEN 'student:0'
  WHEN {any_of(low, fixed.ENTRY_WORDS)} OR {n} < 2 THEN 'entry:' || {n}
  WHEN {any_of(low, fixed.SENIOR_WORDS)} OR {n} >= 7 THEN
    CASE WHEN {n} >= 10 OR contains({low}, 'principal') OR contains({low}, 'staff') THEN 'principal:' ELSE 'senior:' END || {n}
  WHEN {any_of(low, fixed.MID_WORDS)} OR {n} >= 3 THEN 'mid:' || greatest({n}, 3)
  WHEN {bullets} >= 25 THEN 'senior:' || greatest({n}, 7)
  WHEN {bullets} >= 15 THEN 'mid:' || greatest({n}, 3) ELSE 'entry:' || {n} END"""


STATED = f"coalesce(list_max(list_transform(regexp_extract_all(low, {lit(fixed.STATED_YEARS)}, 1), lambda x: TRY_CAST(x AS BIGINT))), 0)"
RANGES = f"""least(20, coalesce(list_sum(list_transform(regexp_extract_all(low, {lit(fixed.YEAR_RANGE)}),
  lambda r: greatest(0, coalesce(TRY_CAST(regexp_extract(r, '(20[0-9][0-9]|present|current)$', 1) AS BIGINT), {fixed.CURRENT_YEAR})
  - CAST(r[1:4] AS BIGINT)))), 0))"""


def features(corpus: str = CORPUS) -> str:
    """``WITH`` clause that ends in ``features``, one row per document of ``corpus(doc_id, text)``."""
    edu = f"coalesce({', '.join(first('edu', '(?i)' + p, 1) for p in fixed.INSTITUTIONS)})"
    deg = f"coalesce({', '.join(first('edu', '(?i)' + p, 1) for p in fixed.DEGREES)})"
    field = "CASE " + " ".join(f"WHEN contains(lower(edu), {lit(k)}) THEN {lit(v)}"
                               for k, v in fixed.FIELDS_OF_STUDY.items()) + f" ELSE {lit(fixed.DEFAULT_FIELD)} END"
    found = [f"CASE WHEN {any_of('low', ws)} THEN {lit(name)} END" for name, ws in fixed.SECTION_WORDS.items()]
    return f"""WITH RECURSIVE src AS (SELECT * FROM ({for_duckdb(corpus)})),
low AS (SELECT *, lower(text) AS low FROM src),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM src),
marked AS (SELECT *, sum(CAST(regexp_matches(s, {lit(BULLET)}) AS INT)) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM line),
bullet AS (SELECT doc_id, b, string_agg(s, ' ' ORDER BY n) AS s FROM marked WHERE b > 0 AND trim(s) <> '' GROUP BY doc_id, b),
bullets AS (SELECT doc_id, CAST(count(*) AS INT) AS total_bullets,
  CAST(count(*) FILTER (regexp_matches(lower(s), {lit(QUANTIFIED)})) AS INT) AS quantified_bullets FROM bullet GROUP BY doc_id),
cut AS (SELECT doc_id, {section(fixed.EDUCATION_START, fixed.EDUCATION_END)} AS edu,
  {section(fixed.EXPERIENCE_START, fixed.EXPERIENCE_END)} AS xp, {project_section()} AS pj FROM low),
schooling AS (SELECT doc_id, {edu} AS institution, {deg} AS degree, {field} AS field,
  regexp_extract_all(edu, '20[0-9]{{2}}')[-1] AS graduation_year FROM cut),
xline AS (SELECT doc_id, n, s, dates, s <> '' AND list_contains({SIGNS}, s[1]) AS bullet,
  s = '' OR list_contains({sql_list(fixed.EXPERIENCE_START)}, lower(s)) AS ignored,
  lead(s) OVER w AS s2, lead(dates, 2) OVER w AS dates3
  FROM (SELECT doc_id, n, s, {first('s', MONTHS)} AS dates FROM (SELECT doc_id, {strip('s')} AS s, n FROM
    (SELECT doc_id, unnest(string_split(xp, chr(10))) AS s, generate_subscripts(string_split(xp, chr(10)), 1) AS n FROM cut)))
  WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
xfold AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS org, CAST(NULL AS VARCHAR) AS role,
    CAST(NULL AS VARCHAR) AS duration, CAST([] AS VARCHAR[]) AS said, CAST([] AS VARCHAR[]) AS done FROM cut WHERE xp IS NOT NULL
  UNION ALL
  SELECT doc_id, i + CASE kind WHEN 'dated' THEN 2 WHEN 'headed' THEN 3 ELSE 1 END,
    CASE kind WHEN 'dated' THEN new_org WHEN 'headed' THEN s2 WHEN 'named' THEN s ELSE org END,
    CASE kind WHEN 'dated' THEN new_role WHEN 'headed' THEN s WHEN 'named' THEN NULL ELSE role END,
    CASE kind WHEN 'dated' THEN dates WHEN 'headed' THEN dates3 WHEN 'named' THEN NULL ELSE duration END,
    CASE kind WHEN 'dated' THEN CASE WHEN bullet AND (coalesce(new_org, '') <> '' OR coalesce(new_role, '') <> '')
        THEN [{strip('s[2:]')}] ELSE [] END
      WHEN 'headed' THEN [] WHEN 'named' THEN []
      WHEN 'told' THEN list_append(said, CASE WHEN bullet THEN {strip('s[2:]')} ELSE s END) ELSE said END,
    CASE WHEN kind IN ('dated', 'headed') AND is_open THEN list_append(done, entry) ELSE done END
  FROM (SELECT *, CASE WHEN sep = '' THEN before ELSE {strip("string_split(before, sep)[1]")} END AS new_org,
      CASE WHEN sep <> '' THEN {strip("substring(before, strpos(before, sep) + 1)")} END AS new_role
    FROM (SELECT *, CASE WHEN contains(before, '-') THEN '-' WHEN contains(before, '|') THEN '|' ELSE '' END AS sep
      FROM (SELECT f.*, l.*  EXCLUDE (doc_id, n), {strip('string_split(s, dates)[1]')} AS before,
        coalesce(org, '') <> '' OR coalesce(role, '') <> '' AS is_open,
        concat(coalesce(nullif(org, ''), 'Unknown'), '~', coalesce(nullif(role, ''), 'Unknown'), '~', coalesce(duration, ''),
          '~', array_to_string(said, ' ')) AS entry,
        CASE WHEN ignored THEN 'skip' WHEN dates IS NOT NULL THEN 'dated' WHEN dates3 IS NOT NULL AND NOT bullet THEN 'headed'
          WHEN (coalesce(org, '') <> '' OR coalesce(role, '') <> '') AND (bullet OR (len(said) > 0 AND length(s) > 10)) THEN 'told'
          WHEN coalesce(org, '') = '' AND NOT bullet AND {words('s')} <= 6 AND NOT regexp_matches(s, '[0-9]') THEN 'named'
          ELSE 'skip' END AS kind
        FROM xfold f JOIN xline l ON l.doc_id = f.doc_id AND l.n = f.i)))),
jobs_found AS (SELECT doc_id, CASE WHEN coalesce(org, '') <> '' OR coalesce(role, '') <> '' THEN list_append(done,
    concat(coalesce(nullif(org, ''), 'Unknown'), '~', coalesce(nullif(role, ''), 'Unknown'), '~', coalesce(duration, ''),
      '~', array_to_string(said, ' '))) ELSE done END AS work
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS back FROM xfold) WHERE back = 1),
pline AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n, s,
  list_contains({SIGNS}, s[1]) AS bullet, contains(s, '|') AS pipe,
  regexp_matches(lower(s), '^(http|github|gitlab|link)') AS link, {any_of('lower(s)', fixed.PROJECT_START)} AS header,
  {words('s')} <= 2 AND length(s) < 30 AS short
  FROM (SELECT doc_id, {strip('s')} AS s, n FROM
    (SELECT doc_id, unnest(string_split(pj, chr(10))) AS s, generate_subscripts(string_split(pj, chr(10)), 1) AS n FROM cut))
  WHERE s <> ''),
pfold AS (
  SELECT doc_id, CAST(1 AS BIGINT) AS i, 'idle' AS stage, CAST('' AS VARCHAR) AS name, CAST([] AS VARCHAR[]) AS tech,
    CAST([] AS VARCHAR[]) AS said, CAST([] AS VARCHAR[]) AS done FROM cut WHERE pj IS NOT NULL
  UNION ALL
  SELECT doc_id, i + CASE WHEN act IN ('close', 'notech', 'nosub') THEN 0 ELSE 1 END,
    CASE act WHEN 'open' THEN 'tech' WHEN 'tech' THEN CASE WHEN s[-1] = ',' THEN 'tech' ELSE 'sub' END
      WHEN 'notech' THEN 'sub' WHEN 'sub' THEN 'body' WHEN 'nosub' THEN 'body' WHEN 'close' THEN 'idle' ELSE stage END,
    CASE act WHEN 'open' THEN {strip("string_split(s, '|')[1]")} ELSE name END,
    CASE act WHEN 'open' THEN [{strip("substring(s, strpos(s, '|') + 1)")}] WHEN 'tech' THEN list_append(tech, s) ELSE tech END,
    CASE act WHEN 'open' THEN [] WHEN 'sub' THEN [s]
      WHEN 'bullet' THEN CASE WHEN {strip('s[2:]')} = '' THEN said ELSE list_append(said, {strip('s[2:]')}) END ELSE said END,
    CASE act WHEN 'close' THEN list_append(done, concat(name, '~', {strip("array_to_string(tech, ' ')")}, '~',
      array_to_string(said, ' '))) ELSE done END
  FROM (SELECT f.*, l.* EXCLUDE (doc_id, n), CASE stage
      WHEN 'idle' THEN CASE WHEN NOT header AND pipe AND NOT bullet THEN 'open' ELSE 'skip' END
      WHEN 'tech' THEN CASE WHEN NOT bullet AND NOT link AND NOT pipe AND (contains(s, ',') OR tech[-1][-1] = ',' OR short)
        THEN 'tech' ELSE 'notech' END
      WHEN 'sub' THEN CASE WHEN NOT bullet AND NOT link AND NOT pipe AND length(s) > 15 AND length(s) < 100 THEN 'sub'
        ELSE 'nosub' END
      ELSE CASE WHEN bullet THEN 'bullet' WHEN link THEN 'skip' ELSE 'close' END END AS act
    FROM pfold f JOIN pline l ON l.doc_id = f.doc_id AND l.n = f.i)),
projects_found AS (SELECT doc_id, CASE WHEN stage <> 'idle' THEN list_append(done, concat(name, '~',
    {strip("array_to_string(tech, ' ')")}, '~', array_to_string(said, ' '))) ELSE done END AS projects
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC, len(done) DESC, stage DESC) AS back,
    max(i) OVER (PARTITION BY doc_id) AS top FROM (SELECT *, row_number() OVER () AS step FROM pfold))
  WHERE i = top QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) = 1),
token AS (SELECT doc_id, tokens, list_distinct(list_concat(tokens, phrases)) AS found
  FROM (SELECT doc_id, regexp_split_to_array(low, '[^{W}]+') AS tokens,
    {phrases_found('low', fixed.TECHNICAL_SKILLS + fixed.SOFT_SKILLS)} AS phrases FROM low)),
base AS (SELECT low.doc_id, text, low, tokens, coalesce(total_bullets, 0) AS total_bullets,
    coalesce(quantified_bullets, 0) AS quantified_bullets, institution, degree, field, graduation_year,
    institution IS NOT NULL OR degree IS NOT NULL AS has_education,
    coalesce(work, []) AS work, coalesce(projects, []) AS projects,
    {words('text')} AS word_count, {first('text', fixed.EMAIL)} AS email, {first('text', fixed.PHONE)} AS phone,
    coalesce({', '.join(first('text', p) for p in fixed.LOCATIONS)}) AS location,
    coalesce({', '.join(first('text', '(?i)' + p, 1) for p in fixed.LINKEDIN)}) AS linkedin,
    coalesce({', '.join(first('text', '(?i)' + p, 1) for p in fixed.GITHUB)}) AS github,
    list_filter(list_transform(string_split(text, chr(10))[1:5], lambda l: {strip('l')}), lambda l: l <> ''
      AND NOT regexp_matches(l, '[0-9]') AND {words('l')} <= 4 AND NOT {any_of('lower(l)', fixed.NOT_A_NAME)})[1] AS name,
    list_filter([{', '.join(found)}], lambda x: x IS NOT NULL) AS sections,
    list_filter({sql_list(fixed.ACTION_VERBS)}, lambda v: list_contains(found, v)) AS verbs,
    list_filter({sql_list(fixed.TECHNICAL_SKILLS + fixed.SOFT_SKILLS)}, lambda t: list_contains(found, t)) AS skills,
    regexp_extract_all(text, {lit(fixed.NUMBER)}) AS numbers,
    {STATED} AS stated, {RANGES} AS ranges
  FROM low JOIN token USING (doc_id) LEFT JOIN bullets USING (doc_id) LEFT JOIN schooling USING (doc_id)
    LEFT JOIN jobs_found USING (doc_id) LEFT JOIN projects_found USING (doc_id)),
sized AS (SELECT *, list_transform(verbs, lambda v: len(list_filter(tokens, lambda t: t = v))) AS verb_counts,
    {detect_level_sql('low', 'total_bullets', '(CASE WHEN stated > 0 THEN stated ELSE ranges END)')} AS seniority,
    len(work) AS jobs, CAST(has_education AS INT) AS degrees,
    email IS NOT NULL AND phone IS NOT NULL AS has_contact FROM base),
features AS (SELECT *, string_split(seniority, ':')[1] AS experience_level, CAST(string_split(seniority, ':')[2] AS BIGINT) AS years,
    {_layout()} AS layout, {_dates('score')} AS date_score, {_dates('penalty')} AS date_penalty,
    {_grammar()} AS grammar, {_tone()} AS tone, {_summary()} AS summary, {_certificates()} AS certificates,
    {any_of('low', fixed.TARGETING_PHRASES)} AS tailored, {how_many('low', fixed.LEADERSHIP_WORDS)} >= 2 AS leads,
    {any_of('low', fixed.OPEN_SOURCE_WORDS)} AS open_source FROM sized)
"""


def _layout() -> str:
    return (f"CASE WHEN {occurrences('text', '|')} > 50 OR length(text) - length(replace(text, chr(9), '')) > 30 THEN 'complex' "
            "WHEN list_avg(list_transform(string_split(text, chr(10)), lambda l: length(l))) > 100 THEN 'multi_column' "
            "ELSE 'single_column' END")


def _dates(what) -> str:
    kind = ("CASE WHEN d = '' THEN NULL " + " ".join(f"WHEN regexp_matches(d, {lit(p)}) THEN {lit(k)}"
                                                     for k, p in fixed.DATE_FORMATS.items()) + " END")
    durations = "list_transform(work, lambda w: string_split(w, '~')[3])"
    kinds = (f"len(list_distinct(list_filter(list_append(list_transform({durations}, lambda d: {kind}), "
             "CASE WHEN has_education AND graduation_year IS NOT NULL THEN 'year_only' END), lambda k: k IS NOT NULL)))")
    missing = (f"(len(list_filter({durations}, lambda d: d = '')) + "
               "CASE WHEN has_education AND graduation_year IS NULL THEN 1 ELSE 0 END)")
    if what == "penalty":
        return f"CASE WHEN {missing} > (jobs + degrees) // 2 THEN -5.0 ELSE 0.0 END"
    return (f"CASE WHEN jobs + degrees = 0 THEN 2.0 ELSE CASE {kinds} WHEN 0 THEN 1.0 WHEN 1 THEN 4.0 WHEN 2 THEN 3.0 "
            "ELSE 2.0 END END")


def _grammar() -> str:
    gaps = occurrences("text", "  ")
    small = (f"len(list_filter(list_transform(string_split(text, chr(10)), lambda l: {strip('l')}), lambda l: length(l) > 20 AND "
             r"regexp_matches(l, '^\p{Ll}') AND NOT starts_with(l, 'i.e') AND NOT starts_with(l, 'e.g')))")
    errors = (f"(CASE WHEN {gaps} > 10 THEN 2 WHEN {gaps} > 5 THEN 1 ELSE 0 END + 2 * {how_many('low', fixed.TYPOS)} + 0.5 * {small})")
    return (f"CASE WHEN {errors} = 0 THEN 5.0 WHEN {errors} <= 1 THEN 4.0 WHEN {errors} <= 2 THEN 3.0 "
            f"WHEN {errors} <= 4 THEN 2.0 WHEN {errors} <= 6 THEN 1.0 ELSE 0.0 END")


def _tone() -> str:
    sizes = (f"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {words('s')}), lambda n: n > 3)")
    passive = " + ".join(occurrences("low", w) for w in fixed.PASSIVE_WORDS)
    ratio = f"(({passive}) / greatest(word_count, 1))"
    mean = f"list_avg({sizes})"
    return (f"CASE WHEN len({sizes}) = 0 THEN 1.5 ELSE greatest(0.0, 3.0 - CASE WHEN {mean} > 35 THEN 1.5 WHEN {mean} > 30 THEN 1.0 "
            f"WHEN {mean} > 25 THEN 0.5 ELSE 0.0 END - CASE WHEN {ratio} > 0.10 THEN 1.0 WHEN {ratio} > 0.06 THEN 0.5 ELSE 0.0 END) END")


def _summary() -> str:
    start = "least(" + ", ".join(f"nullif(strpos(low, {lit(w)}), 0)" for w in fixed.SUMMARY_WORDS) + ")"
    n = words(f"substring(text, {start}, 300)")
    return (f"CASE WHEN {start} IS NULL THEN CASE WHEN contains(low, 'about me') THEN 0.5 ELSE 0.0 END "
            f"WHEN {n} >= 30 THEN 5.0 WHEN {n} >= 20 THEN 3.5 WHEN {n} >= 10 THEN 2.0 ELSE 0.5 END")


def _certificates() -> str:
    n = how_many("low", fixed.CERTIFICATES)
    return (f"CASE WHEN {n} >= 3 OR ({n} = 2 AND {any_of('low', fixed.SECTION_WORDS['certifications'])}) THEN 4.0 "
            f"WHEN {n} = 2 THEN 3.0 WHEN {n} = 1 THEN 1.5 ELSE 0.0 END")
