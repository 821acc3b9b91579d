"""Education, experience and project entries.

The experience and project parsers read lines in order, so each is a fold over
the line array of its section: map-only, inside the JVM, and without state
shared between documents. A fold copies its state for every line, so the state
is a few flags and the roles that lines of one block were found to have; entries
are put together from lines and roles afterwards. That keeps long sections linear.
"""

from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions.bullets import starts_with_bullet
from vitaloom.functions.text import all_matches, bind, first_match, first_word_position, has_any, strip, word_count

EDUCATION_TYPE = "array<struct<degree:string,field:string,institution:string,graduation_year:string>>"
EXPERIENCE_TYPE = "array<struct<organization:string,role:string,duration:string,description:string>>"
PROJECT_TYPE = "array<struct<name:string,technology:string,description:string>>"

_PARTS = "array<struct<line:int,role:int>>"
# Lines whose roles are gathered in one fold.
BLOCK = 128


def _text(value=None):
    return F.lit(value).cast("string")


def _until(text, text_lc, start, find, ends):
    """Text from ``start`` to the nearest end, looking from a minimum length on; null without a start."""
    def cut(p):
        rest = F.substring(text_lc, p + F.lit(fixed.SECTION_MIN_LENGTH), F.length(text_lc))
        nearest = bind(rest, lambda r: F.least(*[find(r, w) for w in ends]))
        length = F.coalesce(nearest + F.lit(fixed.SECTION_MIN_LENGTH - 1), F.length(text))
        return F.when(p.isNotNull(), F.substring(text, p, length))

    return bind(start, cut)


def extract_section(text, text_lc, starts, ends):
    """Text from the first start word in list order to the nearest end word, or null."""
    return _until(text, text_lc, first_word_position(text_lc, starts),
                  lambda rest, w: F.nullif(F.locate(w, rest), F.lit(0)), ends)


def education_section(text, text_lc):
    return extract_section(text, text_lc, fixed.EDUCATION_START, fixed.EDUCATION_END)


def experience_section(text, text_lc):
    return extract_section(text, text_lc, fixed.EXPERIENCE_START, fixed.EXPERIENCE_END)


def _heading(word):
    return F.lit(r"(?mdU)(?:^|\n)\s{0,5}" + word + r"\b")


def project_section(text, text_lc):
    """Like :func:`extract_section`, but headings must stand near the start of a line.

    The patterns run only where the plain word occurs.
    """
    def start_of(word):
        found = F.regexp_instr(text_lc, _heading(word)) + F.length(F.regexp_substr(text_lc, _heading(word))) - len(word)
        return F.when(F.contains(text_lc, F.lit(word)), found)

    def end_of(rest, word):
        return F.when(F.contains(rest, F.lit(word)), F.nullif(F.regexp_instr(rest, _heading(word)), F.lit(0)))

    return _until(text, text_lc, F.coalesce(*[start_of(w) for w in fixed.PROJECT_START]), end_of, fixed.PROJECT_END)


def extract_education(section):
    """At most one entry; none when neither a degree nor an institution is named."""
    def entry(institution, degree, field, year):
        row = F.struct(F.coalesce(degree, F.lit(fixed.DEFAULT_DEGREE)).alias("degree"),
                       F.coalesce(field, F.lit(fixed.DEFAULT_FIELD)).alias("field"),
                       institution.alias("institution"), year.alias("graduation_year"))
        some = F.coalesce(institution, degree).isNotNull()
        return F.when(some, F.array(row)).otherwise(F.array()).cast(EDUCATION_TYPE)

    def read(s, low):
        institution = F.coalesce(*[F.when(has_any(low, fixed.INSTITUTION_HINTS[i]), first_match(s, "(?i)" + p, 1))
                                   for i, p in enumerate(fixed.INSTITUTIONS)])
        degree = F.coalesce(*[first_match(s, "(?i)" + p, 1) for p in fixed.DEGREES])
        field = F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(v)) for k, v in fixed.FIELDS_OF_STUDY.items()])
        year = bind(all_matches(s, r"20\d{2}"), lambda ys: F.get(ys, F.size(ys) - 1))
        found = F.struct(institution.alias("i"), degree.alias("d"), field.alias("f"), year.alias("y"))
        return bind(found, lambda x: entry(x["i"], x["d"], x["f"], x["y"]))

    return F.coalesce(bind(section, lambda s: F.when(s.isNotNull(), bind(F.lower(s), lambda low: read(s, low)))), F.array().cast(EDUCATION_TYPE))


def _is_set(col):
    return F.coalesce(col, F.lit("")) != ""


def _parts(lines, start, step):
    """All parts that the fold of ``step`` from ``start`` adds to its state's ``parts``.

    A first pass finds the states at the beginning of each block (nothing to do for a single block), a second one gathers
    the parts block by block.
    """
    def block(b):
        return F.slice(lines, b * BLOCK + 1, F.lit(BLOCK))

    def next_state(state, b):
        return F.aggregate(block(b), state, step, lambda x: x.withField("parts", F.slice(x["parts"], 1, 0)))

    last = F.floor((F.size(lines) - 1) / BLOCK).cast("int")
    earlier = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    states = F.aggregate(earlier, F.array(start), lambda known, b: F.concat(known, F.array(next_state(F.element_at(known, -1), b))))
    return F.flatten(F.transform(states, lambda state, b: F.aggregate(block(b), state, step, lambda x: x["parts"])))


# Roles of lines: opening an entry, opening one in place of the last, or adding to the open one.
_OPENS, _REPLACES, _SAYS, _LISTS = 0, 1, 2, 3


def _with(state, line, role):
    """The state's parts and one more."""
    return F.concat(state["parts"], F.array(F.struct(line["i"].alias("line"), F.lit(role).alias("role"))))


def _entries(lines, parts, entry):
    """``entry(opening line, its role, the parts, role of the next opening or null)`` for each entry."""
    def build(ps):
        openings = F.filter(F.transform(ps, lambda p, i: F.when(p["role"] <= _REPLACES, i)), lambda i: i.isNotNull())
        return bind(openings, lambda starts: F.transform(starts, lambda a, k: bind(
            F.coalesce(F.get(starts, k + 1), F.size(ps)), lambda b: entry(
                F.get(lines, F.get(ps, a)["line"]), F.get(ps, a)["role"], F.slice(ps, a + 1, b - a), F.get(ps, b)["role"]))))

    return bind(parts, build)


def _job_state(skip_to, has_org, is_open, told, parts):
    return F.struct(skip_to.alias("skip_to"), has_org.alias("has_org"), is_open.alias("open"), told.alias("told"),
                    parts.alias("parts"))


def extract_experience(section):
    """Jobs of an experience section: dated lines, three-line headings, or a plain short line."""
    no, yes = F.lit(False), F.lit(True)

    def describe(line, i):
        s = strip(line)
        return F.struct(i.alias("i"), s.alias("s"), starts_with_bullet(s).alias("bullet"),
                        first_match(s, "(?i)" + fixed.MONTH_RANGE).alias("dates"),
                        ((s == "") | F.lower(s).isin(fixed.EXPERIENCE_START)).alias("ignored"))

    def read(line, lines):
        """What a line is, whatever stands before it. ``next`` is the line to go on with after it opened an entry."""
        s = line["s"]
        nxt, third = F.get(lines, line["i"] + 1), F.get(lines, line["i"] + 2)

        # a dated line opens a job, and the line below it is not read
        before = strip(F.call_function("substring_index", s, line["dates"], F.lit(1)))
        mark = F.when(F.contains(before, F.lit("-")), F.lit("-")).when(F.contains(before, F.lit("|")), F.lit("|"))
        cut = F.instr(before, "-")
        cut = F.when(mark == "-", cut).otherwise(F.instr(before, "|"))
        org = F.when(mark.isNull(), before).otherwise(strip(F.substring(before, F.lit(1), cut - 1)))
        role = F.when(mark.isNotNull(), strip(F.substring(before, cut + 1, F.length(before))))

        def heading(skip, org, role, dates):
            return F.struct((line["i"] + skip).alias("next"), org.alias("org"), role.alias("role"), dates.alias("duration"))

        opens = F.when(line["dates"].isNotNull(), heading(2, org, role, line["dates"])).when(
            third["dates"].isNotNull() & ~line["bullet"], heading(3, nxt["s"], s, third["dates"]))
        is_name = ~line["bullet"] & (word_count(s) <= 6) & ~s.rlike(r"(?U)\d")
        text = F.when(line["bullet"], strip(F.substring(s, F.lit(2), F.length(s)))).otherwise(s)
        return bind(opens, lambda x: F.struct(
            line["i"].alias("i"), s.alias("s"), line["ignored"].alias("ignored"), line["bullet"].alias("bullet"),
            x.alias("opens"), _is_set(x["org"]).alias("has_org"), (_is_set(x["org"]) | _is_set(x["role"])).alias("known"),
            F.when(x.isNull(), is_name).alias("is_name"), (F.length(s) > 10).alias("long"), text.alias("text")))

    def step(state, line):
        opened = _job_state(line["opens"]["next"], line["has_org"], line["known"], line["bullet"] & line["known"],
                            _with(state, line, _OPENS))
        told = _job_state(state["skip_to"], state["has_org"], state["open"], yes, _with(state, line, _SAYS))
        # a name takes the place of an entry that has only a role
        named = _job_state(state["skip_to"], yes, yes, no, _with(state, line, _REPLACES))
        goes_on = state["open"] & (line["bullet"] | (state["told"] & line["long"]))
        return (F.when((line["i"] < state["skip_to"]) | line["ignored"], state)
                .when(line["opens"].isNotNull(), opened).when(goes_on, told)
                .when(~state["has_org"] & line["is_name"], named).otherwise(state))

    def entries(lines):
        def entry(line, role, parts, following):
            named = role == _REPLACES
            org = F.when(named, line["s"]).otherwise(line["opens"]["org"])
            said = F.transform(parts, lambda p: bind(F.get(lines, p["line"]), lambda x: F.when(
                (p["role"] == _SAYS) | ((p["role"] == _OPENS) & x["bullet"]), x["text"])))
            row = F.struct(F.coalesce(F.nullif(org, F.lit("")), F.lit("Unknown")).alias("organization"),
                           F.coalesce(F.nullif(line["opens"]["role"], F.lit("")), F.lit("Unknown")).alias("role"),
                           line["opens"]["duration"].alias("duration"), F.array_join(said, " ").alias("description"))
            return F.when((named | line["known"]) & ~F.coalesce(following == _REPLACES, no), row)

        start = _job_state(F.lit(0), no, no, no, F.array().cast(_PARTS))
        return F.filter(_entries(lines, _parts(lines, start, step), entry), lambda e: e.isNotNull())

    described = F.transform(F.split(F.coalesce(section, F.lit("")), "\n"), describe)
    lines = bind(described, lambda ls: F.transform(ls, lambda line: read(line, ls)))
    return bind(lines, entries).cast(EXPERIENCE_TYPE)


# What the fold is reading: nothing, technologies, a subtitle, or the description.
_IDLE, _TECH, _SUBTITLE, _BODY = 0, 1, 2, 3


def _project_state(stage, comma, parts):
    return F.struct(stage.alias("stage"), comma.alias("comma"), parts.alias("parts"))


def extract_projects(section):
    """``Name | Technologies`` lines with their technology, subtitle and bullet lines."""
    no = F.lit(False)

    def describe(s, i):
        low = F.lower(s)
        link = F.coalesce(low.rlike("^(" + "|".join(fixed.PROJECT_LINK_WORDS) + ")"), F.lit(False))
        bullet, pipe = starts_with_bullet(s), F.contains(s, F.lit("|"))
        opens = pipe & ~bullet & ~has_any(low, fixed.PROJECT_START)
        plain, cut, rest = ~bullet & ~pipe & ~link, F.instr(s, "|"), F.length(s)
        return F.struct(i.alias("i"), s.alias("s"), bullet.alias("bullet"), link.alias("link"), plain.alias("plain"),
                        (F.contains(s, F.lit(",")) | (word_count(s) <= 2) & (rest < 30)).alias("listed"),
                        rest.between(16, 99).alias("titled"), opens.alias("opens"),
                        F.when(bullet, strip(F.substring(s, F.lit(2), rest))).alias("text"),
                        F.when(opens, strip(F.substring(s, F.lit(1), cut - 1))).alias("name"),
                        F.when(opens, strip(F.substring(s, cut + 1, rest))).alias("tech"))

    def step(state, line):
        s, stage, parts = line["s"], state["stage"], state["parts"]
        more_tech = (stage == _TECH) & line["plain"] & (line["listed"] | state["comma"])
        subtitle = ((stage == _TECH) | (stage == _SUBTITLE)) & line["plain"] & line["titled"]
        body = F.lit(_BODY)
        with_tech = _project_state(F.when(s.endswith(","), _TECH).otherwise(_SUBTITLE), s.endswith(","), _with(state, line, _LISTS))
        with_subtitle = _project_state(body, no, _with(state, line, _SAYS))
        with_bullet = _project_state(body, no, F.when(line["text"] == "", parts).otherwise(_with(state, line, _SAYS)))
        past_link = _project_state(body, no, parts)
        opened = _project_state(F.lit(_TECH), line["tech"].endswith(","), _with(state, line, _OPENS))
        idle = _project_state(F.lit(_IDLE), no, parts)
        reading = stage > _IDLE
        return (F.when(more_tech, with_tech).when(subtitle, with_subtitle)
                .when(reading & line["bullet"], with_bullet).when(reading & line["link"], past_link)
                .when(line["opens"], opened).otherwise(idle))

    def entries(lines):
        def entry(line, role, parts, following):
            def texts(role, value):
                return F.transform(F.filter(parts, lambda p: p["role"] == role), lambda p: bind(F.get(lines, p["line"]), value))

            tech = F.concat(F.array(line["tech"]), texts(_LISTS, lambda x: x["s"]))
            return F.struct(line["name"].alias("name"), strip(F.array_join(tech, " ")).alias("technology"),
                            F.array_join(texts(_SAYS, lambda x: F.coalesce(x["text"], x["s"])), " ").alias("description"))

        start = _project_state(F.lit(_IDLE), no, F.array().cast(_PARTS))
        return _entries(lines, _parts(lines, start, step), entry)

    stripped = F.transform(F.split(F.coalesce(section, F.lit("")), "\n"), strip)
    return bind(F.transform(F.filter(stripped, lambda s: s != ""), describe), entries).cast(PROJECT_TYPE)
