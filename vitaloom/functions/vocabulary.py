"""Vocabulary hits: sections, verbs, skills, numbers, search keywords, match terms."""

from functools import reduce
from operator import add

from pyspark.sql import functions as F

from vitaloom import fixed_values as fixed
from vitaloom.functions.text import all_matches, bind, has_any, string_array, substrings_present, tokens, whole_words


def find_sections(text_lc, section_words=None):
    section_words = section_words or fixed.SECTION_WORDS
    return F.array_compact(F.array(*[F.when(has_any(text_lc, words), F.lit(name))
                                     for name, words in section_words.items()]))


def missing_sections(sections):
    """The expected sections that were not found, in fixed order."""
    return F.array_except(string_array(fixed.EXPECTED_SECTIONS), sections)


def find_action_verbs(text_lc, verbs=None, words=None):
    return whole_words(text_lc, verbs or fixed.ACTION_VERBS, words)


def action_verb_frequency(text_lc, verbs=None, words=None):
    """Map of verb to count, only verbs that occur."""
    verbs = verbs or fixed.ACTION_VERBS

    def count(ws):
        def times(v):
            # phrases are counted in the text, between word edges
            phrase = F.regexp_count(text_lc, F.concat(F.lit(r"(?U)\b\Q"), v, F.lit(r"\E\b")))
            return F.when(F.contains(v, F.lit(" ")), phrase).otherwise(F.size(F.filter(ws, lambda w: w == v)))

        return F.transform(find_action_verbs(text_lc, verbs, ws), lambda v: F.struct(v, times(v) if any(" " in w for w in verbs) else F.size(F.filter(ws, lambda w: w == v))))

    return F.map_from_entries(bind(tokens(text_lc) if words is None else words, count))


def repetitive_verbs(frequency, limit=2):
    return F.map_filter(frequency, lambda verb, n: n > limit)


def find_skills(text_lc, skills=None, words=None):
    return whole_words(text_lc, skills or fixed.TECHNICAL_SKILLS + fixed.SOFT_SKILLS, words)


def find_numbers(text):
    return all_matches(text, fixed.NUMBER)


def _in_category(low, name, words):
    """Whether a skill, in lower case, is of a category."""
    return low.isin(words) if name == fixed.EXACT_CATEGORY else has_any(low, words)


def skill_category(skills, name, categories=None):
    words = (categories or fixed.SEARCH_CATEGORIES)[name]
    return F.filter(skills, lambda s: bind(F.lower(s), lambda low: _in_category(low, name, words)))


def skill_category_counts(skills, categories=None):
    """Struct with the number of skills in each search category."""
    categories = categories or fixed.SEARCH_CATEGORIES

    def count(lows, name):
        return F.size(F.filter(lows, lambda low: _in_category(low, name, categories[name]))).alias(name)

    return bind(F.transform(skills, F.lower), lambda lows: F.struct(*[count(lows, name) for name in categories]))


def uncategorized_skills(skills, categories=None):
    categories = categories or fixed.SEARCH_CATEGORIES

    def known(low):
        return reduce(lambda a, b: a | b, [_in_category(low, n, w) for n, w in categories.items()])

    return F.array_distinct(F.filter(skills, lambda s: ~bind(F.lower(s), known)))


def cap_soft_skills(skills, limit=fixed.SOFT_LIMIT):
    return F.slice(skill_category(skills, fixed.SOFT_CATEGORY), 1, limit)


def search_keywords(skills):
    """Skills in search order, each once, joined by blanks."""
    def chosen(known):
        ordered = [skill_category(known, n) for n in fixed.SEARCH_CATEGORIES if n != fixed.SOFT_CATEGORY]
        return F.array_distinct(F.concat(*ordered, cap_soft_skills(known), uncategorized_skills(known)))

    picked = bind(F.array_distinct(F.filter(skills, lambda s: F.trim(s) != "")), chosen)
    return F.coalesce(F.nullif(F.array_join(picked, " "), F.lit("")), F.lit(fixed.DEFAULT_SEARCH))


def match_terms(text_lc, terms=None):
    """Match terms that occur in one text; computed once per document, never per pair."""
    return substrings_present(text_lc, terms or fixed.MATCH_TERMS)


def matched_terms(resume_terms, job_terms):
    """Terms of both texts, without terms that are part of one already kept."""
    return F.aggregate(
        F.array_intersect(resume_terms, job_terms), F.array().cast("array<string>"),
        lambda kept, t: F.when(F.exists(kept, lambda k: F.contains(k, t)), kept).otherwise(F.concat(kept, F.array(t))))


# Names in one number of a set of bits.
WORD = 62


def _words(names):
    return [names[at:at + WORD] for at in range(0, len(names), WORD)]


def found_bits(found, names):
    """Which of the ``names`` hold, by the condition ``found(name)``, as bits: an array with a number for each ``WORD`` names."""
    return F.array(*[reduce(lambda a, b: a.bitwiseOR(b), [F.when(found(t), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, t in enumerate(ws)])
                     for ws in _words(names)]) if names else F.array().cast("array<long>")


def item_bits(items, names):
    """Which of the distinct ``names`` an array holds, as bits."""
    if not names:
        return F.array().cast("array<long>")
    known = string_array(names)

    def word(at, n):
        here = F.filter(at, lambda p: (p >= n * WORD) & (p < (n + 1) * WORD))
        bit = lambda held, p: held.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p - n * WORD))
        return F.coalesce(F.aggregate(here, F.lit(0).cast("long"), bit), F.lit(0).cast("long"))

    places = F.transform(items, lambda t: F.array_position(known, t).cast("int") - 1)
    return bind(places, lambda at: F.array(*[word(at, n) for n in range(len(_words(names)))]))


def shared_bits(a, b, names):
    """How many of the names two sets of bits have in common."""
    words = len(_words(names))
    if words > 8:
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), add)
    return reduce(add, [F.bit_count(F.get(a, F.lit(n)).bitwiseAND(F.get(b, F.lit(n)))) for n in range(words)], F.lit(0))


def matched_by_bits(a, b, terms=None):
    """:func:`matched_terms` of two sets of bits over the distinct ``terms``: one condition for each term in place of loops over lists."""
    return _matched_by_bits(a, b, terms, lambda terms: terms)


def topk_by_bits(a, b, terms=None, k=5):
    """:func:`topk_terms` of the terms that :func:`matched_by_bits` keeps."""
    return F.slice(_matched_by_bits(a, b, terms, lambda terms: sorted(terms, key=lambda t: -len(t))), 1, k)


def _matched_by_bits(a, b, terms, order):
    terms = list(dict.fromkeys(terms or fixed.MATCH_TERMS))
    at = {t: divmod(i, WORD) for i, t in enumerate(terms)}

    def kept(words):
        def holds(t):
            word, bit = at[t]
            hides = {}
            for longer in terms[:terms.index(t)]:
                if t in longer:
                    hides[at[longer][0]] = hides.get(at[longer][0], 0) | 1 << at[longer][1]
            alone = [words[n].bitwiseAND(F.lit(m)) == 0 for n, m in hides.items()]
            return reduce(lambda x, y: x & y, [words[word].bitwiseAND(F.lit(1 << bit)) != 0, *alone])

        return F.array_compact(F.array(*[F.when(holds(t), F.lit(t)) for t in order(terms)]))

    both = F.struct(*[F.get(a, F.lit(n)).bitwiseAND(F.get(b, F.lit(n))).alias(f"w{n}") for n in range(len(_words(terms)))])
    return kept([both[f"w{n}"] for n in range(len(_words(terms)))])


def topk_terms(terms, k=5):
    """The k longest terms; equal lengths keep their order."""
    ranked = F.array_sort(F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: r["t"])


def contained_skills(skills, text_lc):
    """The skills whose lower-cased name occurs in the text."""
    return F.filter(skills, lambda s: F.contains(text_lc, F.lower(s)))


def cap_matched_skills(skills, text_lc, limit=3):
    return F.slice(contained_skills(skills, text_lc), 1, limit)


def common_words(text_a, text_b, longer_than=3):
    """Distinct words of both texts with more than ``longer_than`` characters."""
    return F.array_intersect(long_words(text_a, longer_than), long_words(text_b, longer_than))


def long_words(text, longer_than=3):
    return F.array_distinct(all_matches(F.lower(text), r"\S{%d,}" % (longer_than + 1)))
