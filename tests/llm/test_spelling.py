import random
import re
import zlib
from collections import Counter

import pytest

from vitaloom.llm import spelling

SCHEMA = "doc_id long, text string"


def edited(a, b):
    """Exactly one inserted, deleted or replaced letter, the plain way."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(rows, least=7, count=2, noise=31, ratio=10):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if noise and h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    n = {w: c for w, c in total.items() if len(w) >= least and c >= count}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and edited(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in spelling.variants(df, **options).collect())


def corpus(seed, docs, vocabulary=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aabcéÀ÷xyz") for _ in range(rng.randint(6, 10))) for _ in range(vocabulary)]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 12, 150])
        for _ in range(3):
            i = rng.randrange(len(w))
            words += [w[:i] + rng.choice("abé") + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice("xyz") + w[i + 1:], w[1:] + w[0]]
    return [(i, " ".join(rng.choice(words).title() if rng.random() < 0.2 else rng.choice(words) for _ in range(120))) for i in range(docs)]


@pytest.mark.parametrize("seed, parts", [(1, {}), (2, {"replaced": 6, "inserted": 5}), (3, {"replaced": 3, "inserted": 2})])
def test_equals_brute_force(spark, seed, parts):
    rows = corpus(seed, 80)
    got = run(spark, rows, **parts)
    assert got == brute(rows) and any(r[1] for r in got) and len(got) > 100


def test_short_words_and_other_limits(spark):
    rows = corpus(4, 25, vocabulary=15)
    for options in ({"least": 1, "count": 1, "noise": 0}, {"least": 3, "count": 2, "noise": 3, "ratio": 2}):
        assert run(spark, rows, **options) == brute(rows, **options)


def test_anagrams_and_swapped_letters_are_not_near(spark):
    rows = [(1, "listening listening silenting silenting listennig listennig")]
    assert all(r[4] == 0 for r in run(spark, rows, noise=0))


def test_chains_end_at_the_last_form(spark):
    # Each is one edit from the next and ten times rarer, the first three edits from the last.
    words = {"abcdefgh": 2, "abcdefgx": 20, "abcdefyx": 200, "abcdezyx": 2000}
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words.items())]
    assert {r[0]: r[2] for r in run(spark, rows, noise=0)} == dict.fromkeys(words, "abcdezyx")


def test_ties_take_the_first_in_code_point_order(spark):
    rows = [(1, "abcdefg " * 2 + "abcdefgé " * 20 + "abcdefgz " * 20)]
    assert run(spark, rows, noise=0)[0][:3] == ("abcdefg", "abcdefgz", "abcdefgz")


def test_nulls_empty_long_and_repeated_rows(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (None, None), (2, "")]) == []
    long = "q" * 70_000
    rows = [(None, "Wonderful wonderful"), (None, "Wonderful wonderful"), (3, f"{long} {long} {long}q {long}q"), (4, "wonderful 漢字漢字漢字漢字 wońderful")] * 2
    assert run(spark, rows) == brute(rows)


def test_extra_columns_and_few_held_words(spark):
    rows = corpus(5, 20)
    df = spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA + ", word string, n int, k int")
    assert sorted(tuple(r) for r in spelling.variants(df).collect()) == brute(rows)
    out = [r for b in spelling.counted(7, 31, held=3)(spark.createDataFrame(rows, SCHEMA).selectExpr("string(doc_id)", "text").toArrow().to_batches()) for r in b.to_pylist()]
    total = Counter()
    for r in out:
        total[r["word"]] += r["n"]
    assert {w for w, n in total.items() if n >= 2} == {r[0] for r in brute(rows)}
