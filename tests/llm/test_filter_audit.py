import random
import re
from collections import Counter
from itertools import permutations

import pytest

from vitaloom.llm import filter_audit

SCHEMA = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    fails = []
    for d, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
             "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and any(o is not None and o < d and (t or "") == text for o, t, _ in rows)}
        fails.append((source or "", d, {x for x in f if f[x]}))
    out = []
    for part in {p for p, _, _ in fails}:
        own = [(d, f) for p, d, f in fails if p == part]
        total, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                total[x] += len(gone)
                every = [f for _, f in own if x in f]
                steps.append(("".join(order), step, x, len(left), len(gone), len(every) - len(gone), sum(f == {x} for f in every),
                              sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(part, o, s, *rest, total[x]) for o, s, x, *rest in steps]
    return sorted(out)


def run(spark, rows, labels, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), **options).collect())


def corpus(seed, n):
    rng = random.Random(seed)
    start = "one common beginning of very many texts that is longer than any prefix which is compared, " * 2
    texts = []
    for _ in range(n // 2):
        words = [rng.choice(["alpha", "Beta", "gamma", "délta", "x", "Y", "漢"]) + str(rng.randrange(rng.choice([5, 2000]))) for _ in range(rng.choice([3, 49, 50, 90]))]
        texts.append(rng.choice(["", start]) + rng.choice([" ", "\n", " "]).join(words) + rng.choice(["", "", " #", "|"]))
    rows = [(rng.randrange(n), rng.choice(texts), rng.choice(["a", "b", None])) for _ in range(n)]
    labels = [(rng.randrange(n), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(n)]
    return rows, labels


@pytest.mark.parametrize("options", [{}, {"held": 1}, {"held": 3000, "range_bytes": 2000, "prefix": 3}])
def test_equals_brute_force(spark, options):
    rows, labels = corpus(1, 120)
    got = run(spark, rows, labels, **options)
    assert got == brute(rows, labels) and any(r[5] for r in got) and any(r[6] for r in got)


def test_a_third_of_all_rows_is_one_text(spark):
    rows, labels = corpus(2, 90)
    rows = [(i, "Copy copy # " * 30, "hot") if i % 3 == 0 else r for i, r in enumerate(rows)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_nulls_empty_and_repeated_rows(spark):
    rows = [(None, None, None), (None, "a", "x"), (1, None, "x"), (1, "", "x"), (1, "", "x"), (2, "a", None), (3, "a", ""), (3, "a", "x"), (3, "a", "x")]
    labels = [(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None), (3, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)
    assert run(spark, [], []) == [] and run(spark, rows, []) == brute(rows, [])


def test_long_texts_and_texts_that_begin_others(spark):
    long = "word " * 200_000
    rows = [(i, long + "x" * (i % 3), "p") for i in range(6)] + [(10 + i, "a" * (i % 40), "p") for i in range(80)]
    assert run(spark, rows, []) == brute(rows, [])


def test_extra_columns(spark):
    rows, labels = corpus(3, 30)
    docs = spark.createDataFrame([(*r, 1, "m", 2, 3, 4) for r in rows], SCHEMA + ", id int, mask string, n int, h int, size int")
    known = spark.createDataFrame([(*r, 1, "s") for r in labels], LABELS + ", good int, source string")
    assert sorted(tuple(r) for r in filter_audit.audit(docs, known).collect()) == brute(rows, labels)


def test_trie_holds_each_text_once():
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(500)]
    trie = filter_audit.Trie()
    for i, t in enumerate(texts):
        node = trie.insert(t)
        node.end = i if node.end is None else node.end
    assert {t: n.end for t, n in trie.ends()} == {t: texts.index(t) for t in texts}
