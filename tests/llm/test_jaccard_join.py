import random

import numpy as np
import pytest

from vitaloom.llm import jaccard_join as j
from vitaloom.llm.common import WordIds
from vitaloom.llm.components import connected


def brute(rows, rule):
    """Rows (key, text); components over keys."""
    sets = []
    for k, t in rows:
        ws = (t or "").encode().lower().split()
        n = min(rule.words, len(ws))
        sets.append((k, {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if ws else set()))
    keys = sorted({-1 if k is None else k for k, _ in sets})
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (a, s) in enumerate(sets):
        for b, t in sets[:x]:
            if s and t and rule.linked(len(s & t), len(s | t)):
                p, q = sorted((root(-1 if a is None else a), root(-1 if b is None else b)))
                up[q] = p
    real = lambda k: None if k == -1 else k
    return [(k, len(s), real(root(-1 if k is None else k))) for k, s in sets]


def run(spark, rows, rule):
    df = spark.createDataFrame([(k, t, 5, "x") for k, t in rows], "doc_id long, text string, n int, K string").repartition(3)
    return [tuple(r) for r in j.near_duplicates(df, rule=rule).collect()]


def order(r):
    return tuple(-1 if x is None else x for x in r)


def families(seed, n, vocabulary=3000):
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    rows = []
    for f in range(n):
        base = say(rng.randint(1, 90))
        for _ in range(rng.choice([1, 1, 2, 3, 40 if f % 9 == 0 else 4])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                i = rng.randrange(len(t) + 1)
                t[i:i + rng.randint(0, 1)] = say(rng.randint(0, 1))
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in t))
    keys = list(range(len(rows)))
    rng.shuffle(keys)
    return list(zip(keys, rows, strict=True))


@pytest.mark.parametrize("seed,rule", [(1, j.Rule(3, 90, 100)), (2, j.Rule()), (3, j.Rule(1, 60, 100)), (4, j.Rule(2, 100, 100))])
def test_against_brute_force(spark, seed, rule):
    rows = families(seed, 40)
    assert sorted(run(spark, rows, rule), key=order) == sorted(brute(rows, rule), key=order)


def test_long_lists_and_blocks(spark, monkeypatch):
    """Long lists of several components: everything goes through heads and tiles."""
    monkeypatch.setattr(j, "SHORT_LIST", 2)
    monkeypatch.setattr(j, "BLOCK", 5)
    rows = families(7, 25, 40)
    for rule in (j.Rule(3, 90, 100), j.Rule(1, 70, 100)):
        assert sorted(run(spark, rows, rule), key=order) == sorted(brute(rows, rule), key=order)


def brute_links(rows, rule):
    sets = []
    for _, t in rows:
        ws = (t or "").encode().lower().split()
        n = min(rule.words, len(ws))
        sets.append({tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if ws else set())
    return [(k, sum(i != o and bool(s and t) and rule.linked(len(s & t), len(s | t)) for o, t in enumerate(sets)))
            for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def run_links(spark, rows, rule):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return [(r["doc_id"], r["n_links"]) for r in j.near_duplicates(df, rule=rule, links=True).collect()]


@pytest.mark.parametrize("block", [512, 7])
def test_numbers_of_links(spark, monkeypatch, block):
    """A family of one-word variants, most of which are linked with each other and not only with a list's head."""
    monkeypatch.setattr(j, "LINK_BLOCK", block)
    monkeypatch.setattr(j, "WIDTH", 16)
    base = [f"b{i}" for i in range(60)]
    family = [" ".join([*base[:i], f"x{i % 5}", *base[i + 1:]]) for i in range(60)] + [" ".join(base)] * 3
    rows = families(5, 25) + [(10_000 + i, t) for i, t in enumerate(family)]
    rows += [(20, "q r s t u v"), (20, "x y z u v w"), (20, "x y z u v w"), (21, "q r s t u v"), (None, "q r s t u v"), (22, None), (23, "")]
    for rule in (j.Rule(3, 90, 100), j.Rule(2, 94, 100)):
        assert sorted(run_links(spark, rows, rule), key=order) == sorted(brute_links(rows, rule), key=order)
    assert run_links(spark, [], j.Rule()) == []


def test_edges(spark):
    long = " ".join(f"a{i}" for i in range(30_000))
    rows = [(4, None), (5, ""), (6, " \n"), (7, "one"), (8, "One"), (9, "one two"), (10, "ONE\ttwo\n"), (11, "one two three"), (11, "one two three"), (12, "É a b"), (13, "é a b"),
            (None, "null key text here"), (3, "null key text here"), (None, "another text of a null key"), (15, long), (14, long + " tail"), (20, "x y z u v w"), (20, "q r s t u v"),
            (21, "q r s t u v"), (19, "x y z u v w")]
    rule = j.Rule(3, 90, 100)
    assert sorted(run(spark, rows, rule), key=order) == sorted(brute(rows, rule), key=order)
    assert run(spark, [], rule) == []


def test_signature_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(0, 200)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 62, rng.integers(0, 60)).astype(np.uint64)]))
        assert j.differing(j.signature(a).tobytes(), j.signature(b).tobytes()) <= len(np.setxor1d(a, b))


def test_shingles_are_sets_of_words():
    ids = WordIds()
    assert len(j.shingles("a b c a b c", ids, 3)) == 3
    assert j.shingles("a b", ids, 3).tolist() == j.shingles("A  b", ids, 3).tolist() and len(j.shingles("a b", ids, 3)) == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(5001, 5100)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    lone = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in up if x not in lone}
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0
