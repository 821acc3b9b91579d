import hashlib
import random

import pytest

from vitaloom.llm import merkle


def text(rng, n):
    words = ["".join(rng.choice("aeioudnrstlm") for _ in range(rng.randint(1, 8))) for _ in range(n)]
    return "".join(w + rng.choice([" ", " ", " ", " ", ". ", "\n", "\n\n"]) for w in words)


def test_tree_equality_and_edits():
    rng = random.Random(3)
    for _ in range(50):
        a = text(rng, rng.randint(50, 400))
        i = rng.randrange(len(a))
        b = a[:i] + "#" + a[i + 1:]
        fa, fb = merkle.fingerprint(a), merkle.fingerprint(b)
        assert fa == merkle.fingerprint(a) and (a == b) == (fa == fb)
        if a != b:
            spans = merkle.differences(fa, fb)
            assert any(s <= i < e for s, e in spans) and sum(e - s for s, e in spans) < 2 * merkle.MAX_LEAF
            assert 0.3 < merkle.likeness(fa, fb) < 1
        assert sum(x.size for x in merkle.leaves(fa)) == len(a.encode())


def test_insertion_keeps_the_rest():
    rng = random.Random(4)
    a = text(rng, 3000)
    fa, fb = merkle.fingerprint(a), merkle.fingerprint("something new\n" + a)
    assert merkle.likeness(fa, fb) > 0.97
    assert merkle.likeness(fa, merkle.fingerprint(text(rng, 3000))) < 0.1
    assert merkle.differences(fa, fa) == []


def test_edges():
    assert merkle.fingerprint(None) == merkle.fingerprint("")
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("")) == 1
    assert merkle.likeness(merkle.fingerprint(""), merkle.fingerprint("a")) == 0
    long = "ab" * (3 * merkle.BLOCK)
    assert merkle.cuts(long.encode())[-1] == len(long) and len(merkle.leaves(merkle.fingerprint("x" * 10_000))) == 3


def test_cuts_do_not_see_blocks(monkeypatch):
    data = text(random.Random(5), 5000).encode()
    want = merkle.cuts(data)
    monkeypatch.setattr(merkle, "BLOCK", 97)
    assert merkle.cuts(data) == want


def by_hand(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for i, (key, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[:len(t) - len(t) // 4] + nxt[:len(t) // 4]
        a, e, b = merkle.fingerprint(t), merkle.fingerprint(edited), merkle.fingerprint(nxt)
        yield key, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, e, merkle.likeness(a, e), merkle.likeness(a, b)


def rows_of(n, rng):
    return [(rng.randrange(10 * n), text(rng, rng.choice([0, 1, 3, 30, 200])) + rng.choice(["", "é😀"])) for _ in range(n)]


@pytest.mark.parametrize("rows", [
    [(1, "only one")], [(1, None), (2, ""), (3, "abcd")], [(None, "x" * 9), (None, "y" * 9), (4, "abcdefgh")], [(7, "same"), (7, "same"), (7, "other")],
    [(-5, "neg ative"), (5, "z" * 100_000)], [], rows_of(300, random.Random(8)), rows_of(50, random.Random(9)) + [(None, "null key"), (3, None), (3, None)]])
def test_with_edits(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, B string, n_chars int").repartition(3)
    got = [tuple(r) for r in merkle.with_edits(df).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(by_hand(rows), key=order)


def test_add_fingerprint(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "t", "b")], "doc_id long, text string, FINGERPRINT string")
    out = merkle.add_fingerprint(df)
    assert out.columns == ["doc_id", "text", "fingerprint"]
    assert [r["fingerprint"] for r in out.orderBy("doc_id").collect()] == [merkle.fingerprint(""), merkle.fingerprint("t")]
