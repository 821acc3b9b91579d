import hashlib
import random

import numpy as np
import pytest

from vitaloom.llm import recompression as r
from vitaloom.llm.common import WordIds


def brute(rows, window):
    """Rows (key, text) in any order, results in the same order."""
    lists = [(-(1 << 63) if k is None else k, (t or "").encode().split()) for k, t in rows]
    first = {}
    for k, ws in lists:
        for i in range(len(ws) - window + 1):
            w = tuple(ws[i:i + window])
            first[w] = min(first.get(w, (k, i)), (k, i))
    out = []
    for k, ws in lists:
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - window + 1):
            if (k, i) > first[tuple(ws[i:i + window])]:
                gone[i:i + window] = True
        out.append((len(ws), int(gone.sum()), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)).hexdigest()))
    return out


def cut(spark, rows, window=r.WINDOW):
    df = spark.createDataFrame([(n, k, t, "x", None) for n, (k, t) in enumerate(rows)], "n int, doc_id long, text string, KEPT string, k string").repartition(3)
    out = r.remove_repeats(df, window=window)
    assert out.columns == ["n", "doc_id", "text", "k", "kept", "n_words", "n_removed", "removed"]
    got = out.orderBy("n").collect()
    for x in got:
        assert sum(s["stop"] - s["start"] for s in x["removed"]) == x["n_removed"]
    return [(x["n_words"], x["n_removed"], hashlib.sha256(x["kept"].encode()).hexdigest()) for x in got]


def corpus(seed, n, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    shared = [say(k) for k in (15, 19, 20, 21, 25, 60, 200)]
    rows = []
    for i in range(n):
        t = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 4)):
            s = list(rng.choice(shared))
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] = "edit"
            t += s + say(rng.randint(0, 15))
        rows.append((i, " ".join(t)))
        if i % 6 == 0:
            rows.append((1000 - i, " ".join(t)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,window,vocabulary", [(1, 20, 500), (2, 20, 2), (3, 5, 3), (4, 2, 4), (5, 40, 100)])
def test_against_brute_force(spark, seed, window, vocabulary):
    rows = corpus(seed, 50, vocabulary)
    assert cut(spark, rows, window) == brute(rows, window)


def test_edges(spark):
    same = " ".join(f"x{i}" for i in range(45))
    rows = [(None, None), (3, ""), (4, " \n\t "), (5, "a " * 19), (6, "a " * 20), (7, "a " * 70), (8, "b " + "a " * 33 + "c"), (9, "a " * 10 + "b " * 10),
            (2, "a " * 12 + "b " * 30), (10, "Les Rech.\n" * 40), (1, "Les Rech. " * 25), (11, same), (11, same), (12, same), (None, same), (-4, same + " tail"),
            (13, "é ß " * 30), (14, "é ß " * 30), (15, "A " * 25)]
    assert cut(spark, rows) == brute(rows, 20)


def test_blocks(spark, monkeypatch):
    rng = random.Random(6)
    text = " ".join(rng.choice(["p", "q", "r", "s"]) for _ in range(3000))
    rows = [(1, text), (2, text[1001:4000]), (3, "z " * 50 + text[:900])]
    want = brute(rows, 20)
    assert cut(spark, rows) == want
    ids = WordIds()
    for block, long in ((64, 1 << 22), (64, 1), (1 << 17, 1)):
        monkeypatch.setattr(r, "BLOCK", block)
        monkeypatch.setattr(r, "LONG_TEXT", long)
        for t in (text, "one two", "", " ".join("abcdefghijklmnopqrst")):
            words = t.encode().split()
            seen = [(start + f, c) for start, ws in r.word_blocks(t.encode(), ids, 20) if len(ws) >= 20 for _, f, c in r.anchors_of(ws, 20)]
            assert sorted(x for f, c in seen for x in range(f, f + c)) == list(range(max(len(words) - 19, 0)))


def test_equal_substrings_have_equal_symbols_inside():
    rng = np.random.default_rng(3)
    core = rng.integers(0, 6, 200).astype(np.uint64)
    found = []
    for _ in range(5):
        before, after = rng.integers(0, 6, 30).astype(np.uint64), rng.integers(0, 6, 30).astype(np.uint64)
        p = r.Parse(np.concatenate([before, core, after]))
        inside = (p.left >= 30) & (p.right <= 230)
        found.append(set(zip(p.names[inside].tolist(), (p.start[inside] - 30).tolist(), (p.stop[inside] - 30).tolist(), strict=True)))
    assert all(f == found[0] for f in found) and len(found[0]) > 60


def test_empty_table_and_refusals(spark):
    assert cut(spark, []) == []
    with pytest.raises(ValueError):
        r.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), window=1)
