import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vitaloom.llm import radix_dedup as r


def brute(texts, threshold):
    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + threshold] for d in datas for i in range(len(d) - threshold + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - threshold + 1):
            if seen[d[i:i + threshold]] > 1:
                gone[i:i + threshold] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioudnrstlmé") for _ in range(rng.randint(1, 8))) for _ in range(150)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(k) for k in (20, 60, 80, 120, 300)]
    texts = []
    for i in range(n):
        t = say(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            if rng.random() < 0.5:
                k = rng.randrange(len(s))
                s = s[:k] + "#" + s[k + 1:]
            t += s + say(rng.randint(0, 30))
        texts.append(t)
        if i % 7 == 0:
            k = rng.randrange(len(t) + 1)
            texts += [t, t[:k] + "!" + t[k:]]
    return texts


def cut(spark, texts, threshold=r.THRESHOLD):
    df = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)], "doc_id long, text string, KEPT string, t string").repartition(3)
    out = r.remove_repeats(df, threshold=threshold)
    assert out.columns == ["doc_id", "text", "t", "kept", "kept_text", "n_bytes", "n_removed", "removed"]
    assert all(x["kept_text"] == bytes(x["kept"]).decode("utf-8", "ignore") for x in out.collect())
    return [(x["n_bytes"], x["n_removed"], len(x["removed"]), hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in out.orderBy("doc_id").collect()]


@pytest.mark.parametrize("seed,threshold", [(1, 400), (2, 150), (3, 129), (4, 240)])
def test_against_brute_force(spark, seed, threshold):
    texts = corpus(seed, 40)
    assert cut(spark, texts, threshold) == brute(texts, threshold)


def test_edges(spark):
    rng = random.Random(9)
    odd = "".join(rng.choice("abcdefgh ") for _ in range(1000))
    texts = [None, "", None, "x" * 399, "x" * 400, "y" * 401, "Les Rech.\n" * 90, odd, odd, odd, odd[300:700], odd[301:700], "é" * 200, "é" * 201, odd[:500] + odd[:450], "ab" * 300 + odd]
    assert cut(spark, texts) == brute(texts, 400)


def test_very_long_and_blocks(spark, monkeypatch):
    rng = random.Random(10)
    base = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    texts = [base, base[1000:2500] + "|" + base[5000:5399], base[10_000:10_400], "q" + base[20_000:29_000]]
    want = brute(texts, 400)
    assert cut(spark, texts) == want
    data = base.encode()
    whole = list(r.stretches(data, r.Hashes(r.BLOCK + 400, r.DIGIT), 400))
    monkeypatch.setattr(r, "BLOCK", 1000)
    split = list(r.stretches(data, r.Hashes(r.BLOCK + 400, r.DIGIT), 400))
    assert {w[:2] for w in whole} == {s[:2] for s in split} and sum(w[3] for w in whole) == sum(s[3] for s in split) == len(data) - 399


def test_empty_table_and_refusals(spark):
    assert cut(spark, []) == []
    df = spark.createDataFrame([], "text string")
    for bad in (100, 5000):
        with pytest.raises(ValueError):
            r.remove_repeats(df, threshold=bad)


def test_merged():
    assert r.merged([(5, 9), (0, 3), (3, 4), (8, 10), (6, 7)]) == [(0, 4), (5, 10)]
