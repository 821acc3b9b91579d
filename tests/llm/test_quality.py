import random

import pytest
from pyspark.sql import functions as F

from vitaloom.llm import labelled, quality


def made(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        good = i % 3 != 0
        text = " ".join(rng.choice(words) for _ in range(rng.randint(40, 200)))
        rows.append((i, text if good else text.upper().replace(" ", "!! "), int(good)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = made(600, 1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 2] + [(None, 1), (5000, None), (7, None)], "doc_id long, quality int")
    return docs, rows, quality.fit(docs, labels)


def test_held_out(trained):
    docs, rows, model = trained
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    assert sum((got[i] >= 0.3) == bool(y) for i, _, y in held) / len(held) > 0.95
    assert all(0 <= v <= 1 for v in got.values())


def test_bounded_sample_is_not_a_prefix_of_the_alphabet(spark, monkeypatch):
    assert quality.bounded([b"aaa", b"b" * 10, b"cc"], 6) == [b"aaa", b"cc"]
    seen = []
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 4000)
    monkeypatch.setattr(quality, "dictionary", lambda texts: seen.extend(t[:1] for t in texts) or b"x" * 64)
    rows = [(i, chr(97 + i % 26) * 100, i // 26 % 2) for i in range(520)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert len(seen) == 40 and max(seen) > b"t"


def test_edge_rows(spark, trained):
    _, rows, model = trained
    long = rows[1][1] * 2000
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, long, None), (4, rows[1][1], ""), (4, rows[1][1], ""), (None, "x", "")],
                               "doc_id long, text string, Score string")
    out = quality.score(df, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = out.select("doc_id", "score", labelled.decide(F.col("score")).alias("p")).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    empty = [r["score"] for r in got if r["doc_id"] in (1, 2)]
    assert empty == [model.prior] * 2
    same = [r["score"] for r in got if r["doc_id"] == 4]
    assert same[0] == same[1]
    assert quality.score(df.where("false"), model).count() == 0


@pytest.mark.parametrize("labels", [[], [(1, 1), (3, 1)], [(0, 0)]])
def test_too_few_labels(spark, trained, labels):
    docs, _, _ = trained
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {round(r["score"], 6) for r in quality.score(docs, model).collect()}
    ones = sum(y for _, y in labels)
    assert got == {round((ones + 1) / (len(labels) + 2), 6)}


def test_parts_of_a_long_text_count(trained):
    _, rows, model = trained
    measure = quality.Measure(model.good, model.bad)
    good, bad = rows[1][1].encode() * 40, rows[0][1].encode() * 40
    assert measure(good + good)[0] > measure(good + bad)[0]


def test_scores_by_hand(spark, trained):
    """Sizes block by block with the library's own call, and the logistic as a plain sum."""
    import math

    import zstandard

    docs, rows, model = trained
    long = [(9000, " ".join(r[1] for r in rows[:200])), (9001, "x"), (9002, "é漢 " * 40_000), (9003, None), (9004, "")]
    some = [r[:2] for r in rows[:40]] + long
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    for key, text in some:
        if not text:
            assert got[key] == pytest.approx(model.prior)
            continue
        data, sizes = text.encode(), []
        for d in (model.good, model.bad):
            total = 0
            for at in range(0, len(data), quality.BLOCK):
                c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
                total += len(c.compress(data[at:at + quality.BLOCK]))
            sizes.append(total)
        weight, share = min(1.0, len(data) / quality.SHORT), min(sizes) / len(data)
        x = (weight * (sizes[1] - sizes[0]) / max(sizes), weight * share, weight * share * share)
        margin = model.bias + sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weights, strict=True))
        assert got[key] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))), abs=1e-9)


def test_logistic_against_another_solver():
    import numpy as np

    rng = np.random.default_rng(5)
    x, weight = rng.normal(size=(300, 3)), rng.uniform(0.5, 2, 300)
    y = (x @ [1.5, -2.0, 0.0] + 0.4 + rng.normal(size=300) > 0).astype(float)
    w, bias = labelled.logistic(x, y, weight, ridge=1e-2)
    # Plain gradient descent on the same loss.
    v, b, ridge = np.zeros(3), 0.0, 1e-2 * weight.sum()
    for _ in range(40_000):
        p = 1 / (1 + np.exp(-(x @ v + b)))
        v, b = v - 2e-3 * (x.T @ (weight * (p - y)) + ridge * v), b - 2e-3 * (weight * (p - y)).sum()
    assert np.allclose(w, v, atol=1e-5) and bias == pytest.approx(b, abs=1e-5)
