import random

import numpy as np
import pytest

from vitaloom.llm import toxicity

SLURS = ["vorbak", "krunt", "blemp", "zog", "quarl"]


def made(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeiodnrstlm") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(n):
        text = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(2, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(SLURS))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = made(900, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3] + [(None, 1), (6000, None)], "doc_id long, toxic int")
    return docs, rows, toxicity.fit(docs, labels)


def test_held_out(trained):
    docs, rows, model = trained
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, _, y in held]) > 0.97
    assert all(0 <= v <= 1 for v in got.values())


def test_edge_rows(spark, trained):
    _, rows, model = trained
    bad = rows[5][1]
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x " * 300_000 + bad, None), (4, bad, ""), (4, bad, ""), (None, "x", "")],
                               "doc_id long, text string, SCORE string")
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "score"]
    got = out.collect()
    assert len(got) == 6
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2] < 0.3 <= by[3]
    assert by[4] >= 0.3
    assert toxicity.score(df.where("false"), model).count() == 0


@pytest.mark.parametrize("labels,share", [([], 0.1), ([(1, 0), (2, 0)], 0.1 / 3), ([(0, 1)], 1.1 / 2)])
def test_too_few_labels(spark, trained, labels, share):
    docs, _, _ = trained
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {round(r["score"], 6) for r in toxicity.score(docs, model).collect()} == {round(share, 6)}


def test_label_model_finds_rates_and_company():
    """Ten independent voters and three copies of one of them, from known rates."""
    rng = np.random.default_rng(5)
    y = rng.random(60_000) < 0.2
    toxic, clean = rng.uniform(0.4, 0.8, 10), rng.uniform(0.02, 0.1, 10)
    f = rng.random((len(y), 10)) < np.where(y[:, None], toxic, clean)
    f = np.hstack([f, f[:, :1], f[:, :1]])
    both = f.T.astype(float) @ f
    model = toxicity.label_model(len(y), both, 0.2, np.full(12, 0.3))
    assert np.abs(model.toxic[1:10] - toxic[1:10]).max() < 0.2 and np.abs(model.clean[1:10] - clean[1:10]).max() < 0.05
    assert model.within[0, 10] > 0.05 > np.abs(model.within[1:10, 1:10] - np.diag(np.diag(model.within[1:10, 1:10]))).max()
    assert np.ptp(model.weights[[0, 10, 11]]) < 1e-6 and model.weights[[0, 10, 11]].sum() < 1.5 * model.weights[1:10].max()
    assert ((model.posterior(f) > 0.5) == y).mean() > 0.96


def test_scores_by_hand(spark, trained):
    """The model's weights summed over the distinct words, and the beginnings of long ones, that a plain scan finds."""
    import math

    docs, rows, model = trained
    some = [r[:2] for r in rows[:60]] + [(9000, " ".join(r[1] for r in rows[:150])), (9001, "VORBAK! vorbak, Vorbak_krunt"), (9002, None), (9003, "")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(some, "doc_id long, text string"), model).collect()}
    for key, text in some:
        found, word = set(), ""
        for c in (text or "").lower() + " ":
            if c.isalnum():
                word += c
            else:
                found |= {word, word[:toxicity.STEM] + "*"} if len(word) > toxicity.STEM else {word} if word else set()
                word = ""
        margin = model.bias + sum(model.weights.get(w, 0.0) for w in found)
        assert got[key] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))), abs=1e-9)
    assert got[9001] > 0.5 > got[9002] == got[9003]
