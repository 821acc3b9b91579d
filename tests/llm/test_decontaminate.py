import random

import pytest

from vitaloom.llm import decontaminate as d


def plain(item, text):
    """Edit distance of an item to the nearest part of a text, cell by cell."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(column[i] + (x != c), column[i + 1] + 1, new[i] + 1))
        column = new
        best = min(best, column[-1])
    return best


def test_distance():
    rng = random.Random(1)
    for _ in range(400):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 90)))
        assert d.distance(item, text) == plain(item, text)
    assert d.distance("", "abc") == 0


def test_pieces_cover():
    for n in range(1, 60):
        for k in range(min(n, 7)):
            got = d.pieces("x" * n, k)
            assert len(got) == k + 1 and "".join(p for _, p in got) == "x" * n and all(p for _, p in got)


def edited(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "q", text[i] + "z"]) + text[i + 1:]
    return text


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("aeioustrnlm") for _ in range(rng.randint(1, 7))) for _ in range(200)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.randint(3, 45))) for i in range(25)] + [(100, None), (101, ""), (102, "!!"), (103, "zq"), (104, "zq")]
    docs = []
    for i in range(120):
        text = say(rng.randint(0, 150))
        if i % 2:
            for _ in range(rng.randint(1, 2)):
                key, item = items[rng.randrange(25)]
                text = text + " " + edited(rng, item, rng.choice([0, 0, 1, 3, 8, 20])).upper() + "! " + say(20)
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, say(30_000) + " " + items[3][1]), (503, items[4][1]), (503, items[4][1]), (None, items[5][1]), (504, "a zq, b"), (505, "azq b")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, DOC_ID string")


def brute(docs, items):
    out = []
    for doc, text in docs:
        t = d.normal(text)
        for item, s in items:
            s = d.normal(s)
            if not s:
                continue
            if len(s) < d.SHORT_CHARS:
                if f" {s} " in f" {t} ":
                    out.append((doc, item, 0, 0))
                continue
            k = d.budget(s, d.ERROR_RATE)
            if s in t:
                out.append((doc, item, 0, k))
            elif len(t) < 20_000 and (n := plain(s, f" {t} ")) <= k:
                out.append((doc, item, n, k))
    return out


def test_against_brute_force(data):
    docs, items = data
    want = brute([tuple(r) for r in docs.collect()], [(r[0], r[1]) for r in items.collect()])
    got = [tuple(r) for r in d.find(docs, items).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert any(r[2] > 0 for r in got)


def test_blocks_change_nothing(data, monkeypatch):
    docs, items = data
    want = sorted(map(str, d.find(docs, items).collect()))
    kept = sorted(map(str, d.clean(docs, items).collect()))
    monkeypatch.setattr(d, "BLOCK_CHARS", 600)
    assert len(list(d.blocks(items, "item_id", "text"))) > 3
    assert sorted(map(str, d.find(docs, items).collect())) == want
    assert sorted(map(str, d.clean(docs, items).collect())) == kept


def test_clean(data):
    docs, items = data
    found = {r["doc_id"] for r in d.find(docs, items).collect()}
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in found)


def test_empty_tables(data):
    docs, items = data
    assert d.find(docs.where("false"), items).count() == 0
    assert d.find(docs, items.where("false")).count() == 0
    assert d.clean(docs, items.where("false")).count() == docs.count()
