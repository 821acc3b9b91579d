import os
import random
import struct

import pytest
import sentencepiece

from vitaloom.llm import transducer

pytestmark = pytest.mark.skipif(not os.path.exists(transducer.MODEL), reason="no vocabulary files here")
EDGES = ["", "a", " ", "  ", "   x", "Hello  world\n a\té \U0001F600 ", "▁x y▁", "x" * 1000, "aaaaaaaabbbbbababab", " lead", "trail ", "日本語 テキスト", "\x00\x01\x7f",
         "é ‍", "don't   stop!!! ###"]


@pytest.fixture(scope="module")
def machine():
    return transducer.Transducer(transducer.load())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=transducer.MODEL)


def texts():
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz      ABCDEF.,!?0123456789éüñ日本\n\t😀"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return EDGES + made + ["".join(rng.choice(["er", "st", "in", "on", "th", " "]) for _ in range(rng.randint(0, 60))) for _ in range(1000)]


def test_same_as_the_library(machine, library):
    for t in texts():
        assert machine.encode(t) == library.encode(t), t
        assert machine.decode(machine.encode(t)) == library.decode(library.encode(t)), t


def test_neighbours_by_merging(machine):
    """The acceptor agrees with merging both texts together."""
    def merge(text):
        parts = list(text)
        while True:
            found = [(-machine.scores[machine.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in machine.ids]
            if not found:
                return parts
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(2)
    pieces = sorted(machine.splits)
    for _ in range(3000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert machine.legal(a, b) == (merge(a + b) == [a, b]), (a, b)


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2, len(value)]) + value


def unigram(pieces):
    data = b""
    for text, score, kind in pieces:
        data += field(1, field(1, text.encode()) + field(2, score) + field(3, kind))
    return data + field(2, field(3, 1)) + field(3, field(3, 1) + field(4, 0))


def test_unigram_by_all_paths():
    rng = random.Random(4)
    lexicon = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.2, "ba": -5.1, "aba": -7.0, "▁ab": -5.5, "bb": -6.9}
    machine = transducer.Transducer(unigram([("<unk>", 0.0, 2)] + [(p, s, 1) for p, s in lexicon.items()]))

    def best(text):
        if not text:
            return 0.0, []
        paths = []
        for n in range(1, len(text) + 1):
            p = text[:n]
            weight = lexicon.get(p, machine.floor if n == 1 else None)
            if weight is not None:
                rest = best(text[n:])
                paths.append((rest[0] - weight, [p] + rest[1]))
        return min(paths)

    for _ in range(200):
        text = "▁" + "".join(rng.choice("aabbz") for _ in range(rng.randint(0, 9)))
        got = machine.shortest(text)
        assert "".join(got) == text
        assert sum(-lexicon.get(p, machine.floor) for p in got) == pytest.approx(best(text)[0])


def test_refuses_other_normalisers():
    with pytest.raises(ValueError):
        transducer.Transducer(unigram([("a", 0.0, 1)]) + field(3, field(2, b"rules") + field(4, 0)))


def test_frames(spark, library):
    rows = [(1, None, 5), (2, "", 6), (3, "one two  three\n" * 20_000, 7), (4, "x ▁ y", 8), (4, "x ▁ y", 8), (None, "é", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS int")
    model = transducer.load()
    got = sorted(transducer.round_trip(df, model).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [(r["doc_id"], list(r["ids"]), r["n_tokens"], r["restored"]) for r in got] == [
        (k, library.encode(t or ""), len(library.encode(t or "")), "▁" not in (t or "")) for k, t, _ in rows]
    coded = transducer.encode(df, model)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = transducer.decode(coded.withColumnRenamed("text", "was"), model).collect()
    assert all(r["text"] == (r["was"] or "").replace("▁", " ") for r in back)
    assert transducer.round_trip(df.where("false"), model).count() == 0
