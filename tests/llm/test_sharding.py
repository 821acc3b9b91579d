from collections import Counter

import pytest

from vitaloom.llm import sharding


def by_turns(shards, slots):
    """The rule itself: whole preference lists, and turns."""
    prefs = []
    for s in shards:
        offset, skip = sharding.text_hash(f"offset:{s}") % slots, sharding.text_hash(f"skip:{s}") % (slots - 1) + 1
        prefs.append([(offset + j * skip) % slots for j in range(slots)])
    table, turn = {}, 0
    while len(table) < slots:
        name, pref = shards[turn % len(shards)], prefs[turn % len(shards)]
        table[next(p for p in pref if p not in table)] = name
        turn += 1
    return [table[i] for i in range(slots)]


@pytest.mark.parametrize("n,slots", [(1, 2), (3, 7), (5, 101), (16, 211)])
def test_table_follows_the_turns(n, slots):
    shards = [f"s{i}" for i in range(n)]
    assert sharding.lookup_table(shards, slots) == by_turns(shards, slots)


def test_even_and_stable():
    shards = [f"s{i}" for i in range(20)]
    before = sharding.lookup_table(shards, 4001)
    sizes = Counter(before).values()
    assert max(sizes) - min(sizes) <= 1
    after = sharding.lookup_table(shards[:7] + shards[8:], 4001)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != "s7")
    assert moved < 0.1 * 4001


@pytest.mark.parametrize("shards,slots", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_refuses(shards, slots):
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, slots)


def test_place(spark):
    rows = [(1, "x", "old"), (1, "x", "old"), (None, "y", None), (7, "z" * 100_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, SHARD string")
    out = sharding.place(df, "doc_id", ["a", "b"], 11)
    assert sorted(out.columns) == ["doc_id", "shard", "slot", "text"]
    got = out.collect()
    assert len(got) == 4
    table = sharding.lookup_table(["a", "b"], 11)
    for r in got:
        assert r["slot"] == sharding.text_hash("" if r["doc_id"] is None else str(r["doc_id"])) % 11
        assert r["shard"] == table[r["slot"]]
    assert sharding.place(df.where("false"), "doc_id", ["a"], 11).count() == 0
