import math
import random

import numpy as np
import pytest

from vitaloom.llm import block_search

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=20, every=20, scale=64):
    whole = []
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(x * scale) for x in v):
            whole.append((key, [math.floor(x * scale) for x in v]))
    out = []
    for i, (key, q) in enumerate(whole):
        if key % every == 0:
            scores = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), other) for j, (other, v) in enumerate(whole) if j != i)
            out += [(key, rank, other, -s) for rank, (s, other) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(tuple(r) for r in block_search.search(df, **options).collect())


SMALL = {"block_rows": 7, "group_blocks": 3, "chunk_rows": 5}


def vectors(seed, n, dims=8, centres=0):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 3) for _ in range(dims)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, 0.2 if centres else 1) for x in (rng.choice(middle) if centres else [0] * dims)]) for i in range(n)]


@pytest.mark.parametrize("centres", [0, 5])
def test_equals_brute_force(spark, centres):
    rows = vectors(centres + 1, 300, centres=centres)
    assert run(spark, rows, **SMALL) == brute(rows)
    assert run(spark, rows, k=3, every=7, scale=10) == brute(rows, 3, 7, 10)


def test_a_third_of_all_rows_is_one_vector_and_ties_take_smaller_ids(spark):
    rows = vectors(3, 160, dims=3)
    rows = [(i, [0.5, 0.25, -0.5]) if i % 3 == 0 else r for i, r in enumerate(rows)]
    assert run(spark, rows, k=5, **SMALL) == brute(rows, 5)


def test_repeated_rows_and_ids_are_candidates(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(0, [0.0, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (7, [-1.0, 2.0])]
    assert run(spark, rows, **SMALL) == brute(rows) and len(brute(rows)) == 6 * 6


def test_fewer_rows_than_asked_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == [] and run(spark, [(1, [1.0]), (2, [1.0])]) == []
    rows = vectors(5, 9)
    assert run(spark, rows) == brute(rows)


def test_nulls_and_non_finite_components_take_no_part(spark):
    rows = vectors(6, 45, dims=2) + [(60, None), (None, [1.0, 1.0]), (80, [None, 1.0]), (81, [float("nan"), 1.0]), (82, [float("inf"), 1.0]), (83, [1e308, 0.0])]
    assert run(spark, rows, **SMALL) == brute(rows)


def test_lengths_differ_and_empty_vectors_score_nothing(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([0, 1, 4, 6]))]) for i in range(90)]
    assert run(spark, rows, k=4, **SMALL) == brute(rows, 4)


def test_large_numbers_stay_exact(spark):
    rng = random.Random(8)
    for size in (1e4, 1e9, 1e30):
        rows = [(i, [rng.uniform(-size, size), rng.uniform(-1, 1), rng.uniform(-size, size)]) for i in range(50)]
        assert run(spark, rows, k=4, **SMALL) == brute(rows, 4)


def test_long_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20_000)]) for i in range(24)]
    assert run(spark, rows) == brute(rows)


def test_extra_columns(spark):
    rows = vectors(10, 60, dims=3)
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], SCHEMA + ", id int, rank string, score double")
    assert sorted(tuple(r) for r in block_search.search(df, **SMALL).collect()) == brute(rows)


def test_blocks_below_the_kth_score_are_not_scored():
    import numpy as np

    rng = np.random.default_rng(1)
    m = [np.floor(64 * (c + rng.normal(0, 0.01, (50, 4)))) for c in np.eye(4)]
    blocks = [{"ids": np.arange(i * 50, i * 50 + 50).tobytes(), "w": block_search.pack(x), "hi": block_search.pack(x.max(axis=0)), "lo": block_search.pack(x.min(axis=0))}
              for i, x in enumerate(m)]
    blocks[3]["w"] = b"not read"
    tops = block_search.Tops(1, 10)
    block_search.visit(m[0][:1], np.array([0]), tops, 4, blocks)
    assert sorted(tops.id.tolist()) == sorted(np.lexsort((np.arange(50), -(m[0] @ m[0][0])))[:10].tolist())


def test_a_later_visit_that_finds_nothing_has_no_rows():
    """The floor of the first visit may lie above everything the next group holds."""
    ids, q = np.array([0, 20], np.int64), np.ones((2, 2))
    block = {"ids": np.array([5, 6], np.int64).tobytes(), **{x: block_search.pack(np.ones((2, 2))) for x in ("w", "hi", "lo")}}
    row = {"chunk": 1, "gid": 2, "ids": ids.tobytes(), "w": block_search.pack(q), "dims": 2, "gdims": 2, "blocks": [block],
           "go": np.array([0, 1], np.int64).tobytes(), "kth": np.array([9, 9], np.int64).tobytes(), "kth_id": np.array([1, 1], np.int64).tobytes()}
    assert list(block_search.visited(3)(row)) == []
    low = row | {"kth": np.array([9, 1], np.int64).tobytes()}
    assert list(block_search.visited(3)(low)) == [(1, 1, 20, 2, 2, [2, 2], [5, 6])]
