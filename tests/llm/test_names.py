"""Tables whose columns have the names of an operator's helper columns."""

import pytest
from pyspark.sql import functions as F

from vitaloom.llm import decontaminate, radix_dedup, recompression, warc
from vitaloom.llm.common import spare

HELPERS = ["_t", "_k", "_check", "_text", "_packed", "_spans", "_cut", "_id", "h", "n", "t", "first", "last", "body", "digest", "a b", "Removed"]


def test_spare(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, A_ int, b int")
    assert spare(df, "a", "c", "A", "c") == ["a__", "c", "A___", "c_"]


@pytest.mark.parametrize(("operator", "options"), [(radix_dedup, {"threshold": 200}), (recompression, {"window": 5})])
def test_extra_columns_stay(spark, operator, options):
    passage = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, passage + " one"), (2, passage + " two"), (3, None), (4, "")], "doc_id long, text string")
    wide = docs.select("*", *[F.lit(c).alias(c) for c in HELPERS])
    got = {r["doc_id"]: r for r in operator.remove_repeats(wide, **options).collect()}
    plain = {r["doc_id"]: r for r in operator.remove_repeats(docs, **options).collect()}
    assert got.keys() == plain.keys() == {1, 2, 3, 4} and plain[2]["n_removed"] > 0
    for key, row in got.items():
        assert [row[c] for c in HELPERS[:-1]] == HELPERS[:-1]
        assert all(row[c] == plain[key][c] for c in ("kept", "n_removed", "removed"))


def test_key_with_a_blank(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e g")], "`the key` long, `the text` string")
    got = recompression.remove_repeats(docs, key="the key", text="the text", window=5)
    assert sorted((r["the key"], r["n_removed"]) for r in got.collect()) == [(1, 0), (2, 5)]


def test_archive_keys_of_any_name(spark):
    rows = [("1", "u1", "x" * 200), ("2", "u2", "x" * 200), ("3", None, None)]
    for key, url in (("body", "digest"), ("block", "revisit_key")):
        got = warc.archive_round_trip(spark.createDataFrame(rows, f"{key} string, {url} string, html string"), key=key, url=url)
        assert sorted((r["source_key"], r["record_type"], r["refers_to"]) for r in got.collect()) == [
            ("1", "response", None), ("2", "revisit", "1"), ("3", "response", None)]


def test_benchmark_finds_with_a_key_of_any_name(spark):
    item = "a passage of the benchmark that is long enough to be edited"
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    for key, columns in (("item_id", ["item_id", "item_id_", "edits", "allowed"]), ("Edits", ["Edits", "item_id", "edits_", "allowed"])):
        got = decontaminate.find(spark.createDataFrame([(1, f"so {item} it is"), (2, None)], f"{key} long, text string"), items, key=key)
        assert got.columns == columns
        assert [(r[0], r[1]) for r in got.collect()] == [(1, 7)]
