import os
import random

import pytest

import corpus_pipeline as p
from tests.llm import test_decontaminate, test_jaccard_join, test_radix_dedup
from vitaloom.llm import toxicity, transducer

SLURS = ["vorbak", "krunt", "blemp"]


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioudnrstlm") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    items = [(i, say(30)) for i in range(12)]
    passage = say(120)
    docs, labels = [], []
    for i in range(260):
        text, toxic = say(rng.randint(10, 120)), i % 6 == 0
        if toxic:
            parts = text.split()
            for slur in SLURS:
                parts.insert(rng.randrange(len(parts)), slur)
            text = " ".join(parts)
        if i % 11 == 1:
            text += " " + items[i % 12][1] + " " + say(10)
        if i % 13 == 2:
            text += " " + passage + " " + say(20)
        docs.append((i, text))
        if i % 7 == 3:
            docs.append((1000 + i, text.replace(" ", "  ", 1)))
        if rng.random() < 0.7:
            labels.append((i, 1, int(toxic)))
    docs += [(2000, None), (2001, ""), (2002, "é😀 " * 300), (2003, "é😀 " * 300 + "x"), (2004, "short"), (2004, "short"), (None, "a null key"), (None, None)]
    return docs, labels, items


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    docs, labels, items = corpus()
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, t, None if k == 2001 else "en", "s", len(t or ""), "extra") for k, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


@pytest.mark.skipif(not os.path.exists(transducer.MODEL), reason="no vocabulary files here")
def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = rows(docs)
    stages = dict(p.STAGES)

    clean = stages["toxicity"](spark, docs, sf_dir)
    want = [(k, t) for k, t in given if not toxicity.words(t) & set(SLURS)]
    assert rows(clean) == want and clean.columns == p.COLUMNS

    one = stages["jaccard_join"](spark, clean, sf_dir)
    groups = test_jaccard_join.brute(want, p.NEAR)
    kept = sorted({(k, t) for (k, t), (_, _, c) in zip(want, groups, strict=True) if k == c}, key=str)
    assert rows(one) == kept and len(kept) < len(want)

    cut = stages["suffix_dedup"](spark, one, sf_dir)
    sizes = {k: r for (k, t), r in zip(kept, test_radix_dedup.brute([t for _, t in kept], p.REPEATED), strict=True) if k is not None}
    for r in cut.collect():
        if r["doc_id"] in sizes:
            n, gone, _, _ = sizes[r["doc_id"]]
            assert n - gone - 6 <= len((r["text"] or "").encode()) <= n - gone and r["n_chars"] == len(r["text"])
    assert cut.count() == len(kept) and any(s[1] for s in sizes.values())

    left = rows(cut)
    free = stages["decontamination"](spark, cut, sf_dir)
    found = {k for k, *_ in test_decontaminate.brute([x for x in left if len(x[1]) < 20_000], [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])}
    assert rows(free) == [x for x in left if x[0] not in found] and found

    coded = stages["sentencepiece"](spark, free, sf_dir)
    machine = transducer.Transducer(transducer.load())
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in coded.collect()) == sorted((str(k), machine.encode(t)) for k, t in rows(free))

    whole = p.run(spark, sf_dir)
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in whole.collect()) == sorted((str(r["doc_id"]), list(r["ids"])) for r in coded.collect())
    assert all(r["restored"] for r in whole.collect())


def test_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_workers_get_small_batches(spark, sf_dir):
    given = spark.conf.get(p.BATCH)
    try:
        for rows_before, rows_then in (("10000", p.BATCH_ROWS), ("0", p.BATCH_ROWS), ("100", 100)):
            spark.conf.set(p.BATCH, rows_before)
            dict(p.STAGES)["decontamination"](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
            assert int(spark.conf.get(p.BATCH)) == rows_then
    finally:
        spark.conf.set(p.BATCH, given)
