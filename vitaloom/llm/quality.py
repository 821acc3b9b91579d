"""Quality of a text from how much better one Zstandard dictionary compresses it than another.

One dictionary is built from texts labelled good, one from texts labelled bad. A whole text is cut into blocks of a few
kilobytes and every block is compressed on its own with each dictionary, so a long text cannot teach itself and the
dictionaries matter to its end. The measures are the normalised difference of the two compressed sizes and the
compressed share of the text; a logistic curve fitted on labelled rows turns them into a probability.

Fitting uses a bounded sample of labelled rows (``labelled.SAMPLE_ROWS`` per class, chosen by hash, of which
``SAMPLE_CHARS`` bytes are used); only that sample reaches the driver. Scoring is one narrow pass over all whole texts, without a shuffle.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import without
from vitaloom.llm.labelled import logistic, sample

# Bound of what the dictionaries and the calibration take of each class of the sample.
SAMPLE_CHARS = 8_000_000
DICTIONARY_BYTES = 65_536
BLOCK = 4096
LEVEL = 3
# A text of less than so many bytes says little; its evidence is scaled down.
SHORT = 64


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float


def bounded(rows: list[bytes], limit: int) -> list[bytes]:
    """The rows that fit in ``limit`` bytes, in their order; one that does not fit is passed over."""
    kept, size = [], 0
    for r in rows:
        if size + len(r) > limit:
            continue
        kept.append(r)
        size += len(r)
    return kept


def dictionary(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the plain beginning of the texts where there are too few to train one."""
    blocks = [t[i:i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:size]


class Measure:
    """Compressed sizes of a text under two dictionaries. One object serves one task."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
                     for d in (good, bad)]
        for c in self.pair:
            c.compress(b"")

    def __call__(self, data: bytes) -> tuple[float, float, float]:
        """Normalised difference (positive: the good dictionary fits better), compressed share, and its square."""
        if not data:
            return 0.0, 0.0, 0.0
        good, bad = (sum(len(c.compress(data[i:i + BLOCK])) for i in range(0, len(data), BLOCK)) for c in self.pair)
        weight = min(1.0, len(data) / SHORT)
        share = min(good, bad) / len(data)
        return weight * (bad - good) / max(good, bad), weight * share, weight * share * share


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Dictionaries from one half of the sample, calibration on the other half; class weights restore the true shares.

    With labels of one class only (or none) there is nothing to tell apart: the score is that class's smoothed share.
    """
    shares = {r[label]: r["count"] for r in labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    prior = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
    half = F.pmod(F.xxhash64(F.col("_key").cast("string"), F.lit(23)), F.lit(2))
    # By the hash that chose the sample, so what is used is a hash sample too.
    rank = F.xxhash64(F.col("_key").cast("string"), F.lit(17))
    rows = sorted((r["_label"], r["half"], r["rank"], r["data"]) for r in
                  sample(docs, labels, key, text, label).select("_label", half.alias("half"), rank.alias("rank"), F.encode("_text", "UTF-8").alias("data")).toLocalIterator())
    part = {(y, h): bounded([bytes(d) for y2, h2, _, d in rows if (y2, h2) == (y, h)], SAMPLE_CHARS // 2) for y in (0, 1) for h in (0, 1)}
    good, bad = dictionary(part[1, 0]), dictionary(part[0, 0])
    held = [(y, d) for y in (0, 1) for d in part[y, 1]]
    if min(len(part[0, 1]), len(part[1, 1])) < 5:
        return Model(good, bad, (0.0,) * 3, (1.0,) * 3, (0.0,) * 3, math.log(prior / (1 - prior)), prior)
    measure = Measure(good, bad)
    x, y = np.array([measure(d) for _, d in held]), np.array([float(v) for v, _ in held])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    w, bias = logistic((x - mean) / scale, y, weight)
    return Model(good, bad, tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()), bias, prior)


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability (0 to 1) that a text is good.

    Null and empty texts have nothing to compress and get the share of good labels. Every whole text is measured;
    equal texts have equal scores. Columns of the name ``out`` are replaced; an empty table stays empty.
    """
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        measure = Measure(model.good, model.bad)
        mean, scale, weights = (np.array(v) for v in (model.mean, model.scale, model.weights))
        for batch in batches:
            x = np.array([measure(t.encode()) if t else (np.nan,) * 3 for t in batch]).reshape(-1, 3)
            # summed row by row: a matrix product may round the rows of a batch differently
            p = 1 / (1 + np.exp(-np.clip(((x - mean) / scale * weights).sum(axis=1) + model.bias, -30, 30)))
            yield pd.Series(np.where(np.isnan(p), model.prior, p))

    return without(docs, out).withColumn(out, scores(F.col(text)))
