"""Byte strings of a threshold length that occur more than once, by a depth-limited radix sort of suffixes.

Suffixes are told apart most significant digit first and never beyond the threshold's depth; what is still equal at that
depth is a repeated window. Sorting all suffixes to full depth would move the corpus once for every byte of it, so the
passes use digits that shrink the work early:

1. The first digit of a window is its anchor: of all ``DIGIT``-byte strings (shorter ones for a short threshold) in it the one with the smallest
   hash (the leftmost of equals). Equal windows have equal anchors at equal places. Neighbouring windows mostly share
   their anchor, so one row stands for about ``(threshold - DIGIT) / 2`` suffixes. Anchors that occur once end here.
2. The second digit is the whole stretch that the windows of an anchor cover. Stretches that are equal to another are
   repeated in all their windows, and one of them stands for all from here on.
3. Where an anchor has several different stretches, the third digit is the core that ``STEP`` neighbouring windows have in
   common, carried with the few bytes left and right of it. A core that occurs once is in no repeated window; cores with
   equal margins are repeated in all their windows.
4. Only where a core has several different margins the windows themselves are compared, as core and parts of the margins;
   equal groups are exactly the repeated windows.

Digits are compared by 64-bit hashes on top of the anchor's own 64 bits, cores by 128 bits, margins as they are. Every pass is a partial aggregate and a join
with a side that is unique on the key, so a passage that a third of all documents share is one row per task in the
aggregates and can be split in the joins. Texts meet their spans by a key of their content.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vitaloom.llm.common import as_batch, discard, spare
from vitaloom.session import cut_lineage

THRESHOLD = 400
# Longest anchor. A short threshold has shorter ones, or there would be about as many anchors as windows.
DIGIT = 128
LEAST = 129
# Windows whose common core is compared at once.
STEP = 16
# Window starts that are looked at together; bounds the arrays for a very long text.
BLOCK = 1 << 18
POSITION_BITS = 20
# Packed: start of the stretch (31 bits), number of its windows and place of the anchor in it (10 bits each), more bits of
# the text's identity (12 bits).
COUNT_BITS, CHECK_BITS = 10, 12


def digit_of(threshold: int) -> int:
    """Length of the anchors of a threshold."""
    return DIGIT if threshold >= 300 else threshold // 3


class Hashes:
    """Rolling hashes of all strings of one length: a prefix sum of random letters times powers, modulo 2^64."""

    def __init__(self, size: int, length: int):
        rng = np.random.default_rng(20)
        self.letters = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = 0x9E3779B97F4A7C15 | 1
        self.up = self.powers(base, size)
        self.down = self.powers(pow(base, -1, 1 << 64), size)
        self.length = length

    @staticmethod
    def powers(base: int, n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))

    def __call__(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[:n], out=sums[1:])
        h = (sums[self.length:] - sums[:-self.length]) * self.down[:n - self.length + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    rest = width - size
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def stretches(data: bytes, hashes: Hashes, threshold: int) -> Iterator[tuple[int, int, int, int]]:
    """Anchors of a text: (anchor's hash, anchor's place, first window, number of windows)."""
    width = threshold - hashes.length + 1
    windows = len(data) - threshold + 1
    raw = np.frombuffer(data, np.uint8)
    for start in range(0, max(windows, 0), BLOCK):
        stop = min(windows, start + BLOCK)
        h = hashes(raw[start:stop + threshold - 1])
        places = np.arange(len(h), dtype=np.uint64)
        mask = np.uint64((1 << POSITION_BITS) - 1)
        at = (smallest((h & ~mask) | places, width) & mask).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
        count = np.diff(np.append(first, len(at)))
        yield from zip(h[at[first]].view(np.int64).tolist(), (at[first] + start).tolist(), (first + start).tolist(), count.tolist(), strict=True)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def anchors(threshold: int):
    """Rows of one text: ``h`` the anchor, ``c`` the stretch (its bytes and the anchor's place in it), where it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(BLOCK + threshold, digit_of(threshold))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for t, check, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                view = memoryview(data)
                for h, at, first, count in stretches(data, hashes, threshold):
                    out[0].append(h)
                    out[1].append(signed(xxhash.xxh3_64_intdigest(view[first:first + count - 1 + threshold], at - first)))
                    out[2].append(t)
                    out[3].append(((first << COUNT_BITS | count) << COUNT_BITS | at - first) << CHECK_BITS | check)
                    if len(out[0]) >= 50_000:
                        yield batch_of(out)
                        out = [[], [], [], []]
            if out[0]:
                yield batch_of(out)
    return run


def batch_of(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "c", "t", "p"])


def bits(p: str, low: int, width: int) -> Column:
    return F.shiftright(p, low).bitwiseAND(F.lit((1 << width) - 1))


def first_window(p: str) -> Column:
    return F.shiftright(p, 2 * COUNT_BITS + CHECK_BITS)


def window_count(p: str) -> Column:
    return bits(p, COUNT_BITS + CHECK_BITS, COUNT_BITS)


def anchor_place(p: str) -> Column:
    return bits(p, CHECK_BITS, COUNT_BITS)


def check_of(p: str) -> Column:
    return bits(p, 0, CHECK_BITS)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts travel compressed to where a stretch of them is looked at again."""
    small = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out = pa.array([small.compress(t.encode()) for t in part.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), out], names=["t", "check", "packed"])


CORES = "d1 long, d2 long, lft binary, rgt binary, t long, x long, n long"


def cores(threshold: int):
    """Groups of ``STEP`` windows, by their distance from the anchor: the core's hash, the margins that the stretch covers, and where."""
    types = to_arrow_schema(StructType.fromDDL(CORES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t, check, packed, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = zstandard.decompress(packed)
                for part in parts:
                    first, end, at = part["first"], part["first"] + part["count"], part["first"] + part["at"]
                    x = first
                    while x < end:
                        # Windows at - start in [j * STEP, (j + 1) * STEP) have one core.
                        j = (at - x) // STEP
                        stop = min(end, at - j * STEP + 1)
                        core_start, core_stop = at - j * STEP, at - j * STEP - STEP + 1 + threshold
                        d = xxhash.xxh3_128_intdigest(data[core_start:core_stop], j)
                        out.append((signed(d >> 64), signed(d & (1 << 64) - 1), data[x:core_start], data[core_stop:stop - 1 + threshold], t, x << CHECK_BITS | check,
                                    part["n"]))
                        x = stop
                    if len(out) >= 20_000:
                        yield as_batch(out, types)
                        out = []
            if out:
                yield as_batch(out, types)
    return run


def identity(text: str) -> tuple[Column, Column, Column]:
    """The hash of a text, a check beside it, and the text with null as empty."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.xxhash64(body), F.pmod(F.xxhash64(F.lit(1), body), F.lit(1 << CHECK_BITS)), body


def repeated_spans(docs: DataFrame, text: str, threshold: int) -> DataFrame:
    """Windows that occur more than once, as runs of window starts of each different text: ``t, check, first, last``."""
    t, check, body = identity(text)
    texts = docs.select(t.alias("t"), check.alias("check"), body.alias("text")).where(F.octet_length("text") >= threshold)
    found = cut_lineage(texts.mapInArrow(anchors(threshold), "h long, c long, t long, p long"), "anchors")
    # First digit: anchors that occur once are done; an anchor with one stretch needs no further digit.
    groups = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    alive = cut_lineage(found.join(groups, "h").select("h", "c", "t", "p", (F.col("lo") != F.col("hi")).alias("mixed")), "alive")
    discard(found)
    mixed = alive.where("mixed")
    # Second digit: equal stretches of an anchor.
    classes = mixed.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.first("t").alias("t"), F.first("p").alias("p"))
    same = alive.where("not mixed").select("t", "p").unionByName(mixed.join(classes.where("n > 1").select("h", "c"), ["h", "c"]).select("t", "p"))
    runs = same.select("t", check_of("p").alias("check"), first_window("p").alias("first"), (first_window("p") + window_count("p") - 1).alias("last"))
    # Third digit: the cores of what is left, one stretch for each class.
    parts = (classes.select("t", check_of("p").alias("check"), F.struct(first_window("p").alias("first"), window_count("p").alias("count"),
                                                                       anchor_place("p").alias("at"), F.least("n", F.lit(2)).alias("n")).alias("part"))
             .groupBy("t", "check").agg(F.collect_list("part").alias("parts")))
    packed = texts.mapInArrow(pack, "t long, check long, packed binary")
    once = packed.groupBy("t", "check").agg(F.first("packed").alias("packed"))
    found = cut_lineage(once.join(parts, ["t", "check"]).select("t", "check", "packed", "parts").mapInArrow(cores(threshold), CORES), "cores")
    core, margins = ["d1", "d2"], ["lft", "rgt"]
    classes = found.groupBy(*core, *margins).agg(F.sum("n").alias("n"), F.first("t").alias("t"), F.first("x").alias("x"))
    start = F.shiftright("x", CHECK_BITS)
    count = F.octet_length("rgt") - (STEP - 1 - F.octet_length("lft")) + 1
    more = found.where("n = 1").join(classes.where("n > 1").select(*core, *margins), core + margins)
    runs = runs.unionByName(more.select("t", check_of("x").alias("check"), start.alias("first"), (start + count - 1).alias("last")))
    # Fourth digit: the windows of cores with different margins. The i-th has the left margin's end and the right one's beginning.
    several = classes.groupBy(*core).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(*core)
    windows = classes.join(several, core).select(*core, *margins, "t", "x", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    whole = [F.expr("substring(lft, i + 1)").alias("lft"), F.expr(f"substring(rgt, 1, {STEP - 1} - octet_length(lft) + i)").alias("rgt")]
    windows = windows.select(*core, *whole, "t", (F.col("x") + F.shiftleft(F.col("i").cast("long"), CHECK_BITS)).alias("x"), F.least("n", F.lit(2)).alias("n"))
    again = windows.groupBy(*core, *margins).agg(F.sum("n").alias("n")).where("n > 1").select(*core, *margins)
    late = windows.where("n = 1").join(again, core + margins).select("t", check_of("x").alias("check"), start.alias("first"), start.alias("last"))
    return runs.unionByName(late).distinct()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching byte ranges as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, *, text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Add ``kept`` (the bytes that stay), ``kept_text`` (their whole characters), ``n_bytes``, ``n_removed`` and ``removed`` (maximal ranges of removed bytes).

    A byte is removed when a string of ``threshold`` bytes covers it that also starts at another place, in the same text
    or in another; all occurrences go, and strings are judged on the input. Texts are UTF-8, null is empty; no match
    crosses a text's end; texts below the threshold stay whole. Repeated rows and equal texts count as places of their
    own. Columns of those names are replaced; other columns and the number of rows stay.
    """
    if not LEAST <= threshold < DIGIT + (1 << COUNT_BITS):
        raise ValueError(f"the threshold must be from {LEAST} to {DIGIT + (1 << COUNT_BITS) - 1} bytes")
    h, check, packed_text, lists, result = spare(docs, "_t", "_check", "_packed", "_spans", "_cut")
    spans = (repeated_spans(docs, text, threshold).groupBy("t", "check")
             .agg(F.collect_list(F.struct("first", "last")).alias(lists)).withColumnsRenamed({"t": h, "check": check}))

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        small = zstandard.ZstdCompressor(level=1)
        for texts in batches:
            yield pd.Series([small.compress(t.encode()) for t in texts], dtype=object)

    # Texts travel to their spans compressed; a text column that nobody reads afterwards does not travel at all.
    own_h, own_check, body = identity(text)
    met = docs.select("*", own_h.alias(h), own_check.alias(check), packed(body).alias(packed_text)).join(spans, [h, check], "left")
    new = ["kept", "kept_text", "n_bytes", "n_removed", "removed"]

    @F.pandas_udf("struct<kept: binary, kept_text: string, n_bytes: long, n_removed: long, removed: array<struct<start: long, stop: long>>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found_lists in batches:
            rows = []
            for t, found in zip(texts, found_lists, strict=True):
                data = zstandard.decompress(t)
                gone = merged([(s["first"], s["last"] + threshold) for s in found]) if found is not None else []
                ends = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                rows.append((kept, kept.decode("utf-8", "ignore"), len(data), len(data) - len(kept), [{"start": a, "stop": b} for a, b in gone]))
            yield pd.DataFrame(rows, columns=new)

    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return met.withColumn(result, cut(packed_text, lists)).select(*own, *[F.col(f"{result}.{c}").alias(c) for c in new])
