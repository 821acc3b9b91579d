"""Repeated word windows, found through recompression.

Words get symbols (64-bit names). Each round of recompression names maximal runs of one symbol, then splits the alphabet
in two by a bit of each symbol and names every pair of a left symbol with a right symbol behind it. Names are hashes of
what they stand for, so they are global without a dictionary: equal substrings get equal symbols inside, wherever they
are, and only symbols near their ends depend on the surroundings. For every symbol its context is tracked: the words
that decide that it arises. A symbol whose context lies in a window arises in every copy of that window.

The Spark passes:

1. A window's anchor is the interior symbol with the smallest name (name and context words together). Neighbouring
   windows mostly share it, so one row stands for several windows. Anchors that occur once end here.
2. Of equal stretches (all words that the windows of an anchor cover) only the earliest can be a first occurrence: the
   others are removed, the earliest stands for all.
3. Where an anchor has different stretches, their windows are compared one by one, with the earliest of equals staying.

Windows without an interior symbol (a few long runs) are their own anchors; the windows inside one run all equal the
first of them and never leave their text. All passes are partial aggregates and joins with a side that is unique on the
key.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import WordIds, spare
from vitaloom.session import cut_lineage

WINDOW = 20
ROUNDS = 2
# Windows of one text that are looked at together; bounds the arrays for a very long text.
BLOCK = 1 << 17
LONG_TEXT = 1 << 22
WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
# Packed: first window (31 bits), number of windows (8 bits), part of the text's hash (24 bits).
COUNT_BITS, CHECK_BITS = 8, 24
PLACE_BITS = 18


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Parse:
    """Symbols of a stretch of words, with the words they stand for and their contexts, both as half-open ranges.

    What lies outside is not known: contexts of symbols that depend on it reach beyond the ends.
    """

    def __init__(self, words: np.ndarray, rounds: int = ROUNDS):
        n = len(words)
        at = np.arange(n, dtype=np.int64)
        self.names, self.start, self.stop = mix(words), at, at + 1
        self.left, self.right = at.copy(), at + 1
        self.n = n
        for level in range(rounds):
            if len(self.names):
                self.runs(level)
                self.pairs(level)

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """Contexts that hold the neighbours' contexts too."""
        left = np.concatenate([[-1], self.left[:-1]])
        right = np.concatenate([self.right[1:], [self.n + 1]])
        return left, right

    def keep(self, first: np.ndarray, last: np.ndarray, names: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.start, self.stop, self.names, self.left, self.right = self.start[first], self.stop[last], names, left, right

    def runs(self, level: int) -> None:
        first = np.concatenate([[0], np.nonzero(self.names[1:] != self.names[:-1])[0] + 1])
        last = np.append(first[1:], len(self.names)) - 1
        count = (last - first + 1).astype(np.uint64)
        names = np.where(count > 1, mix(self.names[first] ^ mix(count + np.uint64(level << 40) + np.uint64(1 << 50))), self.names[first])
        left, right = self.around()
        self.keep(first, last, names, left[first], right[last])

    def pairs(self, level: int) -> None:
        """A left symbol looks at what follows it, a right one at what stands before it."""
        n = len(self.names)
        is_left = (mix(self.names + np.uint64(level + 77)) >> np.uint64(63)).astype(bool)
        opens = np.zeros(n, bool)
        opens[:-1] = is_left[:-1] & ~is_left[1:]
        closed = np.concatenate([[False], opens[:-1]])
        left, right = self.around()
        left, right = np.where(is_left, self.left, left), np.where(is_left, right, self.right)
        first = np.nonzero(~closed)[0]
        last = first + opens[first]
        names = np.where(opens[first], mix(self.names[first] * np.uint64(3) ^ mix(self.names[last] + np.uint64(level + 1))), self.names[first])
        self.keep(first, last, names, left[first], right[last])


def anchors_of(words: np.ndarray, window: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of windows with one anchor: (anchor's name, first window, number of windows).

    The name is 0 for windows inside one run behind the run's first.
    """
    windows = len(words) - window + 1
    parse = Parse(words)
    # The name together with the words of its context, by prefix sums of powers.
    inside = (parse.left >= 0) & (parse.right <= len(words)) & (parse.right - parse.left <= window)
    left, right, names = parse.left[inside], parse.right[inside], parse.names[inside]
    if len(names):
        base = 0x9E3779B97F4A7C15
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), base, np.uint64)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(words), pow(base, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * up[:-1])])
        names = mix(names ^ mix((sums[right] - sums[left]) * down[left]))
    x = np.arange(windows)
    lo = np.searchsorted(left, x, "left")
    hi = np.searchsorted(right, x + window, "right")
    found = hi > lo
    anchor = np.full(windows, -1, np.int64)
    if found.any():
        mask = np.uint64((1 << PLACE_BITS) - 1)
        keys = [(names & ~mask) | np.arange(len(names), dtype=np.uint64)]
        widest = int((hi - lo).max())
        while 2 << len(keys) - 1 <= widest:
            step = 1 << len(keys) - 1
            keys.append(np.minimum(keys[-1][:-step], keys[-1][step:]))
        a, b = lo[found], hi[found]
        level = np.floor(np.log2(b - a)).astype(np.int64)
        best = np.empty(len(a), np.uint64)
        for k, key in enumerate(keys):
            at = level == k
            best[at] = np.minimum(key[a[at]], key[b[at] - (1 << k)])
        anchor[found] = (best & mask).astype(np.int64)
    alone = ~found
    first = np.nonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | alone[1:]]))[0]
    count = np.diff(np.append(first, windows))
    if alone.any():
        # A window of one word over and over equals the window one word before it if that has the same word.
        same = np.concatenate([[0], np.cumsum(words[1:] == words[:-1])])
        for f, c in zip(first.tolist(), count.tolist(), strict=True):
            if anchor[f] >= 0:
                yield int(names[anchor[f]].view(np.int64)) or 1, f, c
            elif f and same[f + window - 1] - same[f - 1] == window:
                yield 0, f, c
            else:
                yield xxhash.xxh3_64_intdigest(words[f:f + window].tobytes()) >> 1 or 1, f, c
        return
    yield from zip([h or 1 for h in names[anchor[first]].view(np.int64).tolist()], first.tolist(), count.tolist(), strict=True)


def word_blocks(text: bytes, ids: WordIds, window: int) -> Iterator[tuple[int, np.ndarray]]:
    """Word symbols of a text in blocks that overlap by a window less one word, with the number of their first word."""
    if len(text) < LONG_TEXT:
        found = text.split()
        words = np.fromiter(map(ids.__getitem__, found), np.uint64, len(found))
        for start in range(0, max(len(words) - window + 1, 1), BLOCK):
            yield start, words[start:start + BLOCK + window - 1]
        return
    held, start = [], 0
    for m in WORDS.finditer(text):
        held.append(ids[m.group()])
        if len(held) == BLOCK + window - 1:
            yield start, np.array(held, np.uint64)
            held, start = held[BLOCK:], start + BLOCK
    if len(held) >= window or not start:
        yield start, np.array(held, np.uint64)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def anchors(window: int):
    """Rows of a text: ``h`` the anchor, ``c`` the stretch, ``k`` the key, ``p`` where it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        names = ["h", "c", "k", "p"]
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, check, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, words in word_blocks(text.encode(), ids, window):
                    if len(words) < window:
                        continue
                    view = memoryview(words).cast("B")
                    for h, first, count in anchors_of(words, window):
                        out[0].append(h)
                        out[1].append(signed(xxhash.xxh3_64_intdigest(view[8 * first:8 * (first + count - 1 + window)])))
                        out[2].append(k)
                        out[3].append((first + start << COUNT_BITS | count) << CHECK_BITS | check)
                    if len(out[0]) >= 50_000:
                        yield batch_of(out, names)
                        out = [[], [], [], []]
            if out[0]:
                yield batch_of(out, names)
    return run


def batch_of(columns: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def digests(window: int):
    """Windows of some stretches of one text: two hashes of each window's words, and where it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        names = ["d1", "d2", "k", "x"]
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k, check, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = sorted((q["first"], q["first"] + q["count"]) for q in parts)
                at = 0
                for start, words in word_blocks(text.encode(), ids, window):
                    view = memoryview(words).cast("B") if len(words) else memoryview(b"")
                    stop = start + len(words) - window + 1
                    while at < len(wanted) and wanted[at][0] < stop:
                        a, b = wanted[at]
                        for x in range(max(a, start), min(b, stop)):
                            d = xxhash.xxh3_128_intdigest(view[8 * (x - start):8 * (x - start + window)])
                            out[0].append(signed(d >> 64))
                            out[1].append(signed(d & (1 << 64) - 1))
                            out[2].append(k)
                            out[3].append(x << CHECK_BITS | check)
                        if b > stop:
                            wanted[at] = (stop, b)
                            break
                        at += 1
                        if len(out[0]) >= 50_000:
                            yield batch_of(out, names)
                            out = [[], [], [], []]
            if out[0]:
                yield batch_of(out, names)
    return run


def first_window(p: str) -> Column:
    return F.shiftright(p, COUNT_BITS + CHECK_BITS)


def window_count(p: str) -> Column:
    return F.shiftright(p, CHECK_BITS).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))


def check_of(p: str) -> Column:
    return F.col(p).bitwiseAND(F.lit((1 << CHECK_BITS) - 1))


def identity(key: str, text: str) -> tuple[Column, Column, Column]:
    """The key (null is the smallest), a check of the text, and the text with null as empty."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))), F.pmod(F.xxhash64(body), F.lit(1 << CHECK_BITS)), body


def later_windows(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """Windows that also start earlier, as runs of starts in each text: ``k, check, first, last``."""
    k, check, body = identity(key, text)
    texts = docs.select(k.alias("k"), check.alias("check"), body.alias("text"))
    found = cut_lineage(texts.mapInArrow(anchors(window), "h long, c long, k long, p long"), "symbols")
    groups = found.where("h <> 0").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    alive = cut_lineage(found.join(groups, "h"), "alive")
    # Texts of one key that are equal start at the same place: neither is earlier.
    here = F.struct("k", first_window("p").alias("first"))
    classes = alive.groupBy("h", "c").agg(F.min(F.struct("k", first_window("p").alias("first"), "p")).alias("one"))
    classes = classes.select("h", "c", F.struct("one.k", "one.first").alias("earliest"), F.col("one.k").alias("k"), F.col("one.p").alias("p"))
    same = alive.join(classes.select("h", "c", "earliest"), ["h", "c"]).where(here > F.col("earliest")).select("k", "p")
    inside = found.where("h = 0").select("k", "p")
    runs = same.unionByName(inside).select("k", check_of("p").alias("check"), first_window("p").alias("first"),
                                           (first_window("p") + window_count("p") - 1).alias("last"))
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    parts = (classes.join(several, "h").groupBy("k", check_of("p").alias("check"))
             .agg(F.collect_list(F.struct(first_window("p").alias("first"), window_count("p").alias("count"))).alias("parts")))
    windows = cut_lineage(texts.join(parts, ["k", "check"]).select("k", "check", "text", "parts")
                          .mapInArrow(digests(window), "d1 long, d2 long, k long, x long"), "windows")
    start = F.shiftright("x", CHECK_BITS)
    place = F.struct("k", start.alias("first"))
    firsts = windows.groupBy("d1", "d2").agg(F.min(place).alias("earliest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2", "earliest")
    late = (windows.join(firsts, ["d1", "d2"]).where(place > F.col("earliest"))
            .select("k", check_of("x").alias("check"), start.alias("first"), start.alias("last")))
    return runs.unionByName(late).distinct()


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Add ``kept`` (the words that stay, joined by one blank), ``n_words``, ``n_removed`` and ``removed`` (ranges of words).

    A word is removed when ``window`` consecutive words cover it that also start earlier: at a smaller key, or earlier
    in the same text. Windows are judged on the input. Words are runs of other bytes than ASCII white space, unchanged;
    null and empty texts have none, and shorter texts stay whole. Keys are whole numbers; null keys come first. Rows
    that share a key start at the same place, so neither makes the other go. Columns of those names are replaced; other
    columns and the number of rows stay.
    """
    if not 2 <= window < 1 << COUNT_BITS:
        raise ValueError(f"a window has from 2 to {(1 << COUNT_BITS) - 1} words")
    k, check, body, lists, result = spare(docs, "_k", "_check", "_text", "_spans", "_cut")
    spans = (later_windows(docs, key, text, window).groupBy("k", "check").agg(F.collect_list(F.struct("first", "last")).alias(lists))
             .withColumnsRenamed({"k": k, "check": check}))
    own = [c.alias(name) for c, name in zip(identity(key, text), (k, check, body), strict=True)]
    met = docs.select("*", *own).join(spans, [k, check], "left")

    @F.pandas_udf("struct<kept: string, n_words: long, n_removed: long, removed: array<struct<start: long, stop: long>>>")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, found_lists in batches:
            rows = []
            for t, found in zip(texts, found_lists, strict=True):
                words = t.encode().split()
                gone: list[list[int]] = []
                for a, b in sorted((s["first"], s["last"] + window) for s in found) if found is not None else []:
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                ends = [0, *(x for s in gone for x in s), len(words)]
                kept = [w for a, b in zip(ends[::2], ends[1::2], strict=True) for w in words[a:b]]
                rows.append((b" ".join(kept).decode(), len(words), len(words) - len(kept), [{"start": a, "stop": b} for a, b in gone]))
            yield pd.DataFrame(rows, columns=["kept", "n_words", "n_removed", "removed"])

    new = ["kept", "n_words", "n_removed", "removed"]
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    return met.withColumn(result, cut(body, lists)).select(*own, *[F.col(f"{result}.{c}").alias(c) for c in new])
