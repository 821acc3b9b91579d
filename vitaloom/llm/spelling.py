"""Groups of spelling variants: words within one edit of each other, found by PartEnum signatures.

A word's letters with their occurrence numbers are a set, that is, a binary vector. One inserted or deleted letter changes
one place of it and one replaced letter two, so words within one edit are vectors within a Hamming distance of two. The
places are dealt to a fixed number of parts. Vectors that differ in at most ``k`` places agree on all parts but ``k``, so
the sums over every choice of all parts but ``k`` are signatures of which near words share at least one exactly. Signatures
are joined by equality and every pair that meets is verified by its edit distance inside the join.

Replacements keep a word's length and insertions add one to it, so the length is part of a signature, and the two kinds
have signatures of their own: two parts are left out for the first kind (``REPLACED`` parts), one for the second (``INSERTED``).
Multisets know nothing of order, and anagrams of common letters would meet in large groups. An edit leaves the first or the
last half of a word as it was, so each signature is taken once with either half.
"""

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.session import cut_lineage

# Letters of a word; only A-Z have a lower case here.
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LETTERS = 7
LEAST_COUNT = 2
# A form is this many times as frequent as its variant.
RATIO = 10
# A run of letters loses one of them when this divides the hash of its document and itself.
NOISE = 31
# Parts that the places of a vector are dealt to.
REPLACED, INSERTED = 4, 3
# Letters by how common they are, so that the parts hold about as much of a word each; others follow by code point.
COMMON = "eaiontrslucdmphgbfvykwzxjq"
# Different words that a task holds before it passes their counts on.
HELD = 200_000

# Letters stay, in lower case if they are ASCII, and everything else separates.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def noisy(run: bytes, start: int, noise: int) -> bytes:
    """The run (Latin-1) as it counts; ``start`` is the crc32 of what stands before it."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % noise:
        return run
    p = h % len(run)
    return run[:p] + run[p + 1:]


def counted(least: int, noise: int, held: int = HELD):
    """Partial counts of the words of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs = Counter(w for w in text.encode("latin-1", "replace").translate(FOLDED).split() if len(w) >= least)
                start = zlib.crc32(f"{key}:".encode())
                for w, n in runs.items():
                    total[noisy(w, start, noise) if noise else w] += n
                if len(total) >= held:
                    yield from as_counts(total, least)
                    total.clear()
        yield from as_counts(total, least)
    return run


def as_counts(total: Counter, least: int) -> Iterator[pa.RecordBatch]:
    rows = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= least]
    for at in range(0, len(rows), 20_000):
        words, counts = zip(*rows[at:at + 20_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, count: int = LEAST_COUNT,
               noise: int = NOISE) -> DataFrame:
    """``word, n``: all words of at least ``least`` letters that occur ``count`` times or more, with how often they do.

    Every task sums the words of its texts before anything is shuffled. ``noise`` 0 leaves all runs of letters as they are.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(counted(least, noise), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ranks(letters: np.ndarray) -> np.ndarray:
    table = np.arange(128, dtype=np.uint64)
    table[[ord(c) for c in COMMON]] = np.arange(len(COMMON), dtype=np.uint64)
    return np.where(letters < 128, table[np.minimum(letters, 127).astype(np.int64)], letters)


def parts_of(words: list[str], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the hashed places of each word in each part, and the lengths of the words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.uint64), size)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]])
    order = np.argsort(owner << np.uint64(32) | letters, kind="stable")
    letters = letters[order]
    # The how-manieth of its letter a place is.
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    at = np.arange(len(letters))
    nth = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    place = mixed(letters << np.uint64(32) | nth)
    part = (ranks(letters) + np.uint64(3) * nth) % np.uint64(parts)
    sums = np.stack([np.add.reduceat(np.where(part == np.uint64(p), place, np.uint64(0)), starts) for p in range(parts)], axis=1)
    return sums, size.astype(np.uint64)


def halves(words: list[str], size: np.ndarray, more: int) -> list[np.ndarray]:
    """Hashes of both halves of each word. ``more`` 1 takes the halves of a word with a letter less, whichever it is."""
    cut = (size.astype(np.int64) - more) // 2
    rest = size.astype(np.int64) - more - cut
    heads = [zlib.crc32(w[:c].encode()) for w, c in zip(words, cut.tolist(), strict=True)]
    tails = [zlib.crc32(w[len(w) - r:].encode()) for w, r in zip(words, rest.tolist(), strict=True)]
    return [mixed(np.array(h, np.uint64) + np.uint64(which << 32)) for which, h in enumerate((heads, tails))]


def signatures(words: list[str], replaced: int, inserted: int) -> Iterator[tuple[int, np.ndarray]]:
    """(side, signature of each word); sides 0 and 1 meet as the shorter and the longer word, side 2 meets itself."""
    sums, size = parts_of(words, replaced)
    whole, kept = sums.sum(axis=1, dtype=np.uint64), [halves(words, size, more) for more in (0, 1)]
    for i, (p, q) in enumerate(combinations(range(replaced), 2)):
        for half in kept[0]:
            yield 2, mixed(mixed(whole - sums[:, p] - sums[:, q] + size * np.uint64(1 << 16) + np.uint64(i)) + half)
    sums, size = parts_of(words, inserted)
    whole = sums.sum(axis=1, dtype=np.uint64)
    for i in range(inserted):
        for side in (0, 1):
            for half in kept[side]:
                yield side, mixed(mixed(whole - sums[:, i] + (size - np.uint64(side)) * np.uint64(1 << 16) + np.uint64(1 << 15 | i)) + half)


def signed(replaced: int, inserted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                words = part.column(0).to_pylist()
                for side, sig in signatures(words, replaced, inserted):
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.full(len(words), side, np.int8)), part.column(0), part.column(1)],
                                                     names=["sig", "side", "word", "n"])
    return run


def near_words(words: DataFrame, *, replaced: int = REPLACED, inserted: int = INSERTED) -> DataFrame:
    """``word, n, near, near_n`` for every two words of ``words`` (``word, n``, no word twice) within one edit, both ways.

    A word and its near word share one signature as a rule and a few where both changed places are in one part; pairs are
    made distinct after the verification.
    """
    marks = words.mapInArrow(signed(replaced, inserted), "sig long, side byte, word string, n long")
    a, b = (marks.select(*[F.col(c).alias(c + s) for c in ("sig", "side", "word", "n")]) for s in "ab")
    meet = ((F.col("sidea") == 0) & (F.col("sideb") == 1)) | ((F.col("sidea") == 2) & (F.col("sideb") == 2) & (F.col("worda") < F.col("wordb")))
    pairs = (a.join(b, (F.col("siga") == F.col("sigb")) & meet & (F.levenshtein("worda", "wordb", 1) == 1))
             .select("worda", "na", "wordb", "nb").distinct())
    both = F.array(F.struct(F.col("worda").alias("word"), F.col("na").alias("n"), F.col("wordb").alias("near"), F.col("nb").alias("near_n")),
                   F.struct(F.col("wordb").alias("word"), F.col("nb").alias("n"), F.col("worda").alias("near"), F.col("na").alias("near_n")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame, most: int, ratio: int = RATIO) -> DataFrame:
    """``word, root`` for every row of ``forms`` (``word, form``), by pointer doubling.

    A form is ``ratio`` times as frequent as its word, so a chain has no more steps than ``most``, the largest count, has
    factors of ``ratio``; the rounds follow from that and need no test for an end.
    """
    steps = 0
    while ratio ** (steps + 1) <= most:
        steps += 1
    reach, at = 1, forms.select("word", F.col("form").alias("root"))
    while reach < steps:
        at = cut_lineage(at, "roots")
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        at = at.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        reach *= 2
    return at


def variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, count: int = LEAST_COUNT, noise: int = NOISE,
             ratio: int = RATIO, replaced: int = REPLACED, inserted: int = INSERTED) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts.

    Words are the runs of letters of whole texts (A-Z lower-cased), each by its hash with the document's key without one
    letter now and then (``noise``), with at least ``least`` letters and ``count`` occurrences. Two are near at exactly one
    inserted, deleted or replaced letter. The form is the most frequent near word (the first in code-point order of equals)
    if it is ``ratio`` times as frequent or more, else null; the root is the last form that can be reached, or the word.

    Null texts hold no words, a null key hashes as empty text, repeated rows count again, and other columns are not read.
    Very long runs are words like others. An empty table has no words.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its variant: ratio of 2 or more")
    words = cut_lineage(vocabulary(docs, key=key, text=text, least=least, count=count, noise=noise), "words")
    near = near_words(words, replaced=replaced, inserted=inserted).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    best_n = -F.col("best.less")
    fits = best_n >= F.lit(ratio) * F.col("n")
    found = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, best_n).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 0
    at = roots(found.where("form IS NOT NULL"), most // max(count, 1), ratio)
    return found.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
