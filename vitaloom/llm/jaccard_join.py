"""Exact n-gram Jaccard join: which documents are linked by near-equal shingle sets.

Two sets that reach the threshold share one of their first tokens (their prefixes) under any fixed order of tokens. The
order here is by how often a token's counter was hit in the whole corpus, so prefixes hold rare tokens and the lists of
the inverted index over prefixes are short, except for families of near copies. What is known about the sets spares most
of the work:

* Equal sets are one set with several documents.
* An index list is skipped by position: two entries with ``p`` and ``q`` tokens in front of the common one can share no
  more than the shorter rest, and sizes too far apart cannot be similar.
* Each set carries a small signature (an exclusive or of hashes in buckets); buckets that differ are a lower bound of the
  difference, which settles nearly all unrelated pairs without the sets.
* Short lists are compared pair by pair. In a long list every entry is compared with the list's head, the entry with
  the fewest rare tokens: for a family of near copies this one answer stands for all, because an entry that is linked to
  the head has the head's component and need not be compared inside it. Only entries of different components are
  compared after that, block by block, and blocks of one component are skipped.

So no list emits all its pairs, however long, and no link between components is lost: a pair is left out only when its
sets are known to be connected already or provably too different.

The number of links of each document is counted after that, because linked sets are always in one component. One set of
a component, its head, stands for the others: each set is held as its difference ``D`` to the head. The difference of
two sets is ``D1`` xor ``D2``, so ``|D1| + |D2| - 2 |D1 & D2|`` gives their overlap exactly. For near copies the
differences are a few tokens. Blocks of a component are compared two by two, and only sums for each set leave a task.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import WordIds, discard
from vitaloom.llm.components import connected
from vitaloom.session import cut_lineage

COUNTER_BITS = 18
# Lists up to this length are compared pair by pair.
SHORT_LIST = 16
# Entries of a block of a long list.
BLOCK = 256
# Sets of a block when links are counted, and tokens that are multiplied at once.
LINK_BLOCK = 512
WIDTH = 2048
NULL_KEY = -(1 << 63)
SETS = "k long, n long, d1 long, d2 long, prefix array<long>, sig binary"


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; sets are linked when ``den * shared >= num * united``."""

    words: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def linked(self, shared, united):
        return self.den * shared >= self.num * united

    def possible(self, n1: Column, n2: Column, most: Column) -> Column:
        """Whether sets of these sizes can be linked when they share ``most`` at most."""
        return F.lit(self.den) * most >= F.lit(self.num) * (n1 + n2 - most)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, ids: WordIds, words: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a whole text: A-Z in lower case, ASCII white space between words."""
    found = text.encode().lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    x = np.fromiter(map(ids.__getitem__, found), np.uint64, len(found))
    k = min(words, len(x))
    n = len(x) - k + 1
    h = mix(x[:n].copy())
    for j in range(1, k):
        h = mix(h * np.uint64(3) + x[j:n + j])
    return np.unique(h)


def signature(tokens: np.ndarray) -> np.ndarray:
    """One byte for each of 2^j buckets, at least a quarter of the tokens: the exclusive or of their hashes."""
    buckets = 1 << max(3, int(len(tokens) // 3).bit_length())
    sig = np.zeros(buckets, np.uint8)
    h = mix(tokens + np.uint64(11))
    np.bitwise_xor.at(sig, (h & np.uint64(buckets - 1)).astype(np.int64), (h >> np.uint64(56)).astype(np.uint8))
    return sig


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of how many tokens are in just one of two sets."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.count_nonzero(x != y))


def token_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How often each of ``2^COUNTER_BITS`` counters is hit by the shingle sets of all documents. A fixed size."""
    size = 1 << COUNTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total, held, waiting = WordIds(), np.zeros(size, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append((shingles(text, ids, words) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64))
                waiting += len(held[-1])
                if waiting > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        at = np.nonzero(total)[0]
        for i in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + (1 << 16)]), pa.array(total[at[i:i + (1 << 16)]])], names=["i", "n"])

    sums = docs.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[sums["i"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return counts


def shingle_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row for each document (``k``, ``text``): size, digest, prefix and signature of its set. Written once."""
    counts = docs.sparkSession.sparkContext.broadcast(token_counts(docs.select("text"), rule.words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keys, n, d1, d2, prefixes, sigs = part.column(0), [], [], [], [], []
                for text in part.column(1).to_pylist():
                    tokens = shingles(text, ids, rule.words)
                    order = np.lexsort((tokens, counts.value[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))
                    d = xxhash.xxh3_128_digest(tokens.tobytes())
                    n.append(len(tokens))
                    d1.append(int.from_bytes(d[:8], "big", signed=True))
                    d2.append(int.from_bytes(d[8:], "big", signed=True))
                    prefixes.append(tokens[order[:rule.prefix(len(tokens))]].view(np.int64) if len(tokens) else np.empty(0, np.int64))
                    sigs.append(signature(tokens).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
                     pa.array(sigs, pa.binary())], names=["k", "n", "d1", "d2", "prefix", "sig"])

    return cut_lineage(docs.select("k", "text").mapInArrow(run, SETS), "sets")


def index(sets: DataFrame, rule: Rule) -> DataFrame:
    """Entries of the inverted index over prefixes: ``token, r, n, p`` and ``m``, the length of the token's list (2 or more)."""
    entries = sets.select("r", "n", F.posexplode("prefix").alias("p", "token"))
    lengths = sets.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    return cut_lineage(entries.join(lengths, "token").select("token", "r", "n", F.col("p").cast("long").alias("p"), "m"), "index")


def fits(rule: Rule, a: str, b: str) -> Column:
    """The size and position filters for two entries of one list."""
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.p"), F.col(f"{b}.n") - F.col(f"{b}.p"))
    return rule.possible(F.col(f"{a}.n"), F.col(f"{b}.n"), rest)


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def first_pairs(entries: DataFrame, rule: Rule) -> DataFrame:
    """All pairs of short lists; of long lists every entry with the head."""
    one = F.struct("p", "n", "r").alias("e")
    lists = entries.where(F.col("m") <= SHORT_LIST).groupBy("token").agg(F.sort_array(F.collect_list(one)).alias("es"))
    # Each entry with the entries behind it.
    nested = F.transform("es", lambda x, i: F.struct(x.alias("x"), F.slice("es", i + 2, SHORT_LIST).alias("behind")))
    short = (lists.select(F.explode(nested).alias("s")).select(F.col("s.x").alias("x"), F.explode("s.behind").alias("y"))
             .where(fits(rule, "x", "y")).select(*ordered(F.col("x.r"), F.col("y.r"))))
    long = entries.where(F.col("m") > SHORT_LIST)
    heads = long.groupBy("token").agg(F.min(F.struct("p", "n", "r")).alias("x"))
    star = long.select("token", F.struct("p", "n", "r").alias("y")).join(heads, "token").where(fits(rule, "x", "y")).select(*ordered(F.col("x.r"), F.col("y.r")))
    return short.unionByName(star).where("a <> b").distinct()


def rest_pairs(entries: DataFrame, component: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of long lists whose sets are in different components, from pairs of blocks; lists of one component are skipped."""
    named = (entries.where(F.col("m") > SHORT_LIST).join(component, F.col("r") == F.col("node"), "left")
             .select("token", "r", "n", "p", "m", F.coalesce("component", "r").alias("c")))
    mixed = named.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token")
    left = named.join(mixed, "token")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = left.withColumn("block", F.pmod(F.xxhash64("r"), blocks).cast("int"))
    other = placed.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    tiles = (other.select("token", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.struct("r", "n", "p", "c", "block").alias("e"))
             .groupBy("token", "i", "j").agg(F.collect_list("e").alias("es"), F.min("e.c").alias("lo"), F.max("e.c").alias("hi")).where("lo <> hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, es in zip(*(batch.column(x).to_pylist() for x in (0, 1, 2)), strict=True):
                a = np.array([(e["r"], e["n"], e["p"], e["c"]) for e in es if e["block"] == i], np.int64).reshape(-1, 4)
                b = np.array([(e["r"], e["n"], e["p"], e["c"]) for e in es if e["block"] == j], np.int64).reshape(-1, 4)
                if not len(a) or not len(b):
                    continue
                most = np.minimum.outer(a[:, 1] - a[:, 2], b[:, 1] - b[:, 2])
                ok = rule.linked(most, np.add.outer(a[:, 1], b[:, 1]) - most) & (a[:, None, 3] != b[None, :, 3])
                x, y = np.nonzero(ok)
                ra, rb = a[x, 0], b[y, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ra, rb)), pa.array(np.maximum(ra, rb))], names=["a", "b"])

    return tiles.select("i", "j", "es").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The linked ones of candidate pairs: signatures first, then the sets themselves."""
    small = sets.select("r", "n", "sig")
    left = small.select(F.col("r").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = small.select(F.col("r").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, sa, nb, sb in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4, 5)), strict=True):
                most = (na + nb - differing(sa, sb)) // 2
                keep.append(rule.linked(most, na + nb - most))
            yield batch.select([0, 3]).filter(pa.array(keep, pa.bool_()))

    close = cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "na", "sa", "b", "nb", "sb").mapInArrow(near, "a long, b long"), "close")
    needed = close.select(F.col("a").alias("k")).union(close.select("b")).distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [shingles(t, ids, rule.words).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["k", "tokens"])

    full = cut_lineage(docs.join(needed, "k").select("k", "text").mapInArrow(tokens, "k long, tokens binary"), "tokens")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(rule.linked(shared, len(x) + len(y) - shared)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sides = close.join(full.select(F.col("k").alias("b"), F.col("tokens").alias("tb")), "b").join(full.select(F.col("k").alias("a"), F.col("tokens").alias("ta")), "a")
    links = cut_lineage(sides.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "links")
    discard(full)
    return links


def shared_tokens(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of ``x`` has in common with each of ``y``. Memory is bounded by ``WIDTH``."""
    flat = [np.concatenate([*side, np.empty(0, np.uint64)]) for side in (x, y)]
    owner = [np.repeat(np.arange(len(side)), [len(t) for t in side]) for side in (x, y)]
    both = np.intersect1d(*flat)
    total = np.zeros((len(x), len(y)), np.float32)
    if not len(both):
        return total.astype(np.int64)
    at = [np.minimum(np.searchsorted(both, f), len(both) - 1) for f in flat]
    known = [both[a] == f for a, f in zip(at, flat, strict=True)]
    for low in range(0, len(both), WIDTH):
        sides = []
        for i, side in enumerate((x, y)):
            here = known[i] & (at[i] >= low) & (at[i] < low + WIDTH)
            m = np.zeros((len(side), min(WIDTH, len(both) - low)), np.float32)
            m[owner[i][here], at[i][here] - low] = 1
            sides.append(m)
        total += sides[0] @ sides[1].T
    return total.astype(np.int64)


def tile_links(a: list[dict], b: list[dict], rule: Rule) -> np.ndarray:
    """Which sets of two blocks of a component are linked; rows are dicts of ``n`` and ``diff`` (bytes)."""
    x, y = ([np.frombuffer(e["diff"], np.uint64) for e in side] for side in (a, b))
    n = np.add.outer(np.array([e["n"] for e in a], np.int64), np.array([e["n"] for e in b], np.int64))
    d = np.add.outer(np.array([len(t) for t in x], np.int64), np.array([len(t) for t in y], np.int64))
    least = (n - d) // 2  # n and d differ by an even number
    most = least + np.minimum.outer([len(t) for t in x], [len(t) for t in y])
    sure = rule.linked(least, n - least)
    if not (rule.linked(most, n - most) & ~sure).any():
        return sure
    shared = least + shared_tokens(x, y)
    return rule.linked(shared, n - shared)


def link_counts(sets: DataFrame, component: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """``d1, d2, n_links``: how many other rows have a set linked to this one, rows of an equal set included."""
    placed = cut_lineage(sets.join(component, F.col("r") == F.col("node"), "left").select("d1", "d2", "r", "n", "copies", F.coalesce("component", "r").alias("c")), "placed")
    heads = placed.groupBy("c").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("d1", "d2")).alias("head")).where("m > 1")
    several = placed.join(heads, "c")
    needed = several.select(F.col("r").alias("k")).distinct()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = [shingles(t, ids, rule.words).tobytes() for t in batch.column(0).slice(at, 128).to_pylist()]
                digests = [xxhash.xxh3_128_digest(t) for t in part]
                d1, d2 = (pa.array([int.from_bytes(d[i:i + 8], "big", signed=True) for d in digests], pa.int64()) for i in (0, 8))
                yield pa.RecordBatch.from_arrays([d1, d2, pa.array(part, pa.binary())], names=["d1", "d2", "tokens"])

    # A key with several texts, or a text repeated under its key, brings rows that are not needed or needed once.
    texts = docs.join(needed, "k", "left_semi").select("text").mapInArrow(tokens, "d1 long, d2 long, tokens binary")
    held = cut_lineage(several.join(texts, ["d1", "d2"]).groupBy("d1", "d2").agg(
        *(F.first(x).alias(x) for x in ("c", "m", "n", "copies", "head", "tokens"))), "held")

    def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            diffs = [np.setxor1d(np.frombuffer(t, np.uint64), np.frombuffer(h, np.uint64), assume_unique=True).tobytes()
                     for t, h in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(diffs, pa.binary())], names=["c", "m", "d1", "d2", "n", "copies", "diff"])

    head = held.where("d1 = head.d1 and d2 = head.d2").select("c", F.col("tokens").alias("h"))
    apart = held.join(head, "c").select("c", "m", "d1", "d2", "n", "copies", "tokens", "h").mapInArrow(
        differences, "c long, m long, d1 long, d2 long, n long, copies long, diff binary")
    count = F.ceil(F.col("m") / LINK_BLOCK).cast("int")
    blocks = cut_lineage(apart.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("d1", "d2"), count).cast("int")).groupBy("c", "blocks", "block")
                         .agg(F.collect_list(F.struct("d1", "d2", "n", "copies", "diff")).alias("es")), "blocks")
    discard(held)

    def sums(es: list[dict], links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([e["d1"] for e in es], pa.int64()), pa.array([e["d2"] for e in es], pa.int64()),
                                           pa.array(links, pa.int64())], names=["d1", "d2", "links"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                es = batch.column(0)[i].as_py()
                linked = tile_links(es, es, rule)
                np.fill_diagonal(linked, False)
                yield sums(es, linked @ np.array([e["copies"] for e in es], np.int64))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                linked = tile_links(a, b, rule)
                yield sums(a, linked @ np.array([e["copies"] for e in b], np.int64))
                yield sums(b, np.array([e["copies"] for e in a], np.int64) @ linked)

    many = blocks.where("blocks > 1")
    pairs = (many.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).where("o <> block")
             .select("c", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), F.struct("block", "es").alias("side"))
             .groupBy("c", "i", "j").agg(F.sort_array(F.collect_list(F.struct(F.col("side.block").alias("block"), F.col("side.es").alias("es")))).alias("s"))
             .where("size(s) = 2").select(F.col("s")[0]["es"].alias("a"), F.col("s")[1]["es"].alias("b")))
    schema = "d1 long, d2 long, links long"
    found = blocks.select("es").mapInArrow(own, schema).unionByName(pairs.mapInArrow(across, schema)).groupBy("d1", "d2").agg(F.sum("links").alias("links"))
    return placed.select("d1", "d2", "copies").join(found, ["d1", "d2"], "left").select("d1", "d2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", rule: Rule = Rule(), links: bool = False) -> DataFrame:
    """One row for each document: the key, ``n_shingles`` (size of its set) and ``component_id``.

    With ``links`` also ``n_links``: how many other rows are linked to this one, those of equal sets included.

    The component is the smallest key that a document reaches by links, itself included. Documents without a word have
    an empty set and are linked with nothing, not even with each other. Keys are whole numbers; null keys count as one
    key before all others. Rows that share a key are parts of one document: they share a component. Repeated rows stay.
    Other columns are not looked at.
    """
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k"), F.col(text).alias("text"))
    rows = shingle_sets(docs, rule)
    sets = cut_lineage(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("k").alias("r"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
                                                                  F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")), "distinct")
    entries = index(sets, rule)
    found_links = verified(first_pairs(entries, rule), sets, docs, rule)
    component = cut_lineage(connected(found_links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "component")
    rest = cut_lineage(rest_pairs(entries, component, rule), "rest")
    # Documents of one key but different texts hang together through the smallest keys of their sets.
    members = rows.where("n > 0").join(sets.select("d1", "d2", "r"), ["d1", "d2"]).select("k", "r", "n", "d1", "d2")
    own = members.where("k <> r").select(F.col("k").alias("u"), F.col("r").alias("v")).distinct()
    discard(entries)
    if rest.limit(1).count():
        found_links = found_links.unionByName(verified(rest, sets, docs, rule))
    repeated = members.groupBy("k").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select(F.col("k").alias("rk"))
    several = own.join(repeated, F.col("u") == F.col("rk"), "left_semi")
    component = cut_lineage(connected(found_links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(several)), "component")
    found = members.join(component, F.col("r") == F.col("node"), "left").select("k", "n", "d1", "d2", F.coalesce("component", "r").alias("c"))
    more = []
    if links:
        found = found.join(link_counts(sets, component, docs, rule), ["d1", "d2"])
        more = ["n_links"]
    empty = rows.where("n = 0").select("k", "n", F.col("k").alias("c"), F.lit(0).cast("long").alias("n_links"))
    found = found.select("k", "n", "c", *more).unionByName(empty.select("k", "n", "c", *more))
    real = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    return found.select(real("k").alias(key), F.col("n").alias("n_shingles"), real("c").alias("component_id"), *more)
