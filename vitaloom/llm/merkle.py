"""Fingerprints of documents as Merkle trees.

A text is a tree: sections hold paragraphs (lines), paragraphs hold leaves of some dozens of bytes that are cut where
the content says so, which keeps the cuts in place when text is inserted before them. A section ends at an empty line or
at a paragraph whose digest says so. Every node's digest is that of its children's digests; equal roots mean equal texts,
and walking down differing branches finds the edits.

A fingerprint is a string: the root's digest, then one record for each leaf (a short digest, the length in bytes, and
whether a paragraph or section ends there), from which the upper nodes' short digests follow.
"""

import base64
import hashlib
import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vitaloom.llm.common import as_batch

# A leaf ends after a byte where this many bits of a hash of the last four bytes are zero: 64 bytes on average.
CUT_BITS = 6
MAX_LEAF = 4095
# A section ends after a paragraph whose digest's low bits are zero: eight paragraphs on average.
SECTION_MASK = 7
ROWS_PER_BUCKET = 20_000
# Key and head of the text of the row that opens a range.
PAIR = np.dtype([("k", np.int64), ("h", np.int64)])
BLOCK = 1 << 20
NEWLINE = 10
END_PARAGRAPH, END_SECTION = 0x1000, 0x2000


def cuts(data: bytes) -> list[int]:
    """Ends of the leaves. The hash is taken block by block, so a very long text needs no large arrays."""
    ends: list[int] = []
    for start in range(0, len(data), BLOCK):
        raw = np.frombuffer(data[max(0, start - 3):start + BLOCK], np.uint8)
        x = raw.astype(np.uint32)
        here = raw == NEWLINE
        if len(x) > 3:
            h = x[:-3] * np.uint32(2654435761) + x[1:-2] * np.uint32(2246822519) + x[2:-1] * np.uint32(3266489917) + x[3:] * np.uint32(668265263)
            h ^= h >> np.uint32(15)
            h *= np.uint32(2246822519)
            here[3:] |= h >> np.uint32(32 - CUT_BITS) == 0
        skipped = start - max(0, start - 3)
        ends.extend((np.nonzero(here[skipped:])[0] + start + 1).tolist())
    if data and (not ends or ends[-1] != len(data)):
        ends.append(len(data))
    out, last = [], 0
    for e in ends:
        while e - last > MAX_LEAF:
            last += MAX_LEAF
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def tree(data: bytes) -> tuple[bytes, bytes]:
    """Root digest and leaf records of a text."""
    records, sections, paragraphs, leaves = bytearray(), [], [], []
    start, flags = 0, 0
    for end in cuts(data):
        leaf = digest(data[start:end])
        leaves.append(leaf)
        flags = end - start
        if data[end - 1] == NEWLINE or end == len(data):
            flags |= END_PARAGRAPH
            paragraphs.append(digest(b"p" + b"".join(leaves)))
            leaves = []
            if end - start == 1 and data[end - 1] == NEWLINE or not paragraphs[-1][-1] & SECTION_MASK or end == len(data):
                flags |= END_SECTION
                sections.append(digest(b"s" + b"".join(paragraphs)))
                paragraphs = []
        records += leaf[:4] + struct.pack(">H", flags)
        start = end
    return digest(b"r" + b"".join(sections)), bytes(records)


def fingerprint(text: str | bytes | None) -> str:
    """Fingerprint of a whole text; null counts as empty."""
    root, records = tree(text.encode() if isinstance(text, str) else text or b"")
    return f"{root.hex()}:{base64.b64encode(records).decode()}"


@dataclass(frozen=True)
class Leaf:
    digest: bytes
    size: int
    ends: int


def leaves(fp: str) -> list[Leaf]:
    data = base64.b64decode(fp.partition(":")[2])
    return [Leaf(data[i:i + 4], (n := struct.unpack_from(">H", data, i + 4)[0]) & MAX_LEAF, n & ~MAX_LEAF) for i in range(0, len(data), 6)]


def weights(fp: str) -> Counter:
    """How often each leaf (digest and length) is in a fingerprint."""
    data = base64.b64decode(fp.partition(":")[2])
    return Counter([data[i:i + 4] + struct.pack(">H", struct.unpack_from(">H", data, i + 4)[0] & MAX_LEAF) for i in range(0, len(data), 6)])


def likeness(a: str, b: str, of_a: Counter | None = None, of_b: Counter | None = None) -> float:
    """Bytes in common leaves by bytes in either text's leaves, 1 for equal roots (so for two empty texts)."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return 1.0
    of_a, of_b = of_a or weights(a), of_b or weights(b)
    size = lambda k: k[4] << 8 | k[5]
    both = sum(min(n, of_b[k]) * size(k) for k, n in of_a.items() if k in of_b)
    total = sum(n * size(k) for k, n in of_a.items()) + sum(n * size(k) for k, n in of_b.items()) - both
    return both / total if total else 1.0


def branches(fp: str) -> list[list[list[Leaf]]]:
    """Sections, their paragraphs, and their leaves."""
    sections: list[list[list[Leaf]]] = [[[]]]
    for leaf in leaves(fp):
        sections[-1][-1].append(leaf)
        if leaf.ends & END_SECTION:
            sections.append([[]])
        elif leaf.ends & END_PARAGRAPH:
            sections[-1].append([])
    return [[p for p in s if p] for s in sections if any(s)]


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Byte ranges of the first text whose branches the second has not: found section by section, then by paragraph, then by leaf."""
    if a.partition(":")[0] == b.partition(":")[0]:
        return []
    name = lambda x: x.digest if isinstance(x, Leaf) else digest(b"".join(map(name, x)))
    length = lambda x: x.size if isinstance(x, Leaf) else sum(map(length, x))
    other = branches(b)
    known = [{name(s) for s in other}, {name(p) for s in other for p in s}, {x.digest for s in other for p in s for x in p}]
    out: list[tuple[int, int]] = []

    def walk(nodes: list, level: int, at: int) -> None:
        for node in nodes:
            size = length(node)
            if name(node) not in known[level]:
                if level < 2:
                    walk(node, level + 1, at)
                elif out and out[-1][1] == at:
                    out[-1] = (out[-1][0], at + size)
                else:
                    out.append((at, at + size))
            at += size

    walk(branches(a), 0, 0)
    return out


def add_fingerprint(docs: DataFrame, *, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text; a column named ``out`` is replaced."""
    @F.udf("string", useArrow=True)
    def make(t):
        return fingerprint(t)

    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()], make(F.col(text)).alias(out))


EDITED = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def with_edits(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited form, whose last quarter gives way to the start of the next document.

    The next document is the one with the next greater key; after the last comes the first. Null keys count as the smallest
    number; rows of one key follow each other by text. Null texts are empty. A single row is its own next.

    The texts are dealt once, to ranges of keys and of the texts' first seven bytes, as a number, so rows of one key are split
    where their texts begin differently. A first pass over both numbers finds where ranges begin: 16 bytes for each ``ROWS_PER_BUCKET`` rows go to the
    tasks, which search them by halves. Every range is a partition of its own. The row that opens a range also goes to the
    range before it, so every row meets its next one in its own task. Rows stream through a task in order; no more than two
    texts are held.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("k"), F.conv(F.rpad(F.hex(F.substring(body.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long").alias("h"),
                       F.col(f"`{key}`").alias("own"), body.alias("t"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS_PER_BUCKET + 1)
    firsts = rows.select("k", "h").repartitionByRange(n, "k", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("k", "h")).alias("first"))
    heads = np.sort(np.array([tuple(r[0]) for r in firsts.select("first").collect()] or [(0, 0)], PAIR))

    @F.pandas_udf("struct<b: int, opens: boolean>")
    def place(k: pd.Series, h: pd.Series) -> pd.DataFrame:
        pairs = np.empty(len(k), PAIR)
        pairs["k"], pairs["h"] = k.to_numpy(), h.to_numpy()
        b = np.searchsorted(heads, pairs, side="right") - 1
        return pd.DataFrame({"b": b.astype(np.int32), "opens": heads[b] == pairs})

    at, before = F.col("at.b"), F.pmod(F.col("at.b") - 1, F.lit(len(heads)))
    here, ahead = F.struct(at.alias("b"), F.lit(0).alias("ahead")), F.struct(before.alias("b"), F.lit(1).alias("ahead"))
    places = F.when(F.col("at.opens"), F.array(here, ahead)).otherwise(F.array(here))
    dealt = (rows.withColumn("at", place("k", "h")).select("k", "h", "own", "t", F.explode(places).alias("p"))
             .select(F.col("p.b").alias("b"), F.col("p.ahead").alias("ahead"), "k", "h", "own", "t")
             .repartitionById(len(heads), "b").sortWithinPartitions("b", "ahead", "k", "h", "t"))
    schema = f"`{key}` {kind}, {EDITED}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in edits((r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True))):
            held.append(row)
            if len(held) >= 256:
                yield as_batch(held, arrow)
                held = []
        if held:
            yield as_batch(held, arrow)

    return dealt.mapInArrow(run, schema)


def edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (range, whether from the range ahead, key, text) in order: every row of a range with its next."""
    before = None
    closed = None
    for b, ahead, key, text in rows:
        if closed == b:
            continue
        fp = fingerprint(text)
        of = weights(fp)
        if before and before[0] == b:
            _, own_key, own, own_fp, own_of = before
            n = len(own)
            edited = own[:n - n // 4] + text[:n // 4]
            edited_fp = fingerprint(edited)
            yield (own_key, n, hashlib.sha256(edited.encode()).hexdigest(), own_fp, edited_fp, likeness(own_fp, edited_fp, own_of),
                   likeness(own_fp, fp, own_of, of))
        before = (b, key, text, fp, of)
        if ahead:
            before, closed = None, b
