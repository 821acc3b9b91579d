"""How filters of texts interact: what each removes in every order, on its own, and in vain.

Duplicates are found by radix tries of whole texts. Every task inserts its texts into compressed tries whose terminals hold
the smallest id, so that of equal texts only one leaves a task; the others are decided there. What is left is dealt by
ranges of text prefixes, whose borders adapt to the texts (quantiles of a sample of prefixes; texts with one prefix are
told apart by a hash, so that no common beginning fills a range). The tries of the ranges hold each text's smallest id of
the whole table, and a traversal flags the rest.

The outcome for any order follows from which filters a text fails, so one mask of bits for each text is all that is counted:
a few dozen numbers for each part, from which every order, step and Shapley value is a sum.
"""

import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import arrow, as_batch
from vitaloom.session import cut_lineage

FILTERS = "ABCDE"
SAME = 1 << FILTERS.index("E")
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 50, 65, 5, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
# Characters of a prefix that ranges are cut by, and bytes of text in a range's tries or held by a task at once.
PREFIX, RANGE_BYTES, HELD_BYTES = 64, 16 << 20, 32 << 20

ROWS = "id long, part string, mask int, n long, size long, text string"
MASKS = "id long, part string, mask int, n long, text string"
# What a node takes beside its bytes.
NODE_BYTES = 500


def failing(data: bytes, chars: int) -> int:
    """Bits of the filters that look at one text only."""
    words = data.split()
    mask = int(len(words) < LEAST_WORDS)
    mask |= (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
    mask |= (100 * (len(data) - len(data.translate(None, CAPITALS))) > CAPITAL_PERCENT * chars) << 2
    return mask | (len(data) != len(data.translate(None, MARKS))) << 3


class Node:
    """A node of a compressed trie: the bytes on the edge to it, its children by their first byte, what ends here."""

    __slots__ = ("label", "children", "end")

    def __init__(self, label: bytes):
        self.label, self.children, self.end = label, {}, None


def shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` stand in ``b`` from ``at`` on."""
    low, high = 0, min(len(a), len(b) - at)
    if b.startswith(a[:high], at):
        return high
    while low < high - 1:
        mid = (low + high) // 2
        if b.startswith(a[low:mid], at + low):
            low = mid
        else:
            high = mid
    return low


class Trie:
    """Texts as paths from the root; a path of nodes with one way on is one node."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def insert(self, text: bytes) -> Node:
        """The node where ``text`` ends, made if there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.size += len(text) - at + NODE_BYTES
                return child
            same = shared(child.label, text, at)
            if same < len(child.label):
                upper = Node(child.label[:same])
                self.size += NODE_BYTES
                child.label = child.label[same:]
                upper.children[child.label[0]] = child
                node.children[text[at]] = child = upper
            node, at = child, at + same
        return node

    def ends(self) -> Iterator[tuple[bytes, Node]]:
        """Every text and its node."""
        stack = [(b"", self.root)]
        while stack:
            before, node = stack.pop()
            text = before + node.label
            if node.end is not None:
                yield text, node
            stack.extend((text, c) for c in node.children.values())


def batched(rows, schema: pa.Schema):
    """Tuples of ``rows`` in batches of bounded size, whatever the lengths of their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in rows(batches):
            out.append(row)
            size += len(row[-1] or "")
            if len(out) >= 4096 or size >= 4 << 20:
                yield as_batch(out, schema)
                out, size = [], 0
        if out:
            yield as_batch(out, schema)
    return run


def local(held: int):
    """One row of each different text of a task with its smallest id (``text`` set), and rows of what is decided (not set).

    Rows with the smallest id are summed up by part; all others have an equal text with a smaller id. Full tries leave early.
    """
    def leave(trie: Trie) -> Iterator[tuple]:
        for text, node in trie.ends():
            least, mask, parts = node.end
            whole = text.decode()
            yield from ((least, part, mask, n, len(text), whole) for part, n in parts.items())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie = Trie()
        for batch in batches:
            for id_, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                if id_ is None:
                    yield None, part, failing(data, len(text)), 1, 0, None
                    continue
                node = trie.insert(data)
                if node.end is None:
                    node.end = [id_, failing(data, len(text)), {part: 1}]
                else:
                    least, mask, parts = node.end
                    if id_ > least:
                        yield id_, part, mask | SAME, 1, 0, None
                    elif id_ == least:
                        parts[part] = parts.get(part, 0) + 1
                    else:
                        yield from ((least, p, mask | SAME, n, 0, None) for p, n in parts.items())
                        node.end = [id_, mask, {part: 1}]
                if trie.size >= held:
                    yield from leave(trie)
                    trie = Trie()
        yield from leave(trie)

    return rows


def ranged(held: int):
    """Masks of the texts of a range, flagged where the range's tries know a smaller id of the same text.

    Rows come in the order of their prefix and hash, so a full trie may leave wherever the hash changes.
    """
    def leave(trie: Trie) -> Iterator[tuple]:
        for _, node in trie.ends():
            least = min(row[0] for row in node.end)
            yield from ((i, part, mask | SAME * (i > least), n) for i, part, mask, n in node.end)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        trie, last = Trie(), None
        for batch in batches:
            for id_, part, mask, n, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != last and trie.size >= held:
                    yield from leave(trie)
                    trie = Trie()
                last = h
                node = trie.insert(text.encode())
                node.end = node.end or []
                node.end.append((id_, part, mask, n))
        yield from leave(trie)

    return lambda batches: (row + (None,) for row in rows(batches))


def masks(docs: DataFrame, *, key: str, text: str, part: str, prefix: int = PREFIX, range_bytes: int = RANGE_BYTES, held: int = HELD_BYTES) -> DataFrame:
    """``id, part, mask, n``: which filters the rows fail; equal rows (or rows of equal id, text and part) may be summed up in ``n``."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = cut_lineage(rows.mapInArrow(batched(local(held), arrow(ROWS)), ROWS), "texts")
    decided, left = first.where("text IS NULL"), first.where("text IS NOT NULL")
    total = first.agg(F.sum("size")).first()[0] or 0
    ranges = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(total / range_bytes))
    border = [F.substring("text", 1, prefix), F.col("h")]
    dealt = left.select("id", "part", "mask", "n", "text", F.xxhash64("text").alias("h")).repartitionByRange(ranges, *border).sortWithinPartitions(*border)
    flagged = dealt.mapInArrow(batched(ranged(held), arrow(MASKS)), MASKS)
    columns = ["id", "part", "mask", "n"]
    return decided.select(*columns).unionByName(flagged.select(*columns))


def audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source", prefix: int = PREFIX,
          range_bytes: int = RANGE_BYTES, held: int = HELD_BYTES) -> DataFrame:
    """Counts for each part, each of the 120 orders of the five filters and each step of it.

    A text fails A with under 50 words, B with fewer than 65 % distinct words, C with over 5 % of capitals A-Z, D with any of
    ``#$%&*|``, E if a row with a smaller id has the same text, anywhere in the table and removed or not. Counts of the part:
    ``kept`` after the step, ``removed`` in it, ``redundant`` (fails the step's filter, was removed before), ``unique_fails``
    (fails this filter only), ``good_lost`` and ``toxic_lost`` (removed in the step, labelled quality 1 or toxic 1), ``shapley``
    (removed by the step's filter at any step, summed over all orders).

    Null texts are empty ones and null parts the empty string. Rows without an id have no smaller and no larger row, so they
    neither fail E nor make others fail, and have no labels. Repeated rows count each; they fail E only by a smaller id. A
    row is labelled 1 if any label row of its id says so. Other columns are not read; an empty table has no parts.
    """
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"))
    rows = masks(docs, key=key, text=text, part=part, prefix=prefix, range_bytes=range_bytes, held=held).join(known, "id", "left")
    counts = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
                                              F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = (parts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
             .withColumn("bit", F.expr(bit_at("step")))
             .withColumn("before", F.expr(f"aggregate(sequence(0, step - 1), 0, (a, i) -> if(i = 0, a, a | {bit_at('i')}))")))
    total = lambda what, where: F.expr(f"aggregate(counts, 0L, (a, c) -> a + if({where}, {what}, 0L))")
    fails, still = "c.mask & bit <> 0", "c.mask & before = 0"
    return steps.select(
        "part", "filter_order", "step", total("c.n", "c.mask & (before | bit) = 0").alias("kept"), total("c.n", f"{fails} AND {still}").alias("removed"),
        total("c.n", f"{fails} AND c.mask & before <> 0").alias("redundant"), total("c.n", "c.mask = bit").alias("unique_fails"),
        total("c.good", f"{fails} AND {still}").alias("good_lost"), total("c.toxic", f"{fails} AND {still}").alias("toxic_lost"),
        # In one order of every `bit_count(mask)` the filter is the first that the text fails.
        total(f"c.n * {len(orders)}L div bit_count(c.mask)", fails).alias("shapley"))


def bit_at(i: str) -> str:
    """The bit of the filter at a place of the order."""
    return f"shiftleft(1, ascii(substring(filter_order, {i}, 1)) - {ord(FILTERS[0])})"
