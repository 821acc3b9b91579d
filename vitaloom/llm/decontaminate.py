"""Benchmark passages in documents, found up to a number of edits.

With an error budget of ``k`` edits a test item is split into ``k + 1`` pieces: a passage within the budget holds at
least one piece unchanged (pigeonhole). All pieces are looked up at once in every whole text, and where one occurs the
whole item is verified around it by Myers' bit-parallel edit distance.

Texts are compared in a normal form: lower case, words separated by one blank. The query set (the benchmark) goes to
the tasks in blocks of at most ``BLOCK_CHARS`` characters, each with one narrow pass over the documents, so what is
shipped is bounded however large the benchmark is. Nothing is shuffled, and no text or item can be hot.
"""

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import map_rows, spare

ERROR_RATE = 0.06
# Items shorter than this in normal form are found unedited and as whole words only.
SHORT_CHARS = 24
BLOCK_CHARS = 1_000_000
WORD = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(WORD.findall(text.lower())) if text else ""


def budget(item: str, rate: float) -> int:
    return int(rate * len(item)) if len(item) >= SHORT_CHARS else 0


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item in ``edits + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(item: str, text: str) -> int:
    """Smallest number of edits that turns ``item`` into some part of ``text``, one machine word operation a column.

    Bit i of ``up`` / ``down`` says that row i + 1 of the current column is one more / one less than row i.
    """
    n = len(item)
    if not n:
        return 0
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        where[c] |= 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = mask, 0, n
    best = score
    for c in text:
        same = where.get(c, 0)
        vertical = same | down
        diagonal = (((same & up) + up) ^ up) | same
        right_up = down | ~(diagonal | up)
        right_down = up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up, right_down = right_up << 1, right_down << 1
        up = (right_down | ~(vertical | right_up)) & mask
        down = right_up & vertical & mask
        if score < best:
            best = score
    return best


class Finder:
    """The pieces of one block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = items
        self.edits = [budget(s, rate) for _, s in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, s) in enumerate(items):
            if len(s) < SHORT_CHARS:
                places[f" {s} "].append((n, -1))
            else:
                for at, piece in pieces(s, self.edits[n]):
                    places[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def hits(self, text: str | None) -> Iterator[tuple[int, int]]:
        """Items in a text and their smallest number of edits."""
        text = f" {normal(text)} "
        if not self.items:
            return
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, found) in self.automaton.iter(text):
            for n, at in found:
                starts[n].add(end + 1 - size - at)
        for n in sorted(starts):
            key, item = self.items[n]
            k = self.edits[n]
            best = k + 1
            for lo, hi in windows(sorted(starts[n]), len(item), k):
                part = text[max(lo, 0):hi]
                best = min(best, 0 if item in part else distance(item, part))
                if not best:
                    break
            if best <= k:
                yield key, best


def windows(starts: list[int], size: int, edits: int) -> Iterator[tuple[int, int]]:
    """Stretches of text to verify: overlapping ones become one, so their total length stays that of the text."""
    lo = hi = None
    for s in starts:
        a, b = s - edits, s + size + edits
        if hi is not None and a <= hi:
            hi = b
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The query set in blocks of bounded size. Items without a word are in none: they match nothing."""
    held, size = [], 0
    for r in items.select(key, text).orderBy(key, text).toLocalIterator():
        s = normal(r[text])
        if not s:
            continue
        if held and size + len(s) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((r[key], s))
        size += len(s)
    if held:
        yield held


def finder(block: list[tuple[int, str]], rate: float, cache: dict = {}) -> Finder:  # noqa: B006 - one for each worker process
    known = cache.get("last")
    if known is None or known[0] != (block, rate):
        known = cache["last"] = ((block, rate), Finder(block, rate))
    return known[1]


def find(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
         rate: float = ERROR_RATE) -> DataFrame:
    """One row for each document and item that is in it: ``key, item_id, edits, allowed``.

    A key of the documents that has one of the other names keeps it, and that other column gets an underscore.

    Null and empty texts hold nothing; repeated documents are reported each, repeated items under each of their keys.
    Other columns of either table are not looked at. No document or no item gives no row.
    """
    keys = docs.select(F.col(f"`{key}`"))
    item, edits_name, allowed_name = spare(keys, "item_id", "edits", "allowed")
    schema = (f"`{key}` {keys.schema[0].dataType.simpleString()}, {item} {items.schema[item_key].dataType.simpleString()}, "
              f"{edits_name} int, {allowed_name} int")
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, item_key, item_text):
        def rows(doc, t, block=block):
            f = finder(block, rate)
            allowed = dict(zip((k for k, _ in block), f.edits, strict=True))
            for item, edits in f.hits(t):
                yield doc, item, edits, allowed[item]

        out = out.unionByName(map_rows(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), rows, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the rows that hold an item; null and empty texts stay. Columns stay as they are."""
    for block in blocks(items, item_key, item_text):
        docs = docs.where(~holds(F.col(text), block, rate))
    return docs


def holds(text: Column, block: list[tuple[int, str]], rate: float) -> Column:
    """Whether a text holds an item of the block."""
    @F.pandas_udf("boolean")
    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = finder(block, rate)
        for batch in batches:
            yield pd.Series([any(True for _ in f.hits(t)) for t in batch], dtype=bool)

    return held(text)
