"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file compiles to three transducers: the normaliser (dummy prefix, blank to meta symbol), the piece lexicon (a
trie whose accepting states write piece ids), and byte fallback (every character the lexicon does not know writes its
UTF-8 bytes). Composed with one input they give a lattice whose arcs are pieces over spans of the input; its states are
positions. The encoding is the lattice's shortest path in the tropical semiring (weights add along a path, the smallest
sum wins).

* Unigram models: an arc weighs minus its piece's log-probability.
* BPE models: path sums of merge ranks do not give what the merges give, so the composition has one more machine, an
  acceptor of legal neighbours. A path is what merging produces exactly if every two neighbouring pieces, taken alone,
  would stay apart at this boundary; illegal neighbours weigh infinity, legal ones nothing. States become (position,
  last piece), and exactly one path is finite.

No piece holds a meta symbol after another character (nor, in most models, letters beside other characters), so every
path passes through those positions, and the lattice of a long text falls apart into the lattices of its words. Paths of words seen lately are
remembered, within a bound.
"""

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaloom.llm.common import without

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
# Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
REMEMBERED = 600_000
REMEMBERED_NEIGHBOURS = 300_000
# Words longer than this are encoded each time, so that what is remembered stays small.
REMEMBERED_CHARS = 64
WORD = re.compile(f"{META}*[^{META}]+|{META}+")
# The same, also apart where letters meet other characters.
LETTERS = re.compile(rf"{META}*[^\W\d_¹²³]+|{META}*(?:[\W\d_¹²³](?<!{META}))+|{META}+")


def proto(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        size = {0: None, 1: 8, 5: 4}.get(key & 7, -1)
        if size is None:
            yield key >> 3, varint()
            continue
        if size < 0:
            size = varint()
        yield key >> 3, data[at:at + size]
        at += size


class Transducer:
    """The compiled machines of one model file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.kind, self.prefix, self.squeeze, rules = UNIGRAM, True, True, b""
        for field, value in proto(model):
            if field == 1:
                piece = dict(proto(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                self.kind = dict(proto(value)).get(3, UNIGRAM)
            elif field == 3:
                spec = dict(proto(value))
                rules, self.prefix, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if rules or self.squeeze or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models whose normaliser keeps characters and blanks are compiled")
        if USER in self.kinds:
            raise ValueError("models with user-defined symbols are not compiled")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        if any(META in p.lstrip(META) for p in self.ids):
            raise ValueError("a piece has a meta symbol after another character")
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        # When pieces of a BPE model are made, and of what; pieces that merging never makes stay out of the lexicon.
        self.made: dict[str, float] = {}
        self.splits: dict[str, tuple[str, str]] = {}
        if self.kind == BPE:
            for piece, i in self.ids.items():
                if len(piece) > 1 and (pair := self.last_merge(piece)):
                    self.splits[piece], self.made[piece] = pair, -self.scores[i]
        # The lexicon as a trie: children by character, and the id written when a piece ends there.
        self.trie: dict = {}
        for piece, i in self.ids.items():
            if self.kind == BPE and len(piece) > 1 and piece not in self.splits:
                continue
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = piece
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        # No path crosses a boundary that no piece crosses.
        inside = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        crosses = any(len(LETTERS.findall(x)) > 1 for x in inside if x[0] != META)
        self.words = WORD if crosses else LETTERS
        self.written = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.encode()
                        for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.paths: dict[str, tuple[int, ...]] = {}
        self.neighbours: dict[tuple[str, str], bool] = {}

    # -- normaliser ------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        """Blanks become meta symbols, and one goes in front; the empty text stays empty."""
        return (META if self.prefix and text else "") + text.replace(" ", META)

    # -- acceptor of neighbours ----------------------------------------------------------------------------------------

    def last_merge(self, piece: str) -> tuple[str, str] | None:
        """The last merge on the way from characters to a piece; None if merging does not give this piece."""
        parts, pair = list(piece), None
        while len(parts) > 1:
            known = [(-self.scores[k], i) for i in range(len(parts) - 1) if (k := self.ids.get(parts[i] + parts[i + 1])) is not None]
            if not known:
                return None
            i = min(known)[1]
            pair = parts[i], parts[i + 1]
            parts[i:i + 2] = ["".join(pair)]
        return pair

    def legal(self, a: str, b: str) -> bool:
        """Whether pieces ``a`` and ``b`` stay apart where they meet.

        Going back in time, the later-made of the two pieces beside the boundary is taken apart. They would have merged
        across it if their union is a piece that is made before either went into something larger; of equally ranked
        merges the left one is made first.
        """
        known = self.neighbours.get((a, b))
        if known is not None:
            return known
        ids, made, splits = self.ids, self.made, self.splits
        x, y, until, tie = a, b, float("inf"), False
        while True:
            k = ids.get(x + y)
            if k is not None and (-self.scores[k] < until or tie and -self.scores[k] == until):
                result = False
                break
            time_x, time_y = made.get(x, -1.0), made.get(y, -1.0)
            if time_x < 0 and time_y < 0:
                result = True
                break
            if time_x > time_y:
                until, tie, x = time_x, False, splits[x][1]
            else:
                until, tie, y = time_y, True, splits[y][0]
        if len(self.neighbours) >= REMEMBERED_NEIGHBOURS:
            self.neighbours.clear()
        self.neighbours[a, b] = result
        return result

    # -- composition and shortest path -------------------------------------------------------------------------------

    def arcs(self, text: str, at: int) -> Iterator[tuple[int, str, float]]:
        """Arcs that leave a position of the composition: where to, the piece, and the weight."""
        node, end = self.trie, at
        single = False
        while end < len(text) and (node := node.get(text[end])) is not None:
            end += 1
            piece = node.get("")
            if piece is not None:
                single |= end == at + 1
                yield end, piece, -self.scores[self.ids[piece]]
        if not single:
            yield at + 1, text[at], -self.floor

    def shortest(self, text: str) -> list[str]:
        """Pieces on the shortest path through one word's lattice."""
        if self.kind == UNIGRAM:
            best: list[tuple[float, int]] = [(0.0, -1)] + [(float("inf"), -1)] * len(text)
            for at in range(len(text)):
                for end, _, weight in self.arcs(text, at):
                    if best[at][0] + weight < best[end][0]:
                        best[end] = (best[at][0] + weight, at)
            path, at = [], len(text)
            while at > 0:
                path.append(text[best[at][1]:at])
                at = best[at][1]
            return path[::-1]
        # Every beginning of the word has one encoding, so a position has one state of finite weight: its last piece.
        last: list[str | None] = [""] + [None] * len(text)
        for at in range(len(text)):
            before, node = last[at], self.trie
            if before is None:
                continue
            for end in range(at + 1, len(text) + 1):
                node = node.get(text[end - 1])
                if node is None:
                    break
                if last[end] is None and (piece := node.get("")) is not None and (not at or self.legal(before, piece)):
                    last[end] = piece
            if last[at + 1] is None and text[at] not in self.ids:
                last[at + 1] = text[at]
        path, at = [], len(text)
        while at:
            path.append(last[at])
            at -= len(last[at])
        return path[::-1]

    def path(self, word: str) -> tuple[int, ...]:
        ids: list[int] = []
        for piece in self.shortest(word):
            i = self.ids.get(piece)
            if i is not None:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in piece.encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; a null text has none, as the empty one."""
        out: list[int] = []
        paths = self.paths
        for word in self.words.findall(self.normalise(text or "")):
            ids = paths.get(word)
            if ids is None:
                ids = self.path(word)
                if len(word) <= REMEMBERED_CHARS:
                    if len(paths) >= REMEMBERED:
                        paths.clear()
                    paths[word] = ids
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer: pieces and bytes to text, the dummy prefix taken off. Control ids write nothing."""
        text = b"".join([self.written[i] for i in ids]).decode("utf-8", "replace").replace(META, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def compiled(model: bytes, cache: dict = {}) -> Transducer:  # noqa: B006 - one machine for each worker process
    if model not in cache:
        cache.clear()
        cache[model] = Transducer(model)
    return cache[model]


def encode(docs: DataFrame, model: bytes, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of every whole text. Null and empty texts have no ids. A column named ``ids`` is replaced."""
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = compiled(model)
        for batch in batches:
            yield pd.Series([np.array(machine.encode(t), np.int32) for t in batch], dtype=object)

    return without(docs, ids).withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, model: bytes, *, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add the text of a list of ids; null ids give null. A column named ``text`` is replaced."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = compiled(model)
        for batch in batches:
            yield pd.Series([None if v is None else machine.decode(v) for v in batch], dtype=object)

    return without(docs, text).withColumn(text, run(F.col(ids)))


def round_trip(docs: DataFrame, model: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, n_tokens, restored``: the encoding, and whether decoding it gives the text back, in one pass.

    Every text comes back, because the normaliser only marks blanks and every byte has an id; a text that has the meta
    symbol itself comes back with a blank in its place and is not ``restored``. Null counts as empty.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>, n_tokens int, restored boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found, same = [], []
                for t in part.column(1).to_pylist():
                    found.append(machine.encode(t))
                    same.append(machine.decode(found[-1]) == (t or ""))
                sizes = np.array([len(f) for f in found], np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate([np.array(f, np.int32) for f in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sizes), pa.array(same)],
                                                 names=[key, "ids", "n_tokens", "restored"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
