"""Exact best inner products of integer vectors, block at a time.

Vectors are documents whose terms are their components. The index is a table of document-range blocks: rows in the order
of a coarse cell (the nearest of a bounded sample of vectors) and then of the id, cut every ``BLOCK`` rows. A block holds
its forward index (its vectors as one matrix) and the largest and smallest component of each term. For a query the terms'
maxima, or minima where the query is negative, times the query's components sum up to a bound on every score in the block.

Queries travel in chunks and blocks in groups, each of bounded size; one of each is a visit, the unit of work:

1. Every chunk meets the summaries of all groups (two vectors each). A query first visits the group with its highest bound.
2. In a visit each query takes the blocks in falling order of their bounds and scores them through their forward index,
   until the bounds fall below its k-th best score. The first visit gives a score that a query's best rows surely reach.
3. Every other group whose bound reaches that score is visited in the same way, starting from it. A group that no query of
   a chunk can use is never sent to it.

A bound equal to the k-th score reaches it only if the block has a smaller id, since ties go to the smaller id; so a vector
that very many rows repeat is read for its smallest ids only. Products run in single or double precision only where no sum
can lose a bit, else in whole numbers.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitaloom.llm.common import arrow, as_batch
from vitaloom.session import cut_lineage

TOP = 20
SCALE = 64
# Rows of a block, blocks of a group, queries of a chunk, summaries that travel together.
BLOCK, GROUP, CHUNK, PACK = 256, 16, 1024, 512
# Components in a block or a chunk at most, whatever the length of the vectors (but one vector is always whole).
CELLS = 1 << 18
# Vectors by which rows are ordered: a bounded sample that only decides which rows are neighbours.
PIVOTS = 64
# Visits of a task where there are more than a few for each core, and the number of tasks that a driver plans with ease.
VISITS_OF_TASK, MOST_TASKS = 64, 50_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1

ROW = "id long, dims int, cell int, w binary"
GROUPS = "gid long, dims int, hi binary, lo binary, least long, blocks array<struct<ids: binary, w: binary, hi: binary, lo: binary>>"
CHUNKS = "chunk long, dims int, ids binary, w binary"
VISIT = "chunk long, gid long, go binary, kth binary, kth_id binary"
BEST = "chunk long, q int, query_id long, own long, gid long, scores array<long>, ids array<long>"


def pack(m: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 1, 2, 4 and 8 bytes; the first byte tells which. The widest are doubles."""
    top = np.abs(m).max(initial=0)
    kind = next((k for k in "bhi" if top <= np.iinfo(k).max), "d")
    return kind.encode() + m.astype(kind).tobytes()


def unpack(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, data[:1].decode(), offset=1).reshape(-1, dims).astype(np.float64) if dims else np.zeros((0, 0))


def products(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers; beyond their range its ends."""
    m = min(q.shape[1], w.shape[1])
    q, w = q[:, :m], w[:, :m]
    most = np.abs(q).max(initial=0) * np.abs(w).max(initial=0) * m
    if most < 1 << 24:
        return (q.astype(np.float32) @ w.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (q @ w.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in a], object).reshape(len(a), m) for a in (q, w)]
    out = np.zeros((len(q), len(w)), object) if not m else whole[0] @ whole[1].T
    return np.array([[min(max(int(x), LOW), HIGH) for x in row] for row in out], np.int64).reshape(len(q), len(w))


def bounds(q: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """For each query the summed term maxima of each row of ``hi`` and ``lo``, never too low."""
    m = min(q.shape[1], hi.shape[1])
    q, hi, lo = q[:, :m], hi[:, :m], lo[:, :m]
    at_most = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    widest = np.maximum(np.abs(hi), np.abs(lo))
    if np.abs(q).max(initial=0) * widest.max(initial=0) * m >= 1 << 53:
        at_most += 1e-9 * (np.abs(q) @ widest.T)
    return at_most


class Tops:
    """The best ``k`` rows of each of ``n`` queries so far, by score and then smaller id."""

    def __init__(self, n: int, k: int, kth: np.ndarray | None = None, kth_id: np.ndarray | None = None):
        self.k = k
        self.q = np.zeros(0, np.int64)
        self.score, self.id = self.q, self.q
        # What a row must beat; nothing beats the floor that an earlier visit gave but is no row of this one.
        self.kth = np.full(n, LOW, np.int64) if kth is None else kth.copy()
        self.kth_id = np.full(n, HIGH, np.int64) if kth_id is None else kth_id.copy()

    def reach(self, at_most: np.ndarray, least: np.ndarray, q) -> np.ndarray:
        """Whether something with these bounds and smallest ids can still be among the best of the queries ``q``."""
        kth = self.kth[q].astype(np.float64)
        return (at_most > kth) | (at_most == kth) & (least <= self.kth_id[q])

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries ``q`` (rows) with the documents ``ids`` (columns)."""
        kth = self.kth[q][:, None]
        row, col = np.nonzero((score > kth) | (score == kth) & (ids[None, :] <= self.kth_id[q][:, None]))
        q_all = np.concatenate([self.q, q[row]])
        s_all, i_all = np.concatenate([self.score, score[row, col]]), np.concatenate([self.id, ids[col]])
        order = np.lexsort((i_all, ~s_all, q_all))
        q_all = q_all[order]
        first = np.searchsorted(q_all, q_all)
        rank = np.arange(len(q_all)) - first
        self.q, self.score, self.id = (a[rank < self.k] for a in (q_all, s_all[order], i_all[order]))
        last = np.nonzero(rank == self.k - 1)[0]
        self.kth[q_all[last]], self.kth_id[q_all[last]] = s_all[order][last], i_all[order][last]

    def rows(self) -> Iterator[tuple[int, list[int], list[int]]]:
        # A later visit may find nothing: the floor it starts from can lie above all that the group holds.
        ends = np.append(np.nonzero(np.diff(self.q, prepend=-1))[0], len(self.q))
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield int(self.q[a]), self.score[a:b].tolist(), self.id[a:b].tolist()


def visit(queries: np.ndarray, active: np.ndarray, tops: Tops, dims: int, blocks: list[dict]) -> None:
    """Each of the ``active`` queries scores the blocks of a group in the order of its bounds, until they fall short."""
    hi, lo = (np.concatenate([unpack(b[c], dims) for b in blocks]) for c in ("hi", "lo"))
    ids = [np.frombuffer(b["ids"], np.int64) for b in blocks]
    least = np.array([i.min() for i in ids])
    w: list = [None] * len(blocks)
    at_most = bounds(queries[active], hi, lo)
    order = np.lexsort((np.broadcast_to(least, at_most.shape), -at_most), axis=1)
    for turn in range(len(blocks)):
        chosen = order[:, turn]
        at = at_most[np.arange(len(active)), chosen]
        able = tops.reach(at, least[chosen], active)
        for b in np.unique(chosen[able]):
            q = active[able & (chosen == b)]
            if w[b] is None:
                w[b] = unpack(blocks[b]["w"], dims)
            tops.add(q, products(queries[q], w[b]), ids[b])


def dealt(visits: DataFrame, n: int) -> DataFrame:
    """Visits over as many tasks as are worth it: their rows are small and their work is not, so sizes would merge them."""
    cores = visits.sparkSession.sparkContext.defaultParallelism
    return visits.repartition(min(max(n, 1), max(4 * cores, n // VISITS_OF_TASK), MOST_TASKS), "chunk", "gid")


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, v``: the vectors that take part, as doubles that are whole numbers."""
    whole = F.transform(F.col(vector), lambda x: x.cast("double") * scale)
    whole = F.transform(whole, lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v"))
    return rows.where(F.forall("v", lambda y: F.coalesce(F.abs(y) < float("inf"), F.lit(False))))


def direction(v: np.ndarray) -> np.ndarray:
    v = v / max(np.abs(v).max(initial=0), 1)
    return v / max(float(np.sqrt(v @ v)), 1e-300)


def placed(pivots: list[np.ndarray]):
    """Rows with their cell, the pivot of the smallest angle, and their components packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, v in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                v, cell, best = np.asarray(v, np.float64), 0, -np.inf
                unit = direction(v)
                for c, p in enumerate(pivots):
                    m = min(len(p), len(v))
                    if (at := float(p[:m] @ unit[:m])) > best:
                        cell, best = c, at
                out.append((id_, len(v), cell, pack(v)))
            for at in range(0, len(out), 2048):
                yield as_batch(out[at:at + 2048], pa.schema([("id", pa.int64()), ("dims", pa.int32()), ("cell", pa.int32()), ("w", pa.binary())]))
    return run


def runs(batches: Iterator[pa.RecordBatch], rows_of, most) -> Iterator[tuple[int, list]]:
    """Neighbouring rows of equal ``dims``, ``most(dims)`` at a time."""
    held: list = []
    dims = -1
    for batch in batches:
        for d, row in rows_of(batch):
            if held and (d != dims or len(held) >= most(dims)):
                yield dims, held
                held = []
            dims = d
            held.append(row)
    if held:
        yield dims, held


def fits(rows: int):
    return lambda dims: max(1, min(rows, CELLS // max(dims, 1)))


def number(at: int) -> int:
    """A number that no other task of the stage gives; the table is written before the numbers are used."""
    return TaskContext.get().partitionId() << 32 | at


def grouped(block_rows: int, group_blocks: int, schema: pa.Schema):
    """Groups of blocks, from rows in index order."""
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        rows_of = lambda batch: ((d, (i, w)) for i, d, w in zip(*(batch.column(c).to_pylist() for c in ("id", "dims", "w")), strict=True))
        for dims, rows in runs(batches, rows_of, fits(block_rows)):
            rows.sort(key=lambda r: r[0])
            ids = np.array([r[0] for r in rows], np.int64)
            m = np.concatenate([unpack(w, dims) for _, w in rows]) if dims else np.zeros((len(rows), 0))
            yield dims, (ids, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        # `runs` cuts blocks into groups as it cuts rows into blocks.
        for dims, held in runs(([b] for b in blocks(batches)), lambda one: one, lambda _: group_blocks):
            parts = [{"ids": i.tobytes(), "w": pack(m), "hi": pack(m.max(axis=0)), "lo": pack(m.min(axis=0))} for i, m in held]
            hi, lo = np.max([m.max(axis=0) for _, m in held], axis=0), np.min([m.min(axis=0) for _, m in held], axis=0)
            yield as_batch([(number(at), dims, pack(hi), pack(lo), int(min(i.min() for i, _ in held)), parts)], schema)
            at += 1
    return run


def queries_of(every: int, chunk_rows: int, schema: pa.Schema):
    """Chunks of the rows that are queries, in index order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of(batch):
            for dims, blocks in zip(batch.column("dims").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                for b in blocks:
                    ids = np.frombuffer(b["ids"], np.int64)
                    asked = np.nonzero(ids % every == 0)[0]
                    w = unpack(b["w"], dims) if dims else np.zeros((len(ids), 0))
                    for i in asked:
                        yield dims, (ids[i], w[i])
        for at, (dims, held) in enumerate(runs(batches, rows_of, fits(chunk_rows))):
            ids, m = np.array([i for i, _ in held], np.int64), np.array([w for _, w in held]).reshape(len(held), dims)
            yield as_batch([(number(at), dims, ids.tobytes(), pack(m))], schema)
    return run


def asked_queries(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, unpack(row["w"], row["dims"]) if row["dims"] else np.zeros((len(ids), 0))


def each(function, schema: pa.Schema):
    """``function`` of each row as a dict; its tuples in batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rows = list(function(batch.slice(at, 1).to_pylist()[0]))
                for i in range(0, len(rows), 1024):
                    yield as_batch(rows[i:i + 1024], schema)
    return run


def highest(row: dict) -> Iterator[tuple]:
    """For each query of a chunk the group of a pack with its highest bound."""
    _, q = asked_queries(row)
    best, gid = np.full(len(q), -np.inf), np.zeros(len(q), np.int64)
    for g in row["groups"]:
        at_most = bounds(q, unpack(g["hi"], g["dims"]), unpack(g["lo"], g["dims"]))[:, 0] if g["dims"] else np.zeros(len(q))
        better = at_most > best
        best[better], gid[better] = at_most[better], g["gid"]
    yield from ((row["chunk"], i, float(best[i]), int(gid[i])) for i in range(len(q)))


def needed(row: dict) -> Iterator[tuple]:
    """Groups of a pack that can still hold one of a query's best rows: ``chunk, gid`` and the queries with their floors."""
    _, q = asked_queries(row)
    tops, seen = Tops(len(q), 1), np.zeros(len(q), np.int64)
    for f in row["floors"]:
        tops.kth[f["q"]], tops.kth_id[f["q"]], seen[f["q"]] = f["kth"], f["kth_id"], f["gid"]
    every = np.arange(len(q))
    for g in row["groups"]:
        at_most = bounds(q, unpack(g["hi"], g["dims"]), unpack(g["lo"], g["dims"]))[:, 0] if g["dims"] else np.zeros(len(q))
        go = np.nonzero((seen != g["gid"]) & tops.reach(at_most, np.full(len(q), g["least"]), every))[0]
        if len(go):
            yield row["chunk"], g["gid"], go.tobytes(), tops.kth[go].tobytes(), tops.kth_id[go].tobytes()


def visited(k: int):
    """The best rows of a group for the queries that visit it."""
    def run(row: dict) -> Iterator[tuple]:
        ids, q = asked_queries(row)
        active = np.frombuffer(row["go"], np.int64)
        tops = Tops(len(q), k)
        if row["kth"] is not None:
            tops.kth[active], tops.kth_id[active] = np.frombuffer(row["kth"], np.int64), np.frombuffer(row["kth_id"], np.int64)
        if row["gdims"]:
            visit(q, active, tops, row["gdims"], row["blocks"])
        else:  # vectors without components
            for b in row["blocks"]:
                tops.add(active, np.zeros((len(active), len(b["ids"]) // 8), np.int64), np.frombuffer(b["ids"], np.int64))
        for i, scores, found in tops.rows():
            yield row["chunk"], i, int(ids[i]), int(products(q[i:i + 1], q[i:i + 1])[0, 0]), row["gid"], scores, found
    return run


def search(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = TOP, every: int = 20, scale: int = SCALE,
           block_rows: int = BLOCK, group_blocks: int = GROUP, chunk_rows: int = CHUNK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows with the highest inner product for every row whose id ``every`` divides.

    Components count as ``floor(scale * x)``. A query's own row is no candidate, other rows with its id are. Ties go to the
    smaller id; with fewer candidates than ``k`` all are returned. Vectors that are null or hold a null or non-finite
    component (also after scaling) take no part, nor do rows without an id. Of vectors of different lengths the shorter
    counts as filled up with zeros. Repeated rows are candidates, and queries, of their own. Scores beyond a long's range
    count as its ends. Other columns are not read; an empty table has no result.
    """
    base = cut_lineage(integers(vectors, key, vector, scale), "vectors")
    rows = base.count()
    sample = base.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOTS).collect()
    pivots = [p for p in (direction(np.array(r["v"], np.float64)) for r in sample) if p.any()]
    parts = max(1, -(-rows // (block_rows * group_blocks)))
    ordered = base.mapInArrow(placed(pivots), ROW).repartitionByRange(parts, "dims", "cell", "id").sortWithinPartitions("dims", "cell", "id")
    groups = cut_lineage(ordered.mapInArrow(grouped(block_rows, group_blocks, arrow(GROUPS)), GROUPS), "groups")
    chunks = cut_lineage(groups.mapInArrow(queries_of(every, chunk_rows, arrow(CHUNKS)), CHUNKS), "chunks")
    n_packs = max(1, -(-groups.count() // PACK))
    pack_of = F.pmod(F.xxhash64("gid"), F.lit(n_packs))
    packs = groups.select(pack_of.alias("pack"), F.struct("gid", "dims", "hi", "lo", "least").alias("g")).groupBy("pack").agg(F.collect_list("g").alias("groups"))
    spread = chunks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1)).cast("array<long>")))
    # First visit: the group of the highest bound.
    first = (spread.join(packs, "pack").mapInArrow(each(highest, arrow("chunk long, q int, at_most double, gid long")), "chunk long, q int, at_most double, gid long")
             .groupBy("chunk", "q").agg(F.max_by("gid", F.struct("at_most", "gid")).alias("gid"))
             .groupBy("chunk", "gid").agg(F.sort_array(F.collect_list(F.col("q").cast("long"))).alias("qs")))
    content = groups.select("gid", F.col("dims").alias("gdims"), "blocks")
    go = cut_lineage(first.mapInArrow(each(lambda r: [(r["chunk"], r["gid"], np.array(r["qs"], np.int64).tobytes(), None, None)], arrow(VISIT)), VISIT), "first")

    def scored(visits: DataFrame) -> DataFrame:
        return dealt(visits.join(chunks, "chunk").join(content, "gid"), visits.count()).mapInArrow(each(visited(k + 1), arrow(BEST)), BEST)

    seeds = cut_lineage(scored(go), "seeds")
    # Later visits: what still reaches the floor that the first one gave. With fewer rows than k there is none.
    enough = F.size("scores") > k
    floors = seeds.groupBy("chunk").agg(F.collect_list(F.struct(
        "q", "gid", F.when(enough, F.element_at("scores", -1)).otherwise(F.lit(LOW)).alias("kth"),
        F.when(enough, F.element_at("ids", -1)).otherwise(F.lit(HIGH)).alias("kth_id"))).alias("floors"))
    more = cut_lineage(spread.join(floors, "chunk").join(packs, "pack").mapInArrow(each(needed, arrow(VISIT)), VISIT), "visits")
    found = seeds.unionByName(scored(more)).select("chunk", "q", "query_id", "own", F.explode(F.arrays_zip("scores", "ids")).alias("x"))
    found = found.select("chunk", "q", "query_id", "own", F.col("x.scores").alias("score"), F.col("x.ids").alias("vec_id"))
    order = Window.partitionBy("chunk", "q").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own"))
    owns = F.sum(own.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    best = best.withColumn("owns", owns).where(~(own & (F.col("owns") == 1)))
    return best.select("query_id", (F.col("rank") - F.least("owns", F.lit(1))).cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

