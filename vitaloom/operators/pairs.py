"""Scoring of resume x job pairs.

``match_pairs`` scores a given list of pairs in a grid of groups of resumes and
groups of jobs, so that vectors travel once to a cell and not with every pair.
``top_matches`` finds the exact best jobs of every resume in a whole catalogue
without building the pairs: jobs are grouped into cells around a few pivot
vectors, the angle to a pivot bounds the similarity to everything in its cell,
and a resume is sent only to cells that can still hold one of its best jobs.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructType

from vitaloom import fixed_values as fixed
from vitaloom.functions.levels import detect_job_seniority
from vitaloom.functions.matching import SCORE_SCALE, is_snippet, job_text, match_level, match_score
from vitaloom.functions.text import has_text
from vitaloom.functions.vectors import SIMILARITY_SCALE, norm, scaled, similarity, similarity_scaled, unit
from vitaloom.operators.recommendations import top_n
from vitaloom.session import cut_lineage

CANDIDATE_LEVELS = ["student", "intern", "entry", "mid", "senior", "principal"]
JOB_LEVELS = ["intern", "entry", "mid", "senior", "principal"]
# Rounding of scores and the small step of the full-text curve stay inside this margin.
_MARGIN = 0.2
# Visits of a block by a chunk that a task makes where there are many, and tasks whose records a driver of 1 GB holds with
# ease; a task makes its visits one after the other, so more of them need no more memory.
VISITS_OF_TASK, MOST_TASKS = 16, 4_000
# The grid of given pairs: cells for each core, fewest groups of each side, and the numbers (320 MB of floats) that the jobs of one
# group may have, as a task holds them; a job counts as its vector and some more.
CELLS_OF_CORE, JOB_GROUPS, RESUME_GROUPS = 4, 8, 4
NUMBERS_OF_GROUP, NUMBERS_BESIDE = 80_000_000, 16
# The grid of visits: bytes of the vectors that a group of blocks and a group of chunks may have, as a task holds both.
BLOCKS_BYTES, CHUNKS_BYTES = 64_000_000, 32_000_000


def _vectors(name: str, lean: bool) -> list:
    """The unit vector, or for ``lean`` rows the vector as it came and its length: floats travel at half the bytes of unit doubles."""
    vector = F.col("vector")
    return [vector.alias(f"{name}_vector"), norm(vector).alias(f"{name}_norm")] if lean else [unit(vector).alias(f"{name}_vector")]


def job_side(jobs: DataFrame, job_id: str = "id", more=(), lean: bool = False) -> DataFrame:
    """Narrow job columns for pairing: id, unit vector, level, snippet flag. Long text stays behind.

    ``lean`` rows are for :func:`match_pairs`, as those of :func:`resume_side`.
    """
    text = job_text(F.col("title"), F.col("description"))
    return jobs.select(F.col(job_id).alias("job_id"), *_vectors("job", lean),
                       detect_job_seniority(F.col("title"), F.col("description")).alias("job_level"),
                       is_snippet(text).alias("snippet"), *more)


def resume_side(resumes: DataFrame, resume_id: str = "id", text: str = "text", more=(), lean: bool = False) -> DataFrame:
    """Narrow resume columns for pairing; resumes without text match nothing.

    A missing quality score counts as 0, a missing level as entry, a missing vector as similar to nothing. ``lean`` rows,
    for :func:`match_pairs`, have the vector as it came and its length.
    """
    return resumes.where(has_text(F.col(text))).select(
        F.col(resume_id).alias("resume_id"), *_vectors("resume", lean),
        F.coalesce(F.col("ats_score").cast("double"), F.lit(0.0)).alias("ats_score"),
        F.coalesce("candidate_level", F.lit(fixed.DEFAULT_CANDIDATE_LEVEL)).alias("candidate_level"), *more)


def scored(pairs: DataFrame, sim) -> DataFrame:
    """Add the score columns to joined pairs; ``sim`` is their similarity."""
    s = F.col("similarity")
    parts = match_score(s, F.col("snippet"), F.col("ats_score"), F.col("candidate_level"), F.col("job_level"))
    return (pairs.withColumn("similarity", sim).withColumn("_m", parts)
            .withColumns({"match_score": F.round("_m.score", 1), "semantic_similarity": F.round(s * 100, 1),
                          "ats_contribution": F.round("_m.quality", 1), "seniority_penalty": F.col("_m.penalty"),
                          "match_level": match_level(F.col("_m.score")), "raw_score": F.col("_m.score")})
            .drop("_m"))


def grid(jobs: DataFrame, numbers=None) -> tuple[int, int]:
    """Groups of jobs, as many as keep each small enough for a task's memory, and groups of resumes, so that all cores have cells.

    ``numbers`` is what a job counts as, its vector if nothing else is said.
    """
    own = F.size("job_vector") if numbers is None else numbers
    numbers = jobs.agg(F.sum(F.coalesce(own, F.lit(0)) + NUMBERS_BESIDE)).first()[0] or 0
    cells = CELLS_OF_CORE * jobs.sparkSession.sparkContext.defaultParallelism
    groups = max(JOB_GROUPS, math.isqrt(cells), math.ceil(numbers / NUMBERS_OF_GROUP))
    return groups, max(RESUME_GROUPS, math.ceil(cells / groups))


def met_pairs(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame, groups: tuple[int, int], once=None) -> DataFrame:
    """The given ``(resume_id, job_id)`` pairs with the columns of both sides, as two inner joins give them.

    A resume travels once to each group of jobs it has pairs in, with the list of these pairs, and a job once to each group of
    resumes. Where both meet, in a cell, the lists are spread again and look their jobs up; no column of a side is sent with a
    pair, and no side to all tasks. ``once`` changes the resumes before their lists are spread. ``groups`` come from :func:`grid`.
    """
    n_jobs, n_resumes = groups
    # ids of two types have one hash
    kinds = {k: pairs.select(k).union(side.select(k)).schema[k].dataType for k, side in (("resume_id", resumes), ("job_id", jobs))}
    group = lambda k, n: F.pmod(F.xxhash64(F.col(k).cast(kinds[k])), F.lit(n)).cast("int")
    cell = (F.col("_job_group") * n_resumes + F.col("_resume_group")).alias("_cell")
    of_pair = [k for k in pairs.columns if k != "resume_id"]
    of_resume, of_job = ([k for k in side.columns if k not in ("resume_id", "job_id")] for side in (resumes, jobs))

    # by resume first: lists and the join with resumes need no other shuffle
    lists = (pairs.where("job_id IS NOT NULL").repartition("resume_id").groupBy("resume_id", group("job_id", n_jobs).alias("_job_group"))
             .agg(F.collect_list(F.struct(*of_pair) if len(of_pair) > 1 else F.col("job_id")).alias("_pairs")))
    # columns that compress well are small in files and large in memory: by the files' size Spark might broadcast them
    people = (lists.join(resumes.hint("merge"), "resume_id").withColumn("_resume_group", group("resume_id", n_resumes))
              .select(cell, "resume_id", "_pairs", *of_resume).repartitionById(n_jobs * n_resumes, "_cell"))
    people = (people if once is None else once(people)).select("*", F.explode("_pairs").alias("_pair"))
    people = people.select("_cell", "resume_id", *[F.col(f"_pair.{k}") if len(of_pair) > 1 else F.col("_pair").alias(k) for k in of_pair], *of_resume)
    places = jobs.select("*", group("job_id", n_jobs).alias("_job_group"), F.explode(F.sequence(F.lit(0), F.lit(n_resumes - 1))).alias("_resume_group"))
    places = places.select(cell, "job_id", *of_job).repartitionById(n_jobs * n_resumes, "_cell")
    return people.join(places.hint("shuffle_hash"), ["_cell", "job_id"]).select(
        "job_id", "resume_id", *[k for k in of_pair if k != "job_id"], *of_resume, *of_job)


def match_pairs(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Scores of the given ``(resume_id, job_id)`` pairs, from :func:`resume_side` and :func:`job_side` rows, which meet as in :func:`met_pairs`."""
    lean = "resume_norm" in resumes.columns
    # once for a resume's list, not for each of its pairs
    mine = scaled(F.col("resume_vector"), F.col("resume_norm")) if lean else F.col("resume_vector")
    joined = met_pairs(pairs, resumes, jobs, grid(jobs), lambda people: people.withColumn("resume_vector", mine))
    mine, theirs = F.col("resume_vector"), F.col("job_vector")
    sim = similarity_scaled(theirs, F.col("job_norm"), mine) if "job_norm" in jobs.columns else similarity(mine, theirs)
    return scored(joined, F.coalesce(sim, F.lit(0.0))).drop("resume_vector", "resume_norm", "job_vector", "job_norm")


def _pack(vectors, size: int) -> np.ndarray:
    """One row of ``size`` numbers for each vector; missing ones are zero, which is similar to nothing."""
    packed = np.zeros((len(vectors), size))
    for row, v in zip(packed, vectors):
        if v is not None:
            row[:] = v
    return np.nan_to_num(packed)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _curve(similarity: np.ndarray, steps, tail: float) -> np.ndarray:
    points = similarity * tail
    for at, base, slope in reversed(steps):
        np.copyto(points, base + (similarity - at) * slope, where=similarity >= at)
    return points


def _points(similarity: np.ndarray, snippet: np.ndarray) -> np.ndarray:
    """Similarity to semantic points, with the curves of the fixed values."""
    if snippet.all():
        return _curve(similarity, fixed.SNIPPET_CURVE, fixed.SNIPPET_TAIL)
    if not snippet.any():
        return _curve(similarity, fixed.FULL_CURVE, fixed.FULL_TAIL)
    return np.where(snippet, _curve(similarity, fixed.SNIPPET_CURVE, fixed.SNIPPET_TAIL),
                    _curve(similarity, fixed.FULL_CURVE, fixed.FULL_TAIL))


def _penalties() -> np.ndarray:
    return np.array([[fixed.SENIORITY_PENALTY.get(c, {}).get(j, 0.0) for j in JOB_LEVELS]
                     for c in CANDIDATE_LEVELS + [""]])


def _totals(similarity, snippet, ats, candidate, job) -> np.ndarray:
    most = np.where(snippet, fixed.SNIPPET_QUALITY_POINTS, fixed.FULL_QUALITY_POINTS)
    totals = np.clip(_points(similarity, snippet) + ats[:, None] / 100.0 * most
                     - _penalties()[candidate[:, None], job[None, :]], 0.0, 100.0)
    return np.rint(totals * SCORE_SCALE) / SCORE_SCALE


def _codes(values, known) -> np.ndarray:
    place = {v: i for i, v in enumerate(known)}
    return np.array([place.get(v, len(known)) for v in values], dtype=np.int64)


def _pivots(jobs: DataFrame, n: int) -> np.ndarray:
    """``n`` job vectors by hash order: a fixed, small number of rows on the driver."""
    known = jobs.where("job_vector IS NOT NULL")
    rows = known.orderBy(F.xxhash64("job_id"), "job_id").limit(n).select("job_vector").collect()
    return _pack([r["job_vector"] for r in rows], len(rows[0]["job_vector"])) if rows else np.zeros((1, 1))


def _place(rows: DataFrame, vector: str, pivots: np.ndarray, columns: list[str]) -> DataFrame:
    """Rows with their nearest pivot and the angle to it; vectors packed for cheap transport."""
    # without one job vector all are similar to nothing, whatever their size
    any_vector = bool(pivots.any())

    def place(batches):
        for pdf in batches:
            if len(pdf):
                vectors = _pack(pdf.pop(vector) if any_vector else [None] * len(pdf), pivots.shape[1])
                angles = _angles(vectors, pivots)
                cell = angles.argmin(axis=1)
                yield pdf[columns].assign(packed=[v.tobytes() for v in vectors], cell=cell.astype("int32"),
                                          angle=angles[np.arange(len(cell)), cell])

    schema = StructType(list(rows.select(*columns).schema))
    for name, kind in (("packed", BinaryType()), ("cell", IntegerType()), ("angle", DoubleType())):
        schema = schema.add(name, kind)
    return rows.select(*columns, vector).mapInPandas(place, schema)


def _packs(placed: DataFrame, rows: int, key: str, pack, schema: str) -> DataFrame:
    """One row for each cell and part of it, made by ``pack``; a cell has as many parts as hold about ``rows`` rows each."""
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_parts"))
    dealt = placed.drop("angle").join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts")
    return dealt.groupBy("cell", "part").applyInPandas(pack, schema)


_BLOCK = "cell int, part int, jobs int, job_ids binary, seqs binary, levels binary, snippets binary, vectors binary"
_CHUNK = "chunk long, resumes int, resume_ids binary, ats binary, candidates binary, resume_vectors binary"


def _pack_jobs(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["seq", "job_id"])
    return pd.DataFrame([(pdf["cell"].iat[0], pdf["part"].iat[0], len(pdf), pdf["job_id"].to_numpy(np.int64).tobytes(), pdf["seq"].to_numpy(np.int64).tobytes(),
                          _codes(pdf["job_level"], JOB_LEVELS).tobytes(), pdf["snippet"].to_numpy(bool).tobytes(), b"".join(pdf["packed"]))],
                        columns=[c.split()[0] for c in _BLOCK.split(", ")])


def _pack_resumes(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(int(pdf["cell"].iat[0]) << 32 | int(pdf["part"].iat[0]), len(pdf), pdf["resume_id"].to_numpy(np.int64).tobytes(),
                          pdf["ats_score"].to_numpy(float).tobytes(), _codes(pdf["candidate_level"], CANDIDATE_LEVELS).tobytes(), b"".join(pdf["packed"]))],
                        columns=[c.split()[0] for c in _CHUNK.split(", ")])


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(n, -1)


def _visits(chunks: DataFrame, pivots: np.ndarray, cells: pd.DataFrame, blocks: dict[int, int], k: int, min_score: float) -> DataFrame:
    """One row for every chunk and block that can still hold one of the best ``k`` jobs of a resume, with the places of those resumes."""
    cell, radius = cells["cell"].to_numpy(), cells["radius"].to_numpy() + 1e-9
    snippet, size = cells["snippet"].to_numpy(), cells["n"].to_numpy()
    level = _codes(cells["job_level"], JOB_LEVELS)

    def kept(vectors, ats, candidate):
        """Which cells' rows each resume must see."""
        angle = _angles(vectors, pivots)[:, cell]
        at_most = _totals(np.cos(np.maximum(angle - radius, 0.0)), snippet, ats, candidate, level) + _MARGIN
        at_least = _totals(np.cos(np.minimum(angle + radius, math.pi)), snippet, ats, candidate, level) - _MARGIN
        # k jobs are sure to score at least `floor`: take cells by their lower bound until they hold k jobs
        order = np.argsort(-at_least, axis=1)
        held = np.cumsum(size[order], axis=1)
        enough = (held >= k).argmax(axis=1)
        rows = np.arange(len(vectors))
        floor = np.where(held[:, -1] >= k, at_least[rows, order[rows, enough]], -np.inf)
        keep = at_most >= np.maximum(floor, min_score - _MARGIN)[:, None]
        return np.stack([keep[:, cell == c].any(axis=1) for c in names], axis=1)

    names = np.unique(cell)
    # slabs keep the matrices of resumes x cells small
    slab = max(1, 2_000_000 // max(1, len(cell)))

    def plan(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                vectors, ats = _unpack(row.resume_vectors, row.resumes), np.frombuffer(row.ats)
                candidate = np.frombuffer(row.candidates, np.int64)
                see = np.concatenate([kept(vectors[at:at + slab], ats[at:at + slab], candidate[at:at + slab]) for at in range(0, row.resumes, slab)])
                out = [(row.chunk, c, part, places.tobytes()) for c, seen in zip(names, see.T) if len(places := np.nonzero(seen)[0])
                       for part in range(blocks[int(c)])]
                if out:
                    yield pd.DataFrame(out, columns=["chunk", "cell", "part", "places"]).astype({"cell": "int32", "part": "int32"})

    return chunks.mapInPandas(plan, "chunk long, cell int, part int, places binary")


def tasks_of(n_visits: int, cores: int) -> int:
    """Tasks for so many visits: some for each core, more for many visits, and no more than the driver can keep books on."""
    return min(max(1, n_visits), max(3 * cores, n_visits // VISITS_OF_TASK), MOST_TASKS)


_MATCH = "resume_id bigint, job_id bigint, seq bigint, tenths bigint, similarity double"


def _best_of_cell(k: int, min_score: float, slab: int = 64):
    """Best ``k`` jobs of a group of blocks for each resume of a group of chunks, one visit of a block by a chunk after the other."""
    least = math.ceil(min_score * 10 - 1e-9)

    def of_visit(people, block, places):
        """``tenths, seq, job_id, similarity`` of the best jobs of a block for the resumes at ``places``; rows below the least score have -1 tenths."""
        resumes, ats, candidate = (x[places] for x in people)
        vectors, ids, seqs, level, snippet = block
        n, take = len(ids), min(k, len(ids))
        out = []
        for at in range(0, len(places), slab):
            part = slice(at, at + slab)
            sims = np.rint(resumes[part] @ vectors.T * SIMILARITY_SCALE) / SIMILARITY_SCALE
            tenths = np.floor(_totals(sims, snippet, ats[part], candidate[part], level) * 10 + 0.5).astype(np.int64)
            # jobs are in the order of ties
            top = np.argpartition(-(tenths * n + (n - 1 - np.arange(n))), take - 1, axis=1)[:, :take]
            rows = np.arange(len(sims))[:, None]
            good = tenths[rows, top]
            out.append((np.where(good >= least, good, -1), seqs[top], ids[top], sims[rows, top]))
        return [np.concatenate(x) for x in zip(*out)]

    def merged(held, new):
        """The best ``k`` of both for each resume, in order."""
        both = [np.concatenate(x, axis=1) for x in zip(held, new)]
        order = np.lexsort((both[2], both[1], -both[0]), axis=1)[:, :k]
        return [np.take_along_axis(x, order, axis=1) for x in both]

    def best(chunks: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        known = {(b.cell, b.part): (_unpack(b.vectors, b.jobs), *(np.frombuffer(x, kind) for x, kind in (
            (b.job_ids, np.int64), (b.seqs, np.int64), (b.levels, np.int64), (b.snippets, bool)))) for b in blocks.itertuples()}
        out = []
        for v in chunks.itertuples():
            people = _unpack(v.resume_vectors, v.resumes), np.frombuffer(v.ats), np.frombuffer(v.candidates, np.int64)
            held = [np.full((v.resumes, k), -1), *(np.zeros((v.resumes, k), np.int64) for _ in range(2)), np.zeros((v.resumes, k))]
            for cell, part, seen in zip(v.cells, v.parts, v.seen):
                places = np.frombuffer(seen, np.int64)
                for x, found in zip(held, merged([x[places] for x in held], of_visit(people, known[cell, part], places))):
                    x[places] = found
            rows, cols = np.nonzero(held[0] >= 0)
            tenths, seqs, ids, sims = (x[rows, cols] for x in held)
            out.append(pd.DataFrame({"resume_id": np.frombuffer(v.resume_ids, np.int64)[rows], "job_id": ids, "seq": seqs, "tenths": tenths, "similarity": sims}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in _MATCH.split(", ")})

    return best


def _groups(visits: DataFrame, chunks: DataFrame, blocks: DataFrame) -> tuple[int, int]:
    """Groups of blocks, as many as keep each small enough for a task's memory, and groups of chunks: as small, and cells for all cores."""
    size = lambda df, name: df.agg(F.sum(F.length(name))).first()[0] or 0
    n_blocks = max(1, math.ceil(size(blocks, "vectors") / BLOCKS_BYTES))
    cores = visits.sparkSession.sparkContext.defaultParallelism
    cells = min(tasks_of(visits.count(), cores), CELLS_OF_CORE * cores)
    return n_blocks, max(math.ceil(cells / n_blocks), math.ceil(size(chunks, "resume_vectors") / CHUNKS_BYTES))


def _met_blocks(visits: DataFrame, chunks: DataFrame, blocks: DataFrame, k: int, low: float) -> DataFrame:
    """The best ``k`` jobs of each group of blocks for each resume.

    A chunk travels once to each group of blocks it visits, with the list of its visits, and a block once to each group of
    chunks that visit it; no vector is sent with a visit, and of all visits of a resume to a group only its best ``k`` rows leave.
    """
    n_blocks, n_chunks = _groups(visits, chunks, blocks)
    group = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    at = visits.withColumns({"_blocks": group(n_blocks, "cell", "part"), "_chunks": group(n_chunks, "chunk")})
    at = at.withColumn("_cell", F.col("_blocks") * n_chunks + F.col("_chunks"))
    lists = at.groupBy("chunk", "_cell").agg(F.collect_list(F.struct("cell", "part", "places")).alias("_v"))
    lists = lists.select("chunk", "_cell", F.col("_v.cell").alias("cells"), F.col("_v.part").alias("parts"), F.col("_v.places").alias("seen"))
    # packed vectors that repeat are small in files and large in memory: by the files' size Spark might broadcast them
    people = lists.join(chunks.hint("merge"), "chunk").repartitionById(n_blocks * n_chunks, "_cell")
    places = at.select("cell", "part", F.col("_cell").alias("_place")).distinct().join(blocks.hint("merge"), ["cell", "part"])
    places = places.repartitionById(n_blocks * n_chunks, "_place")
    return people.groupBy("_cell").cogroup(places.groupBy("_place")).applyInPandas(_best_of_cell(k, low), _MATCH)


def search_space(resumes: DataFrame, jobs: DataFrame, k: int, min_score: float, block_rows: int, chunk_rows: int,
                 cell_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(visits, chunks, blocks)``: which bounded chunks of resumes must meet which bounded blocks of jobs.

    Both sides lie in cells around the same pivots, and a chunk's resumes share a cell, so they need much the same
    blocks: a block is sent to the chunks that visit it and to no other.
    """
    n_jobs = jobs.count()
    # as many cells as their rows allow, and no more than the root of the jobs, so that the driver holds little
    pivots = _pivots(jobs, max(1, min(math.isqrt(n_jobs), n_jobs // cell_rows)))
    jobs = cut_lineage(_place(jobs, "job_vector", pivots, ["job_id", "seq", "job_level", "snippet"]), "placed")
    people = cut_lineage(_place(resumes, "resume_vector", pivots, ["resume_id", "ats_score", "candidate_level"]), "placed")
    # at most cells x levels x 2 rows
    cells = jobs.groupBy("cell", "job_level", "snippet").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).toPandas()
    parts = {int(c): math.ceil(n / block_rows) for c, n in cells.groupby("cell")["n"].sum().items()}
    blocks = cut_lineage(_packs(jobs, block_rows, "job_id", _pack_jobs, _BLOCK), "blocks")
    chunks = cut_lineage(_packs(people, chunk_rows, "resume_id", _pack_resumes, _CHUNK), "chunks")
    visits = _visits(chunks, pivots, cells, parts, k, min_score) if parts else chunks.where("false").selectExpr("chunk", "0 AS cell", "0 AS part", "ats AS places")
    return cut_lineage(visits, "visits"), chunks, blocks


def top_matches(resumes: DataFrame, jobs: DataFrame, k: int = fixed.TOP_MATCHES, min_score: float | None = None,
                seq: str | None = None, block_rows: int = 4096, chunk_rows: int = 2048,
                cell_rows: int = 2048, materialize: bool = True) -> DataFrame:
    """Exact best ``k`` jobs per resume by rounded score; equal scores keep the order of ``seq``, then of the id.

    A block holds about ``block_rows`` jobs and a chunk about ``chunk_rows``
    resumes of one cell, split by hash, so neither a crowded cell nor a popular
    region makes a large task. Jobs travel only to the groups of chunks that can use
    them, and only the best ``k`` rows of groups of blocks reach the final ranking.

    Both narrow sides are read several times, so they are written to the shared
    folder first; pass ``materialize=False`` when they already are plain tables.
    """
    low = float(min_score or 0.0)
    jobs = jobs.withColumn("seq", F.col(seq or "job_id").cast("bigint"))
    if materialize:
        jobs, resumes = cut_lineage(jobs, "jobs"), cut_lineage(resumes, "resumes")
    visits, chunks, blocks = search_space(resumes, jobs, k, low, block_rows, chunk_rows, cell_rows)
    found = _met_blocks(visits, chunks, blocks, k, low)
    # rank before joining, so that the joins see only the best k rows of each resume
    best = top_n(found, ["resume_id"], [F.desc("tenths"), F.asc("seq"), F.asc("job_id")], k).drop("seq", "tenths")
    matches = best.join(resumes.drop("resume_vector"), "resume_id").join(jobs.drop("job_vector"), "job_id")
    return scored(matches, F.col("similarity"))
