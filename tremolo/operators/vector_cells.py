"""Exact vector retrieval with pruning: the corpus is cut into cells around directions, and a
query reads only the cells whose best possible inner product reaches its k-th best score.

A cell has a unit direction ``u``. Its vectors have ``x = (x.u) u + rest``, and the cell knows the least and
greatest ``x.u`` and the longest ``rest``, so for every query ``q``

    q.x <= max((q.u) low, (q.u) high) + |q - (q.u) u| * longest

holds for all its vectors. (1) Each query is scored against the cells of highest bound that hold k
vectors; its k-th best score there is a floor. (2) It is scored against the other cells whose bound reaches
the floor. What is skipped cannot belong to the result, so the result is exact, ties included.

Directions are fitted on a bounded sample (``SAMPLE_ROWS`` rows chosen by a hash of the id); every
vector is indexed. How much is skipped depends on the vectors: clusters, or few dimensions, skip most cells;
for directions that are uniformly random in many dimensions no exact bound skips any.

Scale: directions and cell sizes are at most ``MAX_CELLS`` rows, which every task carries. Neighbouring cells
make a run of about ``block_rows`` vectors, and a cell of more is cut into parts. Step 1 shows a query one part of
its cells; step 2 sends it once to each run of which it needs a cell, not once per cell, and
the task shows it the cells that it needs (``vectors.Best``). Runs meet their queries in blocks of about
``block_rows`` by ``block_rows``, so one cell with a third of the corpus is many tasks, and a vector is sent at most as
often as the other side has blocks. A block emits k rows per query.

Cases: vectors that are NULL, hold a NULL, NaN or infinity, or are not as long as most corpus vectors are
neither queries nor found; equal scores rank by the smaller corpus id; a corpus of fewer than k vectors
gives them all; an empty table gives an empty result. Ids are integers, unique on each side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.operators.ordered import stored
from tremolo.operators.vectors import Best, matrix, usable, vector_length

MAX_CELLS = 1024
SAMPLE_ROWS = 20 * MAX_CELLS
SAMPLE_BYTES = 64 << 20
ROUNDS = 8
BLOCK_BYTES = 16 << 20  # vectors of a block, as doubles
BLOCK_LEAST, BLOCKS = 1024, 6  # small tables make so many blocks of either side, of no fewer rows
MAX_PARTITIONS = 4096
_FOUND = "query_id long, corpus_id long, score double"


def fit_directions(corpus: DataFrame, dims: int, cells: int | None = None) -> np.ndarray:
    """Unit directions (one row each), by rounds of averaging over a sample."""
    n = corpus.count()
    cells = min(MAX_CELLS, cells or max(1, math.isqrt(n)))
    rows = max(1, min(20 * cells, SAMPLE_ROWS, SAMPLE_BYTES // (8 * max(1, dims))))
    sample = matrix(corpus.orderBy(F.xxhash64("id"), "id").limit(rows).select("v").toArrow()["v"], dims)
    sample = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    if not len(sample):
        return np.zeros((0, dims))
    # each direction starts at the sample vector farthest from those before it
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(cells, len(sample)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    u = sample[chosen]
    for _ in range(ROUNDS):
        best = (sample @ u.T).argmax(axis=1)
        total = np.zeros_like(u)
        np.add.at(total, best, sample)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        u = np.where(size > 1e-9, total / np.maximum(size, 1e-9), u)
    return u


def _placed(u: np.ndarray):
    dims = u.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["v"], dims)
            along = x @ u.T
            cell = along.argmax(axis=1)
            along = along[np.arange(len(x)), cell]
            across = np.sqrt(np.maximum((x * x).sum(axis=1) - along * along, 0))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["v"], pa.array(cell.astype(np.int32)), pa.array(along),
                 pa.array(across)], names=["id", "v", "cell", "along", "across"])
    return run


class Cells:
    """Directions, and for each cell its number of vectors, least and greatest ``x.u``, longest rest."""

    def __init__(self, u: np.ndarray, stats: list):
        c = len(u)
        self.u, self.n = u, np.zeros(c, np.int64)
        self.low, self.high, self.rest = (np.zeros(c) for _ in range(3))
        for r in stats:
            self.n[r["cell"]] = r["n"]
            self.low[r["cell"]], self.high[r["cell"]] = r["low"], r["high"]
            self.rest[r["cell"]] = r["rest"]

    def bounds(self, q: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """(queries x cells from lo to hi) no vector of a cell scores higher; empty cells have -inf."""
        low, high, rest = self.low[lo:hi], self.high[lo:hi], self.rest[lo:hi]
        along = q @ self.u[lo:hi].T
        norm2 = (q * q).sum(axis=1, keepdims=True)
        beside = np.sqrt(np.maximum(norm2 - along * along, 0))
        best = np.maximum(along * low, along * high) + beside * rest
        size = np.sqrt(norm2) * (np.maximum(np.abs(low), np.abs(high)) + rest)
        return np.where(self.n[lo:hi] > 0, best + 1e-7 * size, -np.inf)  # more than rounding can take

    def needed(self, q: np.ndarray, floor: np.ndarray, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """(queries x cells) marks of the cells that may reach the floor."""
        return (self.bounds(q, lo, hi) >= floor[:, None]) & (self.n[lo:hi] > 0)

    def home(self, q: np.ndarray, k: int) -> np.ndarray:
        """The cells of highest bound that hold k vectors, as (queries x cells) marks."""
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        held = np.cumsum(self.n[order], axis=1)
        taken = (held - self.n[order] < k) & (self.n[order] > 0)
        marks = np.zeros(bound.shape, bool)
        np.put_along_axis(marks, order, taken, axis=1)
        return marks


class Runs:
    """Runs of neighbouring cells: of each cell its run; of each run its first cell (and an end) and its parts."""

    def __init__(self, sizes: np.ndarray, block_rows: int):
        self.of, first, held = np.zeros(len(sizes), np.int64), [], 0
        for cell, n in enumerate(sizes.tolist()):
            if not first or held + n > block_rows:
                first.append(cell)
                held = 0
            held += n
            self.of[cell] = len(first) - 1
        self.first = np.array([*first, len(sizes)])
        self.parts = [max(1, math.ceil(n / block_rows)) for n in np.add.reduceat(sizes, first).tolist()]


def _block_rows(rows: int, dims: int) -> int:
    return min(max(BLOCK_LEAST, math.ceil(rows / BLOCKS)), max(1, BLOCK_BYTES // (8 * dims)))


def _at_home(index: Cells, runs: Runs, enough: int):
    """A row (id, v, cell, run) for each of a query's cells of highest bound that hold enough vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                row, cell = np.nonzero(index.home(matrix(part["v"], index.u.shape[1]), enough))
                some = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [some["id"], some["v"], pa.array(cell.astype(np.int32)),
                     pa.array(runs.of[cell].astype(np.int32))], names=["id", "v", "cell", "run"])
    return run


def _floor(part) -> np.ndarray:
    return part["floor"].fill_null(-np.inf).to_numpy()


def _sent(index: Cells, runs: Runs, counted: bool):
    """A row (id, v, floor, run) for each run of which a query needs a cell; or, counted, (run, n, scored): the
    queries of a run and their pairs in needed cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                marks = index.needed(matrix(part["v"], index.u.shape[1]), _floor(part))
                row, of = np.nonzero(np.logical_or.reduceat(marks, runs.first[:-1], axis=1))
                if counted:
                    scored = np.add.reduceat(marks.sum(axis=0) * index.n, runs.first[:-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.arange(len(scored), dtype=np.int32)),
                         pa.array(np.bincount(of, minlength=len(scored)).astype(np.int64)), pa.array(scored)],
                        names=["run", "n", "scored"])
                    continue
                some = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [some["id"], some["v"], some["floor"], pa.array(of.astype(np.int32))],
                    names=["id", "v", "floor", "run"])
    return run


def _ranges(marks: np.ndarray, at: np.ndarray):
    """What a chunk of queries is shown: its marked cells, neighbours that all queries need together."""
    every, some = marks.all(axis=0), marks.any(axis=0)
    cell = 0
    while cell < len(some):
        end = cell + 1
        if every[cell]:
            while end < len(some) and every[end]:
                end += 1
        if some[cell]:
            yield None if every[cell] else np.flatnonzero(marks[:, cell]), at[cell], at[end]
        cell = end


def _deal(queries: DataFrame, counts: dict, placed: DataFrame, index: Cells, runs: Runs, k: int,
          exclude_self: bool, block_rows: int, floors: bool) -> DataFrame:
    """The k best of each block for each of its queries (id, v, run, and ``cell`` or ``floor``): for floors in a
    query's ``cell``, in the first part of the run; or else in all cells that may reach its ``floor``."""
    q_blocks = [math.ceil(counts.get(run, 0) / block_rows) for run in range(len(runs.parts))]
    parts = [1] * len(q_blocks) if floors else runs.parts

    def of_run(of):
        return F.element_at(F.lit(of), F.col("run") + 1)

    def all_of(of):
        return F.explode(F.sequence(F.lit(0), of_run(of) - 1))

    def one_of(of):
        return F.pmod(F.xxhash64("id"), of_run(of)).cast("int")

    left = queries.withColumn("qb", one_of(q_blocks)).withColumn("cb", all_of(parts))
    right = placed.select("id", "v", "cell", F.element_at(F.lit(runs.of.tolist()), F.col("cell") + 1).cast(
        "int").alias("run")).where(of_run(q_blocks) > 0).withColumn("cb", one_of(runs.parts))
    if floors:
        right = right.where("cb = 0")
    right = right.withColumn("qb", all_of(q_blocks))
    dims = index.u.shape[1]

    def score(key, q: pa.Table, c: pa.Table) -> pa.Table:
        found = ([], [], [])
        if q.num_rows and c.num_rows:
            lo, hi = (int(x) for x in runs.first[key[0].as_py():][:2])
            vectors, cell = matrix(q["v"], dims), c["cell"].to_numpy()
            by_cell = np.argsort(cell, kind="stable")
            at = np.searchsorted(cell[by_cell], np.arange(lo, hi + 1))
            near = q["cell"].to_numpy() if floors else index.bounds(vectors, lo, hi).argmax(axis=1)
            order = np.argsort(near, kind="stable")  # queries that need the same cells stand together
            vectors, near = vectors[order], near[order]
            floor = None if floors else _floor(q.combine_chunks())[order]
            best = Best(q["id"].to_numpy()[order], vectors, k, exclude_self, floor)

            def shown(first: int, end: int):
                marks = near[first:end, None] == np.arange(lo, hi) if floors else index.needed(
                    vectors[first:end], floor[first:end], lo, hi)
                return _ranges(marks, at)

            best.see(c["id"].to_numpy()[by_cell], matrix(c["v"], dims)[by_cell], shown)
            found = best.found()
        return pa.table([pa.array(x, t) for x, t in zip(
            found, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
            names=["query_id", "corpus_id", "score"])

    by = ("run", "cb", "qb")
    n = max(1, min(MAX_PARTITIONS, 2 * sum(p * b for p, b in zip(parts, q_blocks, strict=True))))
    return left.repartition(n, *by).groupBy(*by).cogroup(right.repartition(n, *by).groupBy(*by)).applyInArrow(
        score, _FOUND)


def knn_cells(queries: DataFrame, corpus: DataFrame, k: int = 5, *, q_id: str = "vec_id",
              q_vec: str = "embedding", c_id: str = "vec_id", c_vec: str = "embedding",
              exclude_self: bool = False, cells: int | None = None, block_rows: int | None = None,
              report: dict | None = None) -> DataFrame:
    """(query_id, rank, corpus_id, score) for the k highest inner products per query.

    ``report`` receives ``scored`` (query-vector pairs that were scored) and ``pairs`` (all of them)."""
    dims = vector_length(corpus, c_vec)
    found = corpus.sparkSession.createDataFrame([], _FOUND)
    q, c = usable(queries, q_id, q_vec, dims), usable(corpus, c_id, c_vec, dims)
    u = fit_directions(c, dims, cells) if dims else np.zeros((0, 0))
    if len(u):
        v, qv = (x.schema["v"].dataType.simpleString() for x in (c, q))
        placed = stored(c.mapInArrow(_placed(u), f"id long, v {v}, cell int, along double, across double"))
        index = Cells(u, placed.groupBy("cell").agg(
            F.count("*").alias("n"), F.min("along").alias("low"), F.max("along").alias("high"),
            F.max("across").alias("rest")).collect())  # at most MAX_CELLS rows
        block_rows = block_rows or _block_rows(int(index.n.sum()), dims)
        runs = Runs(index.n, block_rows)
        how = (placed, index, runs, k, exclude_self, block_rows)
        home = stored(q.mapInArrow(_at_home(index, runs, k + 1 if exclude_self else k),
                                   f"id long, v {qv}, cell int, run int"))
        at_home = home.groupBy("run").count().collect()  # at most MAX_CELLS rows
        first = _deal(home, {r["run"]: r["count"] for r in at_home}, *how, True)
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"))
        floors = first.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") == k).select(
            F.col("query_id").alias("id"), F.col("score").alias("floor"))
        asked = stored(q.join(floors, "id", "left"))
        counts = asked.mapInArrow(_sent(index, runs, True), "run int, n long, scored long").groupBy("run").agg(
            F.sum("n").alias("n"), F.sum("scored").alias("scored")).collect()  # at most MAX_CELLS rows
        found = _deal(asked.mapInArrow(_sent(index, runs, False), f"id long, v {qv}, floor double, run int"),
                      {r["run"]: r["n"] for r in counts}, *how, False)
        if report is not None:
            report["scored"] = sum(r["scored"] for r in counts) + sum(
                r["count"] * int(index.n[r["cell"]]) // runs.parts[runs.of[r["cell"]]]
                for r in home.groupBy("cell").count().collect())
            report["pairs"] = q.count() * int(index.n.sum())
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("corpus_id"))
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "corpus_id", "score"))
