"""Exact vector retrieval (inner product on unit vectors), the reference's flat index.

Two shapes:
  * ``catalogue_topk``: every query row against a small catalogue (intents, label
    centroids). The catalogue's size is checked, then it is broadcast as a matrix and
    scored per Arrow batch: no join and no shuffle, linear in the queries.
  * ``knn``: queries against a corpus of any size. Scoring runs in Arrow batches with
    numpy matrix products (``Best``); each task keeps a running top-k per query, so a task emits
    at most (queries x k) rows and never all pairs. The query side is broadcast when
    its size is under a bound; otherwise both sides are dealt into blocks
    (``operators.vector_cells``). A final ``row_number() <= k`` per query merges the partial lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tremolo.functions.vectors import l2_normalize

MAX_CATALOGUE_ROWS = 10_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
KNN_BROADCAST_BYTES = 8 * 1024 * 1024  # queries; above it the corpus and they are dealt in blocks
SCORE_CELLS = 1 << 22  # scores held at a time by a task (with their order: 64 MB)
CHUNK_ROWS, CHUNK_WIDTH = 256, 2048  # queries and corpus rows of a product: its scores stay in the cache
GATHERED = 1 << 19  # numbers of either side of the pairs scored at a time
# The lines around the retrieved rows in the prompt.
PROMPT_HEADER = "Aşağıda RTF makinesi titreşim verileri var:"
PROMPT_FOOTER = "Bu verilere dayanarak cevap verin:"


def centroids(df: DataFrame, label: str = "label", vec: str = "embedding") -> DataFrame:
    """Unit-length mean vector per label, built by position (posexplode + avg), so no
    label's vectors are gathered in one place: (label, n, centroid array<double>)."""
    e = df.select(label, F.posexplode(vec).alias("pos", "x"))
    per_pos = e.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"),
                                          F.count(F.lit(1)).alias("n"))
    agg = per_pos.groupBy(label).agg(
        F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_p"), F.max("n").alias("n"))
    return agg.select(label, "n", l2_normalize(F.transform("_p", lambda s: s["m"]))
                      .alias("centroid"))


def catalogue_topk(queries: DataFrame, catalogue: DataFrame, k: int = 3, *,
                   qvec: str = "embedding", cat_id: str = "label", cat_vec: str = "centroid",
                   max_rows: int = MAX_CATALOGUE_ROWS, cosine: bool = False) -> DataFrame:
    """Queries plus (rank, <cat_id>, score) for the k best catalogue entries; ties
    go to the smaller catalogue id. Entries whose vector is NULL, holds a NULL, NaN or infinity, or
    is not as long as most are never found; queries with such a vector get no rows. With ``cosine`` scores are
    divided by the lengths of both vectors, and zero vectors count as unusable.

    The catalogue is read once and its size checked; up to ``max_rows`` entries and ``MAX_BROADCAST_BYTES``
    are broadcast as a matrix, and a task scores its queries in chunks of ``SCORE_CELLS`` scores. A larger
    one is searched by ``vector_cells.knn_cells``, with the same result."""
    dims = max(1, vector_length(catalogue, cat_vec))
    most = min(max_rows, MAX_BROADCAST_BYTES // (8 * dims))
    rows = catalogue.select(cat_id, cat_vec).limit(most + 1).collect()
    if len(rows) > most:
        return _searched(queries, catalogue, k, qvec, cat_id, cat_vec, cosine)
    vectors = [np.array([np.nan if x is None else x for x in r[1] or []], float) for r in rows]
    lengths = [len(v) for v in vectors if len(v)]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n)) if lengths else 0
    rows = [(r[0], v) for r, v in zip(rows, vectors, strict=True)
            if dims and len(v) == dims and np.isfinite(v).all() and (v.any() or not cosine)]
    rows.sort(key=lambda r: r[0])  # of equal scores the first, by a stable sort
    matrix = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), dims)
    bc = queries.sparkSession.sparkContext.broadcast(([r[0] for r in rows], matrix))
    new = [T.StructField("rank", T.IntegerType()),
           T.StructField(cat_id, catalogue.schema[cat_id].dataType),
           T.StructField("score", T.DoubleType())]
    kept = [f for f in queries.schema.fields if f.name not in {n.name for n in new}]
    id_type = to_arrow_type(new[1].dataType)

    def score(batches):
        ids, mat = bc.value
        best = min(k, len(ids))
        step = max(1, SCORE_CELLS // max(1, len(ids)))
        for batch in batches:
            length = pc.fill_null(pc.list_value_length(batch[qvec]), -1)
            full = np.flatnonzero(length.to_numpy(zero_copy_only=False) == mat.shape[1])
            for i in range(0, len(full) if best else 0, step):
                at = full[i:i + step]
                values = batch[qvec].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                values = values.astype(np.float64).reshape(len(at), -1)
                fine = np.isfinite(values).all(axis=1) & (values.any(axis=1) | (not cosine))
                at, values = at[fine], values[fine]
                scores = values @ mat.T
                if cosine:
                    scores = scores / (_lengths(values)[:, None] * _lengths(mat)[None, :])
                order = np.argsort(-scores, axis=1, kind="stable")[:, :best]
                part = batch.take(pa.array(np.repeat(at, best)))
                yield pa.RecordBatch.from_arrays(
                    [part[f.name] for f in kept] + [
                        pa.array(np.tile(np.arange(1, best + 1, dtype=np.int32), len(at))),
                        pa.array([ids[j] for j in order.ravel()], id_type),
                        pa.array(np.take_along_axis(scores, order, axis=1).ravel())],
                    names=[f.name for f in kept + new])

    return queries.mapInArrow(score, T.StructType(kept + new))


def _searched(queries: DataFrame, catalogue: DataFrame, k: int, qvec: str, cat_id: str, cat_vec: str,
              cosine: bool) -> DataFrame:
    """``catalogue_topk`` for a catalogue of any size: entries are numbered in the order of their ids."""
    from tremolo.operators.ordered import ranks, stored
    from tremolo.operators.vector_cells import knn_cells

    def shaped(vec: str) -> Column:
        v = F.col(vec).cast("array<double>")
        if not cosine:
            return v
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.when(size > 0, F.transform(v, lambda x: x / size))

    entries = ranks(catalogue.select(F.lit(0).alias("_all"), F.col(cat_id).alias("_cat"), shaped(cat_vec).alias("_v")),
                    "_all", ("_cat",), "_n")
    new = ("rank", cat_id, "score")
    asked = stored(queries.drop(*new).withColumn("_q", F.monotonically_increasing_id()))
    hits = knn_cells(asked.select("_q", shaped(qvec).alias("_v")), entries, k, q_id="_q", q_vec="_v", c_id="_n",
                     c_vec="_v")
    named = hits.join(entries.select(F.col("_n").alias("corpus_id"), F.col("_cat").alias(cat_id)), "corpus_id")
    return asked.join(named, F.col("_q") == F.col("query_id")).select(
        *[c for c in asked.columns if c != "_q"], F.col("rank").cast("int").alias("rank"), cat_id, "score")


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))


def best_match(topk: DataFrame, ids: list[str], cat_id: str, threshold: float) -> DataFrame:
    """T5: per query the best entry when its score reaches ``threshold``."""
    return (topk.where((F.col("rank") == 1) & (F.col("score") >= threshold))
            .select(*ids, cat_id, "score"))


def suggestions(topk: DataFrame, ids: list[str], threshold: float,
                suggest_at: float = 0.40) -> DataFrame:
    """For queries without a match, their top-k entries scoring at least
    ``suggest_at``."""
    w = Window.partitionBy(*ids)
    t = topk.withColumn("_best", F.max("score").over(w))
    return (t.where((F.col("_best") < threshold) & (F.col("score") >= suggest_at))
            .drop("_best"))


# ------------------------------------------------------------------ exact k-NN over a corpus

def vector_length(df: DataFrame, vec: str = "embedding") -> int:
    """The most frequent length of the vectors (of equally frequent ones the greatest); 0 without vectors."""
    top = df.where(F.size(vec) > 0).groupBy(F.size(vec).alias("d")).count().orderBy(
        F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def usable(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """id, v: the vectors of ``dims`` finite numbers (floats stay floats, half as long in a shuffle)."""
    single = df.select(vec).schema[0].dataType == T.ArrayType(T.FloatType())
    v = F.col(vec) if single else F.col(vec).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == dims) & finite)


def matrix(column, dims: int) -> np.ndarray:
    """A list column as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def _scaled(m: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``m / size`` in single precision, and the lengths of its rows."""
    m = m / size
    return m.astype(np.float32), np.sqrt((m * m).sum(axis=1))


def _true(marks: np.ndarray) -> np.ndarray:
    """Places of the few true values, looked for eight at a time."""
    flat = marks.ravel()
    whole = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate((at[flat[at]], whole + np.flatnonzero(flat[whole:])))


class Best:
    """The k best corpus rows of each query among those that it was shown, exact.

    Products in single precision leave out the pairs that stay below a query's k-th best score by more than
    rounding can take; the others are scored in double precision, each pair by itself, so that equal
    vectors have equal scores. ``floor``: scores (or -inf) below which no row is wanted. At most ``CHUNK_ROWS``
    x ``CHUNK_WIDTH`` scores are held at a time, besides the k best."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, exclude_self: bool,
                 floor: np.ndarray | None = None):
        self.ids, self.vectors, self.k, self.exclude_self = ids, vectors, k, exclude_self
        self.floor = np.full(len(ids), -np.inf) if floor is None else floor.astype(np.float64)
        top = np.abs(vectors).max(axis=1, initial=0)
        self.size = np.where(top > 0, top, 1.0)
        self.small, self.length = _scaled(vectors, self.size[:, None])
        self.held = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
                     for _ in range(0, len(ids), CHUNK_ROWS)]

    def see(self, c_ids: np.ndarray, vectors: np.ndarray, shown=None) -> None:
        """Show corpus rows: all of them to every query, or what ``shown`` gives for a chunk of queries (first, end):
        (queries of the chunk, as places in it or None for all; first and end of the corpus rows)."""
        if not len(c_ids) or self.k < 1:
            return
        size = np.abs(vectors).max(initial=0) or 1.0
        small, length = _scaled(vectors, size)
        for n, first in enumerate(range(0, len(self.ids), CHUNK_ROWS)):
            end = min(first + CHUNK_ROWS, len(self.ids))
            waiting: list[tuple] = []
            for rows, lo, hi in [(None, 0, len(c_ids))] if shown is None else shown(first, end):
                rows = np.arange(first, end) if rows is None else first + rows
                for a in range(lo, hi, CHUNK_WIDTH):
                    b = min(a + CHUNK_WIDTH, hi)
                    fresh = np.isneginf(self.floor[rows]).any()
                    waiting += self._reaching(rows, c_ids[a:b], vectors[a:b], small[a:b], length[a:b], size)
                    if fresh or sum(len(w[0]) for w in waiting) > 2 * self.k * CHUNK_ROWS:
                        self._keep(n, waiting)
                        waiting = []
            self._keep(n, waiting)

    def _reaching(self, rows, c_ids, vectors, small, length, size):
        """(query, corpus id, score) of the pairs that reach the floor of their query."""
        floor, k = self.floor[rows], self.k
        scores = self.small[rows] @ small.T
        rounding = (vectors.shape[1] + 8) * 2.0 ** -24 * self.length[rows] * length.max() + 1e-35
        with np.errstate(over="ignore"):
            limit = floor / self.size[rows] / size - rounding
        new = np.flatnonzero(np.isneginf(floor))
        if len(new) and len(c_ids) > k:  # the k-th best of these is a floor
            part = scores[new]
            if self.exclude_self:
                part[self.ids[rows[new]][:, None] == c_ids[None, :]] = -np.inf
            limit[new] = np.partition(part, -k, axis=1)[:, -k] - 2 * rounding[new]
        with np.errstate(over="ignore"):
            limit = np.nextafter(limit.astype(np.float32), np.float32(-np.inf))
        at = _true(scores >= limit[:, None])
        found = []
        step = max(1, GATHERED // vectors.shape[1])
        for i in range(0, len(at), step):
            row, col = np.divmod(at[i:i + step], len(c_ids))
            with np.errstate(over="ignore", invalid="ignore"):
                exact = np.einsum("ij,ij->i", self.vectors[rows[row]], vectors[col])
            keep = np.isfinite(exact) & (exact >= floor[row])
            if self.exclude_self:
                keep &= self.ids[rows[row]] != c_ids[col]
            found.append((rows[row[keep]], c_ids[col[keep]], exact[keep]))
        return found

    def _keep(self, chunk: int, waiting: list[tuple]) -> None:
        for part in waiting:
            if len(part[0]):
                row, _, score = self.held[chunk] = _merge(self.held[chunk], part, self.k)
                last = np.flatnonzero(row[self.k - 1:] == row[:len(row) - self.k + 1]) if len(row) >= self.k else []
                self.floor[row[last]] = np.maximum(self.floor[row[last]], score[self.k - 1:][last])

    def found(self) -> tuple:
        """Query ids, corpus ids, scores."""
        rows, ids, scores = (np.concatenate([h[n] for h in self.held]) if self.held else np.empty(0, t)
                             for n, t in enumerate((np.int64, np.int64, np.float64)))
        return self.ids[rows], ids, scores


def _topk_rows(q_ids, q_mat, c_ids, c_mat, k, exclude_self):
    """The k best of a corpus block for every query."""
    best = Best(q_ids, q_mat, k, exclude_self)
    best.see(c_ids, c_mat)
    return best.found()


def _merge(acc, part, k):
    """The k best of each query, of two lists of which one is not empty."""
    q = np.concatenate([acc[0], part[0]])
    c = np.concatenate([acc[1], part[1]])
    s = np.concatenate([acc[2], part[2]])
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    first = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = rank < k
    return q[keep], c[keep], s[keep]


KNN_SCHEMA = "query_id long, corpus_id long, score double"


def knn(queries: DataFrame, corpus: DataFrame, k: int = 5, *, q_id: str = "vec_id",
        q_vec: str = "embedding", c_id: str = "vec_id", c_vec: str = "embedding",
        exclude_self: bool = False, max_broadcast_bytes: int = KNN_BROADCAST_BYTES,
        block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, corpus_id, score) for the k highest inner products per
    query; ties go to the smaller corpus id. Vectors that are NULL, hold a NULL, NaN or infinity,
    or are not as long as most corpus vectors are neither queries nor found.

    Queries of at most ``max_broadcast_bytes`` go to every task that reads the corpus; more of them are
    dealt with the corpus by ``vector_cells.knn_cells``, which skips cells that cannot matter."""
    dims = vector_length(corpus, c_vec)
    q = usable(queries, q_id, q_vec, dims).toDF("qid", "qv")
    c = usable(corpus, c_id, c_vec, dims).toDF("cid", "cv")
    if q.count() * max(dims, 1) * 8 > max_broadcast_bytes:
        from tremolo.operators.vector_cells import knn_cells
        return knn_cells(q, c, k, q_id="qid", q_vec="qv", c_id="cid", c_vec="cv",
                         exclude_self=exclude_self, block_rows=block_rows)
    partial = _knn_broadcast(q, c, k, exclude_self)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("corpus_id"))
    return (partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "corpus_id", "score"))


def _knn_broadcast(q: DataFrame, c: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    spark = q.sparkSession
    rows = q.toArrow()  # bounded: the caller checked the query side's size
    dims = len(rows["qv"][0]) if rows.num_rows else 0
    bq = spark.sparkContext.broadcast((rows["qid"].to_numpy(), matrix(rows["qv"], dims)))

    def score(batches):
        ids, vectors = bq.value
        best = Best(ids, vectors, k, exclude_self)
        for batch in batches:
            if batch.num_rows and len(ids):
                best.see(batch["cid"].to_numpy(), matrix(batch["cv"], vectors.shape[1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(best.found(), (pa.int64(), pa.int64(), pa.float64()), strict=True)],
            names=["query_id", "corpus_id", "score"])

    return c.mapInArrow(score, KNN_SCHEMA)


def context_text(hits: DataFrame, texts: DataFrame, question: DataFrame | None = None, *,
                 text_col: str = "text", header: str = PROMPT_HEADER,
                 footer: str = PROMPT_FOOTER) -> DataFrame:
    """Retrieved rows -> their texts (equi-join on corpus id) -> one context
    per query in rank order; with ``question`` (query_id, question) the prompt is
    assembled as header, rows, blank line, question, footer."""
    j = hits.join(texts.withColumnRenamed(texts.columns[0], "corpus_id"), "corpus_id")
    ctx = j.groupBy("query_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", text_col))), lambda s: s[text_col]),
        "\n").alias("context"))
    if question is None:
        return ctx
    return ctx.join(question, "query_id").withColumn("prompt", prompt_text(
        F.col("context"), F.col("question"), header, footer))


def prompt_text(context: Column, question: Column, header: str = PROMPT_HEADER,
                footer: str = PROMPT_FOOTER) -> Column:
    """Header, rows, blank line, question, footer."""
    return F.concat(F.lit(header + "\n"), context, F.lit("\n\nSoru: "), question,
                    F.lit("\n" + footer))
