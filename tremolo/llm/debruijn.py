"""Substring dedup on a De Bruijn graph of words (operator 3).

Nodes are 12-word sequences, edges the 13-word windows that join them. An edge that also
starts in a document with a smaller id is repeated, and every word it covers is removed.

The graph is built in minimizer buckets, as compacting assemblers do: of the
``GRAM``-word grams of a window the one with the least hash names its bucket, so equal windows
always meet, and neighbouring windows mostly share a bucket. Consecutive windows of one
bucket travel as one path piece (bucket, document, place, edge hashes), which is what
makes the shuffle about a fifth of a row per word. In a bucket, sorted by document, an
edge is repeated where an earlier document has it. Repeated pieces come back as
coordinates, are joined to their document and glued there into maximal repeated paths,
whose words are cut from the text. An edge is known by 64 bits of its gram and
``EDGE_BYTES`` bytes of its own hash.

Scale: one shuffle of path pieces and one of the texts (to meet their coordinates). A
passage or document that is copied millions of times is no hot key: inside a slice of
about ``SLICE`` text bytes only the smallest document of an edge goes on, later ones are
decided on the spot, so an edge has at most one document per slice. The bucket stage streams
over sorted rows and holds the distinct edges of one gram at a time. A gram of very many
windows (boilerplate around which everything else varies) is no hot bucket either: a first pass
counts the windows of each gram, and the grams of more than ``HOT_SHARE`` of all windows (hence
at most ``1 / HOT_SHARE`` of them, and no fewer than ``HOT_EDGES`` windows each) spread their
windows over ``SPLIT`` buckets by the edge, so equal edges still meet.

Cases: null and empty texts have no words; documents with fewer than 13 words lose nothing;
a null id is neither smaller nor larger than another, so such rows stay whole and remove nothing;
rows repeating an id are compared by id only (neither is smaller), each against its own
text: texts that share an id are numbered; ids are integers; an empty table gives an empty result; input columns that
clash with the new ones, and ``starts``, ``counts`` and ``check``, are replaced or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import add_columns, cut
from tremolo.llm.tokens import (
    SPACE_WORD,
    binary_array,
    binary_bytes,
    covered,
    minima,
    mix64,
    packed,
    runs,
    slices,
    summed,
    unpacked,
    window_hashes,
)
from tremolo.operators.ordered import ranks

WINDOW = 13
GRAM = 5
EDGE_BYTES = 5
SLICE = 4 << 20
HOT_SHARE = 1 / (1 << 20)
HOT_EDGES = 1 << 17
LOCAL_EDGES = 16  # a task reports the grams of as many windows
SPLIT = 1 << 12
PLACE_BITS = 31  # low bits of a place: word number; high bits: number of the row among those of its id
PLACE = (1 << PLACE_BITS) - 1
FEW_ROWS = 1 << 17  # of at most so many numbered rows the numbers are broadcast

#: edges: ``EDGE_BYTES`` for each window of the piece; ``COUNT_BYTES`` alone: the number of
#: windows of a piece already decided
COUNT_BYTES = 4
_PIECE = "bucket long, doc_id long, place long, edges binary"
_SPAN = "doc_id long, place long, n int"


def _least(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each entry the smallest document with the same key."""
    if not len(keys):
        return docs
    order = np.argsort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    least = np.minimum.reduceat(docs[order], first)
    out = np.empty_like(docs)
    out[order] = np.repeat(least, np.diff(np.concatenate((first, [len(keys)]))))
    return out


class _Windows:
    """The windows of a slice: document and place, edge, bucket, and which of them go on."""

    def __init__(self, s, ids: np.ndarray, checks: np.ndarray, window: int, gram: int):
        words = s.words(SPACE_WORD)
        self.valid = words.window_rows(window)
        self.any = bool(self.valid.any())
        if not self.any:
            return
        hashes = words.hashes()
        self.edges = window_hashes(hashes, window)
        self.bucket = minima(window_hashes(hashes, gram), window - gram + 1)
        row = words.row[:len(self.valid)]
        self.doc = ids[s.first:s.first + s.rows][row]
        self.place = (checks[s.first:s.first + s.rows][row] << PLACE_BITS) | (
            np.arange(len(row)) - words.first[row])
        at = np.flatnonzero(self.valid)
        #: windows that a smaller document of this slice has
        self.here = np.zeros(len(self.valid), bool)
        self.here[at] = self.doc[at] > _least(self.edges[at], self.doc[at])
        self.going = self.valid & ~self.here
        self.new_row = np.concatenate(([True], row[1:] != row[:-1]))


def _windows(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[_Windows]:
    for batch in batches:
        ids = batch["doc_id"].to_numpy(zero_copy_only=False)
        checks = batch["check"].to_numpy(zero_copy_only=False)
        for s in slices(batch["text"], SLICE):
            got = _Windows(s, ids, checks, window, gram)
            if got.any:
                yield got


def _gram_counts(window: int, gram: int):
    """Windows by gram (of a task, ``LOCAL_EDGES`` or more) and, without a gram, all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total, full = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 1 << 20
        for w in _windows(batches, window, gram):
            mine, n = np.unique(w.bucket[w.going], return_counts=True)
            total += int(n.sum())
            often = n > 1  # a gram of one window in a slice is not a frequent one there
            keys, counts = np.concatenate((keys, mine[often])), np.concatenate((counts, n[often]))
            if len(keys) > full:
                keys, counts = summed(keys, counts)
                full = max(full, 2 * len(keys))
        if total:
            keys, counts = summed(keys, counts) if len(keys) else (keys, counts)
            often = counts >= LOCAL_EDGES
            yield pa.RecordBatch.from_arrays(
                [pa.array([*keys[often].astype(np.int64).tolist(), None], pa.int64()),
                 pa.array([*counts[often].tolist(), total], pa.int64())], names=["bucket", "n"])
    return run


def hot_grams(texts: DataFrame, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Sorted hashes of the grams with too many windows for one bucket; at most
    ``1 / HOT_SHARE`` numbers, whatever the corpus."""
    counted = texts.mapInArrow(_gram_counts(window, gram), "bucket long, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n"))
    counted = cut(counted.where(f"bucket IS NULL OR n >= {HOT_EDGES}"))
    total = counted.where("bucket IS NULL").first()
    limit = max(HOT_EDGES, (total["n"] if total else 0) * HOT_SHARE)
    rows = counted.where("bucket IS NOT NULL").where(F.col("n") >= limit).select("bucket").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).astype(np.uint64))


def _pieces(window: int, gram: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in _windows(batches, window, gram):
            doc, place, bucket = w.doc, w.place, w.bucket
            if len(hot):
                at = np.minimum(np.searchsorted(hot, bucket), len(hot) - 1)
                many = hot[at] == bucket
                part = mix64(w.edges[many]) % np.uint64(SPLIT)
                bucket[many] = mix64(bucket[many] ^ mix64(part + np.uint64(1)))
            first, n = runs(w.here, w.new_row)
            spread = mix64(place[first].astype(np.uint64) + doc[first].astype(np.uint64))
            yield _piece_batch(spread, doc[first], place[first], n, None)
            cuts = w.new_row | np.concatenate(([True], bucket[1:] != bucket[:-1]))
            first, n = runs(w.going, cuts)
            yield _piece_batch(bucket[first], doc[first], place[first], n, w.edges[w.going])
    return run


def _piece_batch(bucket, doc, place, n, edges) -> pa.RecordBatch:
    if edges is None:
        raw, lengths = packed(n.astype(np.uint64), COUNT_BYTES), np.full(len(n), COUNT_BYTES)
    else:
        raw, lengths = packed(edges, EDGE_BYTES), n * EDGE_BYTES
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket.astype(np.int64)), pa.array(doc), pa.array(place),
         binary_array(raw.ravel(), lengths)], names=["bucket", "doc_id", "place", "edges"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated path pieces, from pieces sorted by (bucket, document)."""
    open_bucket: int | None = None
    known, smallest = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, lengths = binary_bytes(batch["edges"])
        bucket = batch["bucket"].to_numpy(zero_copy_only=False)
        doc = batch["doc_id"].to_numpy(zero_copy_only=False)
        place = batch["place"].to_numpy(zero_copy_only=False)
        decided = lengths == COUNT_BYTES
        of = np.repeat(decided, lengths)
        yield _span_batch(doc[decided], place[decided],
                          unpacked(raw[of], COUNT_BYTES).astype(np.int64))
        raw = raw[~of]
        count = np.where(decided, 0, lengths // EDGE_BYTES)
        piece = np.repeat(np.arange(len(count)), count)
        offset = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            keys = mix64(bucket[piece].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                         + mix64(unpacked(raw, EDGE_BYTES)))
        docs = doc[piece]
        least = _least(keys, docs)
        if open_bucket is not None and len(known):  # the bucket the last batch ended in
            more = bucket[piece] == open_bucket
            at = np.minimum(np.searchsorted(known, keys[more]), len(known) - 1)
            least[more] = np.where(known[at] == keys[more],
                                   np.minimum(least[more], smallest[at]), least[more])
        gone = docs > least
        first, length = runs(gone, np.concatenate(([True], piece[1:] != piece[:-1]))[:len(gone)])
        yield _span_batch(docs[first], place[piece[first]] + offset[first], length)
        last = int(bucket[-1])
        of = bucket[piece] == last
        fresh, some = keys[of], least[of]
        if last == open_bucket:
            fresh, some = np.concatenate((known, fresh)), np.concatenate((smallest, some))
        known, index = np.unique(fresh, return_index=True)
        smallest, open_bucket = _least(fresh, some)[index] if len(fresh) else some, last


def _span_batch(doc, place, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(place), pa.array(n.astype(np.int32))],
        names=["doc_id", "place", "n"])


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``check``: 0, or for texts that share an id their number in order of a 64-bit
    hash. Rows that agree in id and text share the number, and lose the same words."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash")).distinct()
    many = texts.groupBy("_id").count().where("count > 1").select("_id")
    shared = cut(texts.join(many, "_id", "left_semi"))
    n = shared.count()
    if not n:
        return docs.withColumn("check", F.lit(0).cast("long"))
    numbers = ranks(shared, "_id", ("_hash",), "_number")
    met = docs.drop("_id", "_hash", "_number").alias("a").join(
        F.broadcast(numbers) if n <= FEW_ROWS else numbers, (F.col("a.doc_id").cast("long") == F.col("_id"))
        & (F.xxhash64("a.text") == F.col("_hash")), "left")
    return met.select("a.*", F.coalesce("_number", F.lit(0).cast("long")).alias("check"))


def repeated_paths(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, place, n: runs of n repeated windows and where they start (number of the row and word);
    ``docs`` are numbered."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "check")
    pieces = texts.mapInArrow(_pieces(window, gram, hot_grams(texts, window, gram)), _PIECE)
    return pieces.repartition("bucket").sortWithinPartitions("bucket", "doc_id").mapInArrow(
        _repeated, _SPAN)


def _cutter(window: int):
    def cut_words(s, state) -> dict[str, list]:
        got: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": []}
        starts, counts = s.part["starts"], s.part["counts"]
        for row in range(s.rows):
            words = s.text(row).split()
            at = starts[row].as_py()
            removed = 0
            if at:
                first = np.array(at, dtype=np.int64)
                gone = covered(first, first + np.array(counts[row].as_py()) + window - 1,
                               len(words))
                removed = int(gone.sum())
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            else:
                kept = words
            got["n_words"].append(len(words))
            got["n_removed"].append(removed)
            got["kept_text"].append(b" ".join(kept).decode())
        return got
    return cut_words


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without ``text``, with n_words, n_removed and kept_text."""
    known = numbered(docs.drop("starts", "counts", "check"))
    spans = repeated_paths(known, window).groupBy(
        "doc_id", F.shiftrightunsigned("place", PLACE_BITS).alias("check")).agg(
        F.collect_list(F.struct(F.col("place").bitwiseAND(F.lit(PLACE)).alias("start"),
                                F.col("n").cast("long").alias("n"))).alias("spans")).select(
        "doc_id", "check", F.col("spans.start").alias("starts"), F.col("spans.n").alias("counts"))
    met = known.alias("a").join(
        spans.alias("b"), (F.col("a.doc_id").cast("long") == F.col("b.doc_id"))
        & (F.col("a.check") == F.col("b.check")) & F.col("a.text").isNotNull(), "left").select(
        "a.*", "b.starts", "b.counts")
    out = add_columns(met.drop("check"), _cutter(window), [
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_text", T.StringType())], keep_text=False)
    return out.drop("starts", "counts")
