"""Line dedup over a sharded minimal perfect hash (operator 12).

A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least
``LEAST_CHARS`` code points found in at least ``LEAST_DOCS`` documents lose all their lines, except
in the largest document that holds them.

(1) Every document's distinct keys, as two 64-bit hashes, are counted: slices of text
pre-aggregate, then one aggregation gives the documents of a key and the largest of them.
(2) The keys that may lose lines are indexed in shards of at most about ``SHARD_KEYS`` keys and
``PROBES_PER_KEY`` times as many probes. A shard is a
minimal perfect hash (levels of bits: a key sits in the first level where no other key of the shard wants its
bit, its number is the count of bits set before it) over three arrays: the key's fingerprint (its second
hash, all 64 bits), its count of documents, in the smallest integer type that holds them, and its
largest document. (3) The keys of all documents are sent to their shard, 16 bytes of hash
and 16 of row key each, never the lines themselves, and probe its arrays. Keys found come back to
the documents, which are read once more and cut.

Hot keys: keys that hold ``HOT_SHARE`` of all (document, key) pairs or more, so at most
``1 / HOT_SHARE`` of them, form a front shard that every task carries (24 bytes a key, proven to
be under 2 MB); their lines are decided where the text is read and are sent nowhere. Every
other key has less than ``HOT_SHARE`` of the pairs, so shards are even.

Cases: null and empty texts are one empty line, which is too short to be lost; a null id is a document
smaller than any other, and where all holders are null ids all of them keep the line; rows that repeat an id are
documents of their own, and all rows with the largest id keep their lines; an empty table gives an
empty result; input columns that clash with the new ones are replaced. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import add_columns, cut
from tremolo.llm.tokens import LOWER, SPACE_WORD, mix64, slices, span_hashes

LEAST_CHARS = 20
LEAST_DOCS = 3
SHARD_KEYS = 1 << 17
PROBES_PER_KEY = 8  # a shard meets at most as many times SHARD_KEYS pairs, on average
HOT_SHARE = 1 / (1 << 16)
LEVELS = 64
SLICE = 1 << 20  # bytes of text worked on at a time
NO_ID = -(1 << 63)  # a null id, in the arrays
_PRINT_BASE = 0xC2B2AE3D27D4EB4F
_U = np.uint64

_COUNTED = "hash long, print long, docs long, largest long"
_INDEX = "shard long, sizes binary, bits binary, prints binary, counts binary, width int, largest binary"
_HITS = "row_id long, row_text long, hash long"


class Lines:
    """Lines of a slice: byte spans, keys' hashes, rows, and which are long enough to be lost."""

    def __init__(self, s, least: int):
        data, n = s.data, len(s.data)
        breaks = np.flatnonzero(data == 0x0A)
        # a line begins at each row's start and behind each \n of the row
        row_of_break = np.searchsorted(s.offsets, breaks, side="right") - 1
        row = np.concatenate((np.arange(s.rows), row_of_break))
        start = np.concatenate((s.offsets[:-1], breaks + 1))
        order = np.lexsort((start, row))
        self.row, self.start = row[order], start[order]
        self.end = np.empty(len(start), np.int64)
        self.end[:-1] = self.start[1:] - 1
        last = np.ones(len(start), bool)
        last[:-1] = self.row[1:] != self.row[:-1]
        self.end[last] = s.offsets[1:]
        solid = np.flatnonzero(SPACE_WORD[data])
        lo = np.searchsorted(solid, self.start)
        hi = np.searchsorted(solid, self.end)
        empty = lo == hi
        if len(solid):
            first = np.where(empty, self.start, solid[np.minimum(lo, len(solid) - 1)])
            behind = np.where(empty, self.start, solid[np.maximum(hi, 1) - 1] + 1)
        else:
            first = behind = self.start
        points = np.zeros(n + 1, np.int32)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        self.long = np.flatnonzero(points[behind] - points[first] >= least)
        lower = LOWER[data]
        a, b = first[self.long], behind[self.long]
        self.hash = span_hashes(lower, a, b)
        self.print = span_hashes(lower, a, b, _PRINT_BASE)
        self.first = np.searchsorted(self.row, np.arange(s.rows + 1))

    def of_documents(self) -> np.ndarray:
        """One of the long lines for every (row, key)."""
        row = self.row[self.long]
        order = np.lexsort((self.print, self.hash, row))
        new = np.ones(len(order), bool)
        h, p, row = self.hash[order], self.print[order], row[order]
        new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1]) | (row[1:] != row[:-1])
        return order[new]


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64))


def _counted(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch["doc_id"])
            for s in slices(batch["text"], SLICE):
                lines = Lines(s, least)
                mine = lines.of_documents()
                if not len(mine):
                    continue
                h, p = lines.hash[mine], lines.print[mine]
                doc = ids[s.first + lines.row[lines.long[mine]]]
                order = np.lexsort((p, h))
                h, p, doc = h[order], p[order], doc[order]
                first = np.flatnonzero(np.concatenate((
                    [True], (h[1:] != h[:-1]) | (p[1:] != p[:-1]))))
                # the last row, without a key, counts all pairs
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*column.tolist(), total], pa.int64()) for column, total in (
                        (h[first].astype(np.int64), None), (p[first].astype(np.int64), None),
                        (np.diff(np.concatenate((first, [len(h)]))), len(h)),
                        (np.maximum.reduceat(doc, first), NO_ID))],
                    names=["hash", "print", "docs", "largest"])
    return run


def count_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """hash, print, docs, largest: the long keys, their documents, and the largest of those;
    without a hash: the number of all (document, key) pairs."""
    return docs.select("doc_id", "text").mapInArrow(_counted(least_chars), _COUNTED).groupBy(
        "hash", "print").agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest"))


def _bit(hashes: np.ndarray, prints: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = mix64(hashes + mix64(prints ^ (_U(level + 1) * _U(0x9E3779B97F4A7C15))))
    return (mixed % _U(size)).astype(np.int64)


class Shard:
    """A minimal perfect hash over (hash, print) keys, and arrays by the number it gives."""

    def __init__(self, sizes, bits, prints, counts, largest):
        self.sizes, self.bits = sizes, bits
        self.prints, self.counts, self.largest = prints, counts, largest
        self.rank = np.concatenate(([0], np.cumsum(bits)))
        self.begin = np.concatenate(([0], np.cumsum(sizes)))

    @classmethod
    def build(cls, hashes, prints, counts, largest) -> Shard:
        sizes, levels = [], []
        number = np.full(len(hashes), -1, np.int64)
        todo, base = np.arange(len(hashes)), 0
        for level in range(LEVELS):
            if not len(todo):
                break
            size = 2 * len(todo)
            at = _bit(hashes[todo], prints[todo], level, size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            placed = alone[at]
            number[todo[placed]] = base + np.cumsum(alone)[at[placed]] - 1
            base += int(alone.sum())
            sizes.append(size)
            todo = todo[~placed]
        if len(todo):  # two equal keys: cannot be, they were grouped
            raise ValueError("keys of a shard are not distinct")
        by_number = np.argsort(number)
        width = np.min_scalar_type(int(counts.max()) if len(counts) else 0)
        return cls(np.array(sizes, np.int64),
                   np.concatenate(levels) if levels else np.zeros(0, bool),
                   prints[by_number], counts[by_number].astype(width), largest[by_number])

    def find(self, hashes: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for those that are not in the shard."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(todo):
                break
            at = self.begin[level] + _bit(hashes[todo], prints[todo], level, size)
            sits = self.bits[at]
            number = self.rank[at[sits]]
            out[todo[sits]] = np.where(self.prints[number] == prints[todo[sits]], number, -1)
            todo = todo[~sits]
        return out

    def lost(self, hashes, prints, docs, least: int) -> np.ndarray:
        """Which keys, each held by a document, lose their lines there."""
        number = self.find(hashes, prints)
        return (number >= 0) & (self.counts[number] >= least) & (
            self.largest[number] != docs) if len(self.prints) else np.zeros(len(hashes), bool)

    def row(self, shard: int) -> list:
        return [shard, self.sizes.tobytes(), np.packbits(self.bits).tobytes(),
                self.prints.tobytes(), self.counts.tobytes(), self.counts.dtype.itemsize,
                self.largest.tobytes()]

    @classmethod
    def of_row(cls, sizes: bytes, bits: bytes, prints: bytes, counts: bytes, width: int,
               largest: bytes) -> Shard:
        size = np.frombuffer(sizes, np.int64)
        return cls(size, np.unpackbits(np.frombuffer(bits, np.uint8),
                                       count=int(size.sum())).astype(bool),
                   np.frombuffer(prints, np.uint64), np.frombuffer(counts, f"u{width}"),
                   np.frombuffer(largest, np.int64))


def _built(table: pa.Table) -> pa.Table:
    column = {c: table[c].to_numpy() for c in ("hash", "print", "docs", "largest")}
    made = Shard.build(column["hash"].astype(np.uint64), column["print"].astype(np.uint64),
                       column["docs"], column["largest"])
    values = made.row(table["shard"][0].as_py())
    return pa.table([pa.array([v], k) for v, k in zip(values, [
        pa.int64(), *[pa.binary()] * 4, pa.int32(), pa.binary()], strict=True)],
        names=["shard", "sizes", "bits", "prints", "counts", "width", "largest"])


def index_keys(keys: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of the counted keys: the hash's levels and the arrays."""
    return keys.withColumn("shard", F.pmod("hash", F.lit(shards))).groupBy("shard").applyInArrow(
        _built, _INDEX)


def _probes(least_chars: int, least: int, front: Shard, shards: int):
    """Keys of the documents that the front shard does not hold, with shard and row key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch["doc_id"])
            texts = batch["row_text"].to_numpy(zero_copy_only=False)
            for s in slices(batch["text"], SLICE):
                lines = Lines(s, least_chars)
                mine = lines.of_documents()
                mine = mine[front.find(lines.hash[mine], lines.print[mine]) < 0]
                if not len(mine):
                    continue
                row = s.first + lines.row[lines.long[mine]]
                h = lines.hash[mine].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h % shards), pa.array(h), _long(lines.print[mine]),
                     pa.array(ids[row]), pa.array(texts[row])],
                    names=["shard", "hash", "print", "row_id", "row_text"])
    return run


def _probed(least: int):
    def run(key, index: pa.Table, probes: pa.Table) -> pa.Table:
        got = probes.select(["row_id", "row_text", "hash"])
        if not index.num_rows or not probes.num_rows:
            return got.slice(0, 0)
        shard = Shard.of_row(*[index[c][0].as_py() for c in (
            "sizes", "bits", "prints", "counts", "width", "largest")])
        lost = shard.lost(*[probes[c].to_numpy().astype(np.uint64) for c in ("hash", "print")],
                          probes["row_id"].to_numpy(), least)
        return got.filter(pa.array(lost))
    return run


def _cutter(least_chars: int, least: int, front: Shard):
    def remove(s, state) -> dict[str, list]:
        lines = Lines(s, least_chars)
        ids = _ids(s.part["doc_id"])
        gone = np.zeros(len(lines.row), bool)
        if len(lines.long):
            row = lines.row[lines.long]
            gone[lines.long] = front.lost(lines.hash, lines.print, ids[row], least)
            hits = s.part["hits"]
            sizes = pc.fill_null(pc.list_value_length(hits), 0).to_numpy(zero_copy_only=False)
            flat = pc.list_flatten(hits).to_numpy(zero_copy_only=False)
            if len(flat):
                # (row, key) pairs, as one 64-bit number each
                have = mix64(flat.astype(np.uint64) + mix64(np.repeat(
                    np.arange(s.rows), sizes).astype(np.uint64)))
                mine = mix64(lines.hash + mix64(row.astype(np.uint64)))
                gone[lines.long] |= np.isin(mine, have)
        got: dict[str, list] = {"n_lines": np.diff(lines.first), "n_dropped": [], "kept_text": []}
        for r in range(s.rows):
            lo, hi = lines.first[r], lines.first[r + 1]
            dropped = int(gone[lo:hi].sum())
            text = s.text(r)
            if dropped:
                text = b"\n".join([x for x, g in zip(text.split(b"\n"), gone[lo:hi].tolist(),
                                                     strict=True) if not g])
            got["n_dropped"].append(dropped)
            got["kept_text"].append(text.decode())
        return got
    return remove


def drop_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
               shard_keys: int = SHARD_KEYS, hot_share: float = HOT_SHARE) -> DataFrame:
    """``docs`` without ``text``, with n_lines (before), n_dropped and kept_text."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.xxhash64("text").alias("row_text"))
    counted = count_keys(keyed, least_chars)
    # keys of fewer documents lose no line
    kept = cut(counted.where((F.col("docs") >= least_docs) | F.col("hash").isNull()))
    n_keys, pairs = kept.agg(F.count("hash"), F.coalesce(
        F.max(F.when(F.col("hash").isNull(), F.col("docs"))), F.lit(0))).first()
    keys = kept.where("hash IS NOT NULL")
    limit = max(float(least_docs), pairs * hot_share)
    hot = keys.where(F.col("docs") >= limit).toArrow()  # at most 1 / hot_share rows
    front = Shard.build(*[hot[c].to_numpy().astype(np.uint64) for c in ("hash", "print")],
                        *[hot[c].to_numpy() for c in ("docs", "largest")])
    shards = max(1, -(-n_keys // shard_keys), -(-pairs // (PROBES_PER_KEY * shard_keys)))
    index = index_keys(keys.where(F.col("docs") < limit), shards)
    probes = keyed.mapInArrow(_probes(least_chars, least_docs, front, shards),
                              "shard long, hash long, print long, row_id long, row_text long")
    hits = index.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(
        _probed(least_docs), _HITS)
    listed = hits.groupBy("row_id", "row_text").agg(F.collect_set("hash").alias("hits"))
    plain = docs.drop("hits")
    on = (F.coalesce(F.col("a.doc_id").cast("long"), F.lit(NO_ID)) == F.col("b.row_id")) & (
        F.xxhash64("a.text") == F.col("b.row_text"))
    met = plain.alias("a").join(listed.alias("b"), on, "left").select("a.*", "b.hits")
    return add_columns(met, _cutter(least_chars, least_docs, front), [
        T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
        T.StructField("kept_text", T.StringType())], keep_text=False, limit=SLICE).drop("hits")
