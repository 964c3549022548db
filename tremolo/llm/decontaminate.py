"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 1).

Patterns are word windows of benchmark items: every run of 13 consecutive words, or the
whole item if it is shorter. Documents and items are lower-cased (A-Z only) and cut into
words of letters, digits and non-ASCII characters. For each pattern length Wu and Manber's
tables hold, per block of two words, how far the search may move on (block shift table)
and, for blocks that end a pattern, the patterns to try (suffix-hash bucket, told apart by
a hash of their first block); a try compares the words' bytes directly.

Scale: one pass over the documents without any shuffle, as long as the items fit in one block
of ``BLOCK_BYTES`` of item text. A larger benchmark is dealt into ``ceil(item bytes / BLOCK_BYTES)`` blocks
by a hash of the (distinct) item, and its blocks are searched one after the other: each pass carries one block's
tables, which no later pass keeps, and writes the hits of the texts that have some to the shared folder; the hits
meet the documents in one join by the text's hash. So neither a task, the driver nor the plan grows
with the benchmark, only the number of passes.

Cases: null or empty texts have no words and are clean; an item without words is never
found; a null ``item_id`` still marks hits but cannot be listed; items sharing an id count
as one; repeated document rows each get their own result; an empty benchmark leaves
everything clean. Columns of the input other than those named are kept as they are.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import add_columns
from tremolo.llm.tokens import ALNUM_WORD, Slice, covered
from tremolo.session import checkpoint_path

WINDOW = 13
BLOCK_BYTES = 8 << 20

Pattern = tuple[tuple[bytes, ...], str | None]  # the words and the item they come from


def item_patterns(items: list[tuple[str | None, str | None]],
                  window: int = WINDOW) -> dict[int, dict[tuple[bytes, ...], set]]:
    """Distinct patterns by length, each with the ids of its items."""
    found: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        words = Slice(raw, np.array([0, len(raw)]), 0).words(ALNUM_WORD, lower=True)
        data = words.data.tobytes()
        w = [data[a:b] for a, b in zip(words.starts, words.ends, strict=True)]
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            found[size][tuple(w[i:i + size])].add(item_id)
    return found


def block_keys(hashes: np.ndarray, block: int) -> np.ndarray:
    """A key for the ``block`` words that end at each position."""
    keys = hashes.copy()
    if block == 2:
        with np.errstate(over="ignore"):
            keys[1:] += hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
    return keys


class WuManber:
    """Tables for patterns of one length, in words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], set]):
        self.length = length
        self.block = min(2, length)
        self.default = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, list[tuple[int, tuple[bytes, ...], set]]] = defaultdict(list)
        for words, ids in patterns.items():
            raw = b" ".join(words)
            data = np.frombuffer(raw, dtype=np.uint8)
            spans = Slice(data, np.array([0, len(data)]), 0).words(ALNUM_WORD)
            keys = block_keys(spans.hashes(), self.block).tolist()
            for end in range(self.block - 1, length):
                far = length - 1 - end
                self.shift[keys[end]] = min(far, self.shift.get(keys[end], self.default))
            self.buckets[keys[-1]].append((keys[self.block - 1], words, ids))

    def search(self, keys: list[int], words) -> Iterator[tuple[int, set]]:
        """Last word position and item ids of every occurrence; ``words(i, j)`` gives bytes."""
        at, n, back = self.length - 1, len(keys), self.length - self.block
        shift, default = self.shift.get, self.default
        while at < n:
            step = shift(keys[at], default)
            if step:
                at += step
                continue
            for first, pattern, ids in self.buckets[keys[at]]:
                if keys[at - back] == first and words(at - back - self.block + 1,
                                                      at + 1) == pattern:
                    yield at, ids
            at += 1


def _search_block(items: list[tuple[str | None, str | None]], window: int):
    """For ``add_columns``: n_words, hit_starts, hit_ends and hit_items of every text."""
    def setup() -> list[WuManber]:
        return [WuManber(n, p) for n, p in sorted(item_patterns(items, window).items())]

    def search(s: Slice, tables: list[WuManber]) -> dict[str, list]:
        n_words, starts, ends, ids = _search_slice(s, tables)
        return {"n_words": n_words, "hit_starts": starts, "hit_ends": ends,
                "hit_items": [sorted(x) for x in ids]}
    return search, setup


def _search_slice(s: Slice, tables: list[WuManber]):
    words = s.words(ALNUM_WORD, lower=True)
    hashes = words.hashes()
    data, w_start, w_end = words.data, words.starts, words.ends
    starts: list[list[int]] = [[] for _ in range(s.rows)]
    ends: list[list[int]] = [[] for _ in range(s.rows)]
    ids: list[set] = [set() for _ in range(s.rows)]
    for block in {t.block for t in tables}:
        keys = block_keys(hashes, block)
        for row in range(s.rows):
            lo, hi = int(words.first[row]), int(words.first[row + 1])
            mine = keys[lo:hi].tolist()

            def compared(i: int, j: int, lo: int = lo) -> tuple[bytes, ...]:
                return tuple(data[a:b].tobytes() for a, b in
                             zip(w_start[lo + i:lo + j], w_end[lo + i:lo + j], strict=True))

            for t in tables:
                if t.block == block and hi - lo >= t.length:
                    for at, found in t.search(mine, compared):
                        starts[row].append(at - t.length + 1)
                        ends[row].append(at + 1)
                        ids[row].update(x for x in found if x is not None)
    for row in range(s.rows):
        if starts[row]:  # overlapping hits become maximal spans
            inside = covered(np.array(starts[row]), np.array(ends[row]), max(ends[row]))
            edge = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
            starts[row] = np.flatnonzero(edge == 1).tolist()
            ends[row] = np.flatnonzero(edge == -1).tolist()
    return words.counts(), starts, ends, ids


_NUMBERS, _NAMES = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_starts", _NUMBERS),
           T.StructField("hit_ends", _NUMBERS), T.StructField("hit_items", _NAMES)]


def find_benchmark_text(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                        block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_starts / hit_ends (word spans holding benchmark windows;
    spans of several item blocks may overlap) and hit_items (ids, as strings)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def block(b: int) -> list[tuple[str | None, str | None]]:
        mine = items if blocks == 1 else items.where(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        return [(r.item_id, r.text) for r in mine.collect()]  # at most about block_bytes

    if blocks == 1:
        search, setup = _search_block(block(0), window)
        return add_columns(docs, search, _FIELDS, setup=setup)
    spark = docs.sparkSession
    path = checkpoint_path(spark, f"hits-{uuid.uuid4().hex}")
    key = [F.xxhash64("text").alias("_h"), F.hash("text").alias("_g"), F.octet_length("text").alias("_l")]
    texts = docs.where("text IS NOT NULL").select("text", *key)
    for b in range(blocks):
        search, setup = _search_block(block(b), window)
        add_columns(texts, search, _FIELDS, keep_text=False, setup=setup).where(
            F.size("hit_starts") > 0).drop("n_words").write.mode("append").parquet(path)
    # texts that occur in several rows were searched in each: their hits are the same
    spans = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("hit_starts", "hit_ends"))))
    found = spark.read.parquet(path).groupBy("_h", "_g", "_l").agg(
        spans.alias("_s"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("hit_items")))).alias("hit_items"))
    found = found.select("_h", "_g", "_l", F.col("_s.hit_starts").alias("hit_starts"),
                         F.col("_s.hit_ends").alias("hit_ends"), "hit_items")
    counted = add_columns(docs.drop("hit_starts", "hit_ends", "hit_items"), lambda s, _: {
        "n_words": s.words(ALNUM_WORD, lower=True).counts()}, _FIELDS[:1])
    own = [c for c in counted.columns if c not in ("_h", "_g", "_l")]
    met = counted.select(*own, *key).join(found, ["_h", "_g", "_l"], "left")
    none = F.array().cast("array<bigint>")
    return met.select(*own, *[F.coalesce(c, none).alias(c) for c in ("hit_starts", "hit_ends")],
                      F.coalesce("hit_items", F.array().cast("array<string>")).alias("hit_items"))


def n_hit() -> F.Column:
    """Words covered by the spans (which may overlap if there were several blocks)."""
    none = F.lit(0).cast("long")
    spans = F.array_sort(F.arrays_zip(F.col("hit_starts").alias("s"), F.col("hit_ends").alias("e")))
    return F.aggregate(spans, F.struct(none.alias("n"), none.alias("to")), lambda a, x: F.struct(
        (a["n"] + F.greatest(none, x["e"] - F.greatest(x["s"], a["to"]))).alias("n"),
        F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``find_benchmark_text`` with n_hit and the verdict: hits make a twentieth or more."""
    hit = F.col("n_hit")
    return find_benchmark_text(docs, benchmark).withColumn("n_hit", n_hit()).withColumn(
        "contaminated", (hit > 0) & (20 * hit >= F.col("n_words")))
