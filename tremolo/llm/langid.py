"""Language ID by rank-order profiles of character n-grams (operator 10).

A language's profile is its ``PROFILE`` most frequent n-grams (one to three letters, words
padded by a blank on either side), ranked. A document is compared by its own most frequent
n-grams: each adds the distance between its two ranks, or ``PROFILE`` if the profile lacks
it, and the language with the least sum wins (ties: the first by name).
The score is ``1 - distance / worst possible distance``.

Letters are Unicode letters, lower-cased one by one; an n-gram is known by a 40-bit hash, and
n-grams of equal count rank by that hash, so profiles do not depend on partitioning.

Scale: counts for the profiles cover every training document; each slice counts its
n-grams by sorting before the shuffle, the result has languages x PROFILE rows.
Prediction is a map over whole texts without any shuffle.

Cases: ``und`` with score 0 if the text is null, empty or without a letter, or nothing was
learned; rows with a null ``lang`` are not learned from; rows with a null id count as
not held out and, as their remainder is unknown, are not learned from either; repeated
rows are learned from as often as they occur; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import add_columns
from tremolo.llm.tokens import Slice, mix64, pieces, slices

PROFILE = 300
LENGTHS = (1, 2, 3)
GRAM_BITS = 40
UNKNOWN = "und"
SLICE = 1 << 20


@cache
def folding() -> np.ndarray:
    """Code point -> its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


#: ASCII bytes that are no letters: no n-gram reaches across one
_BETWEEN = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])


def grams(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, n-gram and count of every distinct (row, n-gram) of a slice, sorted by row. A long
    text is counted in pieces between words."""
    parts = [_grams(part) for part, _ in pieces(s, SLICE, 0, _BETWEEN)]
    if len(parts) == 1:
        return parts[0]
    gram, inverse = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    count = np.bincount(inverse, np.concatenate([p[2] for p in parts]), len(gram)).astype(np.int64)
    return np.zeros(len(gram), np.int64), gram, count


def _grams(s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lead = (s.data & 0xC0) != 0x80
    points = np.frombuffer(s.data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    first = np.concatenate(([0], np.cumsum(lead)))[s.offsets]  # code point of each row's start
    folded = folding()[points]
    row = np.repeat(np.arange(s.rows), np.diff(first))
    # letters with one blank between words and at either end of a row (blank: 0)
    keep = folded > 0
    edge = np.ones(len(row), dtype=bool)
    edge[1:] = (row[1:] != row[:-1]) | ~keep[:-1]
    begin = keep & edge
    at = np.cumsum(keep) + np.cumsum(begin) - 1
    n = int(at[-1]) + 2 if len(at) and keep.any() else 0
    line, owner = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
    line[at[keep]] = folded[keep]
    owner[at[keep]] = row[keep]
    owner[at[begin] - 1] = row[begin]  # the blank before a word
    keys = []
    for k in LENGTHS:
        m = n - k + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint64)
        for i in range(k):
            code = (code << np.uint64(21)) | line[i:i + m]
        real = code != 0
        # an n-gram belongs to the row of its first letter or of the blank before it
        own = owner[:m].copy()
        if k > 1:
            # a blank that ends one word and begins the next row's: no n-gram goes across
            for i in range(1, k):
                other = owner[i:i + m]
                real &= (other == own) | (line[i:i + m] == 0)
                if i < k - 1:
                    real &= line[i:i + m] != 0
        code, own = code[real], own[real]
        gram = mix64(code * np.uint64(4) + np.uint64(k)) >> np.uint64(64 - GRAM_BITS)
        keys.append((own.astype(np.uint64) << np.uint64(GRAM_BITS)) | gram)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = np.sort(np.concatenate(keys))
    new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    count = np.diff(np.concatenate((new, [len(every)])))
    every = every[new]
    return ((every >> np.uint64(GRAM_BITS)).astype(np.int64),
            (every & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int64), count)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch["lang"].to_pylist(), dtype=object)
        for s in slices(batch["text"], SLICE):
            row, gram, n = grams(s)
            mine = langs[s.first:s.first + s.rows]
            for lang in sorted(set(mine)):
                of = (mine == lang)[row]
                g, inverse = np.unique(gram[of], return_inverse=True)
                if len(g):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()),
                         pa.array(np.bincount(inverse, n[of]).astype(np.int64))],
                        names=["lang", "gram", "n"])


def profiles(train: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, rank (from 0): the most frequent n-grams of every language."""
    counts = train.select("lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").mapInArrow(
        _count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(
        F.col("rank") < size).select("lang", "gram", "rank")


def _top(row: np.ndarray, gram: np.ndarray, n: np.ndarray, size: int):
    """The ``size`` most frequent n-grams of every row with their ranks."""
    order = np.lexsort((gram, -n, row))
    row, gram = row[order], gram[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.concatenate((first, [len(row)]))))
    keep = rank < size
    return row[keep], gram[keep], rank[keep]


def _predictor(langs: list[str], tables: list[dict[int, int]], size: int):
    def predict(s: Slice, state) -> dict[str, list]:
        known, ranks = state
        row, gram, rank = _top(*grams(s), size)
        at = np.searchsorted(known, gram)
        at[at == len(known)] = 0
        hit = known[at] == gram if len(known) else np.zeros(len(gram), bool)
        distance = np.zeros((len(langs), s.rows))
        for k in range(len(langs)):
            place = np.where(hit, ranks[k][at], -1) if len(known) else np.full(len(gram), -1)
            out = np.where(place < 0, size, np.abs(place - rank))
            distance[k] = np.bincount(row, out, s.rows)
        n = np.bincount(row, minlength=s.rows)
        if not langs:
            return {"lang_pred": [UNKNOWN] * s.rows, "score": np.zeros(s.rows)}
        best = distance.argmin(axis=0)
        score = np.where(n > 0, 1 - distance.min(axis=0) / (np.maximum(n, 1) * size), 0.0)
        return {"lang_pred": [langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)],
                "score": np.round(score, 9)}

    def setup():
        known = np.array(sorted({g for t in tables for g in t}), dtype=np.int64)
        return known, [np.array([t.get(g, -1) for g in known.tolist()], dtype=np.int64)
                       for t in tables]
    return predict, setup


def predict_language(docs: DataFrame, profile_rows: DataFrame, size: int = PROFILE,
                     keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score."""
    by: dict[str, dict[int, int]] = {}
    for r in profile_rows.collect():  # languages x size rows
        by.setdefault(r.lang, {})[r.gram] = r.rank
    langs = sorted(by)
    predict, setup = _predictor(langs, [by[k] for k in langs], size)
    return add_columns(docs, predict, [T.StructField("lang_pred", T.StringType()),
                                       T.StructField("score", T.DoubleType())], keep_text, setup)


def held_out() -> F.Column:
    """True where crc32 of the id as text leaves 2 modulo 4; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """Learn profiles from the documents that are not held out, then label all of them."""
    found = predict_language(docs, profiles(docs.where(~held_out())), keep_text=keep_text)
    return found.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
