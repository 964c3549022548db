"""Quality rules by a hashed n-gram likelihood ratio (operator 7).

Two multinomials over ``BUCKETS`` hashed word n-grams (single words and pairs) are counted:
one over trusted documents (``labels.quality = 1``), one over the whole raw corpus. A
document's score is the mean over its n-grams of log(p_trusted / p_raw), and it is kept
when the score reaches a fixed threshold and no base rule fails, so every document is
decided alone and alike in every run.

Scale: the raw counts cover every document; each task adds up its own histogram (at most
``BUCKETS`` rows leave it) before the shuffle. Trusted documents are a bounded sample,
the ``TRUSTED`` ids with the smallest hash, so the broadcast id list is bounded too. The
finished model is ``BUCKETS`` numbers. Scoring is one map over the documents.

Cases: a null or empty text has no words, fails the base rule (fewer than 10 words) and
scores 0; without any trusted document both multinomials are the raw one and every score is
0; repeated rows are scored alike; labels of unknown documents, null labels and repeated
labels change nothing else. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import add_columns
from tremolo.llm.tokens import SPACE_WORD, Slice, mix64, slices, span_hashes, window_hashes

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
TRUSTED = 20_000
THRESHOLD = -0.1
PRIOR = 20.0  # pseudo-counts of each bucket: rare n-grams, seen or not, say little
MIN_WORDS = 10
MAX_REPEATED = 20  # percent of words in repeated 5-word windows
SYMBOLS = b"#*$%&|<>"


def buckets(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and of every pair of neighbouring words of one row."""
    shift = np.uint64(64 - BUCKET_BITS)
    with np.errstate(over="ignore"):
        pairs = mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
    pairs = pairs[rows[:-1] == rows[1:]]
    return (hashes >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        marks = np.array(batch["trusted"].to_pylist(), dtype=bool)
        for s in slices(batch["text"]):
            words = s.words(SPACE_WORD)
            hashes, mark = words.hashes(), marks[s.first:s.first + s.rows]
            of = mark[words.row]
            for keep, into in ((slice(None), raw), (of, trusted)):
                for b in buckets(hashes[keep], words.row[keep]):
                    into += np.bincount(b, minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(x, pa.int64()) for x in (at, raw[at], trusted[at])],
        names=["bucket", "raw", "trusted"])


def trusted_ids(labels: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """Ids labelled as good; beyond ``limit`` those with the smallest hash."""
    ids = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def likelihood_ratios(docs: DataFrame, labels: DataFrame, limit: int = TRUSTED) -> np.ndarray:
    """log(p_trusted / p_raw) of every bucket, from counts over all documents."""
    ids = trusted_ids(labels, limit).withColumn("trusted", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select(
        "text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    counts = marked.mapInArrow(_histograms, "bucket long, raw long, trusted long").groupBy(
        "bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # at most BUCKETS rows
        raw[r.bucket], good[r.bucket] = r.raw, r.trusted
    expected = raw * (good.sum() / max(1.0, raw.sum()))  # were the trusted texts like all
    return np.log((good + PRIOR) / (expected + PRIOR))


def _per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, key) pairs: is it found elsewhere in its row; is it an earlier one's repeat."""
    order = np.lexsort((keys, rows)) if len(keys) else np.zeros(0, np.int64)
    same = (keys[order][1:] == keys[order][:-1]) & (rows[order][1:] == rows[order][:-1])
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = later[order[1:][same]] = True
    return twice, later


def measure(s: Slice, ratios: np.ndarray | None) -> dict[str, np.ndarray]:
    """Base counts and score of every row of a slice."""
    words = s.words(SPACE_WORD)
    n, hashes = words.counts(), words.hashes()
    lead = (s.data & 0xC0) != 0x80  # first bytes of code points
    inside = SPACE_WORD[s.data] & lead
    symbol = np.isin(s.data, np.frombuffer(SYMBOLS, dtype=np.uint8))

    breaks = np.flatnonzero(s.data == 0x0A)
    starts = np.sort(np.concatenate((s.offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((s.offsets[1:], breaks)))
    full = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[full], ends[full]
    line_row = np.searchsorted(s.offsets, starts, side="right") - 1
    repeated_line = _repeats(span_hashes(s.data, starts, ends), line_row)[1]

    whole = np.flatnonzero(words.window_rows(5))
    twice = _repeats(window_hashes(hashes, 5)[whole], words.row[whole])[0]
    step = np.zeros(len(words.row) + 1, np.int64)
    np.add.at(step, whole[twice], 1)
    np.subtract.at(step, whole[twice] + 5, 1)
    in_repeat = np.cumsum(step[:-1]) > 0

    score = np.zeros(s.rows)
    if ratios is not None:
        singles, pairs = buckets(hashes, words.row)
        pair_row = words.row[:-1][words.row[:-1] == words.row[1:]]
        score = np.bincount(words.row, ratios[singles], s.rows) + np.bincount(
            pair_row, ratios[pairs], s.rows)
        score = score / np.maximum(1, n + np.maximum(0, n - 1))
    return {
        "n_words": n, "word_chars": _per_row(inside, s.offsets),
        "n_symbols": _per_row(symbol, s.offsets),
        "n_dup_lines": np.bincount(line_row[repeated_line], minlength=s.rows),
        "n_repeat_words": _per_row(in_repeat, words.first),
        "score": np.round(score, 9),
    }


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  keep_text: bool = True) -> DataFrame:
    """``docs`` with the base counts, ``score``, ``base_failed`` and ``kept``."""
    ratios = likelihood_ratios(docs, labels)
    fields = [T.StructField(c, T.LongType()) for c in
              ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    out = add_columns(docs, measure, [*fields, T.StructField("score", T.DoubleType())],
                      keep_text, lambda: ratios)
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold))
