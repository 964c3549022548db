"""Periodic run detection with string synchronising sets (operator 11).

A run is a stretch of consecutive words with smallest period ``q`` and at least
``max(6, 4 * q)`` words that no neighbouring word extends keeping that period.

At every dyadic scale ``t`` the periods ``t <= q < 2 t`` are found from a synchronising set.
A window of ``t`` words has an identifier (a 64-bit hash, made from the hashes of its two halves);
place ``i`` is in the set if the least identifier of places ``i .. i + t`` is that of ``i`` or
of ``i + t``. Membership depends on the ``2 t`` words from ``i`` on only, so equal contexts have
equal places, and in a run a place and its copy one period later are both in the set. Places with equal contexts
whose distance to the next such place lies in the scale's range propose a period; the proposals
of one run form a chain whose contexts overlap, and the chain's ends are extended word by word,
by at most ``t`` words, as every ``t`` places of a run hold a place of the set.

Inside a highly periodic region (a window with a period of at most ``t / 4``) identifiers repeat and
the set would be dense, so those places are left out. The small periods that this omits are supplied
separately: periods below ``BASE`` are found by comparing the words with their copies
shifted by the period, larger ones at the smaller scales, and their runs of
``4 q`` words or more are just the regions left out above.

Scale: a document is worked on in the task that reads it, together with the others of its
slice of text (``SLICE_BYTES``), in O(n log n); nothing is shuffled. The memory of a task follows
its slice, or the longest text where that is larger (about 150 bytes a word).

Cases: null and empty texts have no words and no runs; a null id is a document like any other whose
words stay as they are; repeated rows are documents of their own; an empty table gives an
empty result; input columns that clash with the new ones are replaced.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tremolo.llm.common import add_columns
from tremolo.llm.tokens import SPACE_WORD, covered, minima, mix64

LEAST_WORDS = 6
LEAST_POWER = 4
BASE = 4  # smaller periods are found by shifts; the first scale
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType())
                                 for c in ("start", "length", "period")]))


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of every stretch of true places."""
    edge = np.diff(np.concatenate(([0], same.astype(np.int8), [0])))
    first = np.flatnonzero(edge == 1)
    return first, np.flatnonzero(edge == -1) - first


def _small_periods(words: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """(start, length, period) of the stretches with a smallest period below ``BASE``."""
    found = []
    for q in range(1, min(BASE, len(words))):
        same = (words[q:] == words[:-q]) & (row[q:] == row[:-q])
        first, n = _stretches(same)
        first, n = first[n + q >= LEAST_POWER * q], n[n + q >= LEAST_POWER * q] + q
        if q > 1:  # a period that divides q is 1, as q is 2 or 3
            more = words[first] != words[first + 1]
            for k in range(2, q):
                more |= words[first] != words[first + k]
            first, n = first[more], n[more]
        found.append(np.stack((first, n, np.full(len(first), q, np.int64)), axis=1))
    return found


def _equal_steps(words, row, left, right, step: int, limit: int) -> np.ndarray:
    """How often ``left + step, right + step`` are equal words of one row, up to ``limit``."""
    out = np.zeros(len(left), np.int64)
    alive = np.arange(len(left))
    for k in range(1, limit + 1):
        a, b = left[alive] + step * k, right[alive] + step * k
        ok = (a >= 0) & (b < len(words))
        a, b, alive = a[ok], b[ok], alive[ok]
        ok = (words[a] == words[b]) & (row[a] == row[b])
        # both neighbours must lie in the row they are compared for
        ok &= row[a] == row[left[alive]]
        alive = alive[ok]
        if not len(alive):
            break
        out[alive] = k
    return out


def _scale(words, row, last, ids, contexts, regions, t: int) -> np.ndarray:
    """(start, length, period) of the runs with ``t <= period < 2 t``.

    ``last``: the end of each word's row; ``ids``, ``contexts``: identifiers of the ``t`` and ``2 t``
    words from each place on; ``regions``: places whose window is highly periodic.
    """
    none = np.zeros((0, 3), np.int64)
    key = np.where(regions, _NONE, ids)
    least = minima(key, t + 1)
    at = np.arange(len(least))
    chosen = (at + 2 * t <= last[:len(least)]) & (least != _NONE)
    chosen &= (least == key[:len(least)]) | (least == key[t:t + len(least)])
    place = np.flatnonzero(chosen)
    if len(place) < 2:
        return none
    context = mix64(contexts[place] + row[place].astype(np.uint64) * _STEP)
    order = np.argsort(context, kind="stable")
    context, place = context[order], place[order]
    distance = np.where(context[1:] == context[:-1], place[1:] - place[:-1], 0)
    near = (distance >= t) & (distance < 2 * t)
    first, period = place[:-1][near], distance[near]
    if not len(first):
        return none
    order = np.lexsort((first, period))
    first, period = first[order], period[order]
    new = np.ones(len(first), bool)
    new[1:] = (period[1:] != period[:-1]) | (row[first[1:]] != row[first[:-1]]) | (
        first[1:] - first[:-1] > 2 * t)
    heads = np.flatnonzero(new)
    tails = np.concatenate((heads[1:], [len(first)])) - 1
    q, start, end = period[heads], first[heads], first[tails] + 2 * t  # copies of start .. end - 1
    start = start - _equal_steps(words, row, start, start + q, -1, t)
    end = end + _equal_steps(words, row, end - 1, end - 1 + q, 1, t)
    length = end + q - start
    good = length >= LEAST_POWER * q
    return np.unique(np.stack((start, length, q), axis=1)[good], axis=0)


def _highly_periodic(runs: np.ndarray, n: int, t: int) -> np.ndarray:
    """Places whose window of ``t`` words has a period of at most ``t / LEAST_POWER``."""
    small = runs[(runs[:, 2] * LEAST_POWER <= t) & (runs[:, 1] >= t)]
    return covered(small[:, 0], small[:, 0] + small[:, 1] - t + 1, n)


def find_runs(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs of the documents whose words (64-bit hashes) are ``words[first[r]:first[r + 1]]``:
    rows (start, length, period), places counted along ``words``; ordered by start and period."""
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    last = np.repeat(first[1:], counts)
    words = words.astype(np.uint64)
    found = _small_periods(words, row)
    runs = np.concatenate([np.zeros((0, 3), np.int64), *found])
    place = np.arange(len(words))  # of a kept word among all words
    ids, t = mix64(words), 1
    here, here_row, here_last = words, row, last
    while len(here):
        if t >= BASE:
            regions = _highly_periodic(runs, len(words), t)[place]
            contexts = _joined(ids, t)
            got = _scale(here, here_row, here_last, ids, contexts, regions, t)
            got[:, 0] = place[got[:, 0]]
            runs = np.concatenate((runs, got))
            ids = contexts
        else:
            ids = _joined(ids, t)
        t *= 2
        long = counts[here_row] >= LEAST_POWER * t
        if not long.all():
            here, here_row, ids, place = here[long], here_row[long], ids[long], place[long]
            size = np.bincount(here_row, minlength=len(counts))
            here_last = np.repeat(np.cumsum(size), size)
    runs = runs[runs[:, 1] >= np.maximum(LEAST_WORDS, LEAST_POWER * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _joined(ids: np.ndarray, t: int) -> np.ndarray:
    """Identifiers of ``2 t`` words from those of ``t`` (places without as many words: anything)."""
    right = np.zeros(len(ids), np.uint64)
    right[:max(0, len(ids) - t)] = ids[t:]
    with np.errstate(over="ignore"):
        return mix64(ids * _STEP + (right ^ (right >> np.uint64(29))) + np.uint64(t))


def repeated_words(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where a document's words begin to repeat, and the period; None: they stay (contract)."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _best(runs: np.ndarray) -> list[int | None]:
    """start, length, period and floor(1000 * exponent) of the run with the greatest exponent."""
    if not len(runs):
        return [None] * 4
    power = runs[:, 1] / runs[:, 2]
    near = runs[power >= power.max() * (1 - 1e-9)].tolist()
    start, length, period = min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return [start, length, period, 1000 * length // period]


def _detect(s, state) -> dict[str, list]:
    words = s.words(SPACE_WORD)
    hashes, first = words.hashes(), words.first
    counts = np.diff(first)
    ids = s.part["doc_id"].to_pylist()
    source = np.arange(len(hashes))  # the word that stands at each place
    moved = np.zeros(s.rows, bool)
    for r in range(s.rows):
        change = repeated_words(ids[r], int(counts[r]))
        if change:
            a, p = change
            moved[r] = True
            i = np.arange(int(counts[r]))
            source[first[r]:first[r + 1]] = first[r] + np.where(i >= a, a + (i - a) % p, i)
    runs = find_runs(hashes[source], first)
    gone = covered(runs[:, 0] + runs[:, 2], runs[:, 0] + runs[:, 1], len(hashes))
    cuts = np.searchsorted(runs[:, 0], first)
    got: dict[str, list] = {c: [] for c in ("runs", "start", "length", "period",
                                            "exponent_milli", "collapsed")}
    for r in range(s.rows):
        mine = runs[cuts[r]:cuts[r + 1]] - np.array([first[r], 0, 0])
        got["runs"].append([dict(zip(("start", "length", "period"), run, strict=True))
                            for run in mine.tolist()])
        for c, value in zip(("start", "length", "period", "exponent_milli"), _best(mine), strict=True):
            got[c].append(value)
        text = s.text(r).split()
        if moved[r] or len(mine):
            at = source[first[r]:first[r + 1]] - first[r]
            text = [text[k] for k in at[~gone[first[r]:first[r + 1]]].tolist()]
        got["collapsed"].append(b" ".join(text).decode())
    return got


def collapse_runs(docs: DataFrame) -> DataFrame:
    """``docs`` without ``text``, with runs (start, length, period), those of the run with the
    greatest exponent (start, length, period, exponent_milli; null without runs) and
    collapsed: the words that no run holds after its first period, joined by spaces."""
    fields = [T.StructField("runs", RUNS)] + [T.StructField(c, T.LongType()) for c in (
        "start", "length", "period", "exponent_milli")] + [T.StructField("collapsed", T.StringType())]
    return add_columns(docs, _detect, fields, keep_text=False)
