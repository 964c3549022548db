"""Source divergence audit by one-hot level products (operator 13).

Every language keeps the terms found in at least ``LEAST_DOCS`` of its documents. A (language,
source) group, and the language as a whole, gives each kept term the price
``p = 1 + (SCALE * (count + PRIOR)) div (N + PRIOR * V)``, with N its occurrences of kept terms
and V the number of kept terms. Sources are compared by the sum of ``|p - q|`` over all kept
terms; the terms that a group uses more than its language are listed by ``p - q``.

A price depends on the group and on the count only, so a comparison needs no more than the joint table
of two groups: how many terms have count ``a`` in one and ``b`` in the other. The kept terms of
a language are dealt into blocks. A block is an indicator matrix with a row for each of its terms and a column for each
(group, count level), zero included, and its transpose times itself holds the joint
tables of all pairs of groups. Products are made in tiles of ``TILE`` sources by ``TILE`` sources and panels
of at most ``PANEL`` columns, in 32-bit floats, which are exact here as no cell exceeds the block's
number of terms. Each joint table is priced where it was made, and the blocks' sums are added.

Exactness: prices are integers (decimal ``div``), sums are integers of 64 bits.

Scale: tasks pre-aggregate the counts (``HELD_COUNTS`` at a time); counts and kept terms meet by (language, term), so neither a hot
source nor a hot language is one task. A tile task holds the counts of ``BLOCK`` terms in
``2 * TILE`` sources. Rows for a block travel once for each tile pair of their source.

Cases: null text, language and source read as ''; a group without terms is compared as well (all its counts
are 0); a language without kept terms gives the value 0 for all its pairs and no terms; a language with one source gives no pair;
repeated rows are documents of their own; ids do not matter; an empty table gives an empty result; other input columns are
left out. Ties rank by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.common import cut
from tremolo.llm.tokens import Words, mix64, slices, span_hashes

LEAST_DOCS = 30
SCALE = 1_000_000_000
PRIOR = 5
TOP_TERMS = 50
BLOCK = 1024  # terms of a matrix, on average
TILE = 32  # sources of a tile, on average
PANEL = 2048  # columns multiplied at once
SLICE = 2 << 20  # bytes of text counted at a time
HELD_COUNTS = 1 << 20  # counts that a task puts together

#: [^\x00-\x40\x5B-\x60\x7B-\x7F]+ after A-Z are lower-cased
TERM = np.ones(256, dtype=bool)
TERM[:0x61] = False
TERM[0x7B:0x80] = False

_COUNTS = "lang string, source string, term string, n long, docs long"


class _Counted:
    """Counts of (group, term) of a task's slices, put together before they are sent."""

    def __init__(self):
        self.rows, self.keys, self.n = [], [], 0

    def add(self, key: np.ndarray, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.keys.append(key)
        self.rows.append(rows)
        self.n += len(key)
        if self.n > HELD_COUNTS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        key = np.concatenate(self.keys)
        rows = pa.Table.from_batches(self.rows)
        self.__init__()
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
        sums = {c: np.add.reduceat(rows[c].to_numpy()[order], first) for c in ("n", "docs")}
        some = rows.select(["lang", "source", "term"]).take(pa.array(order[first]))
        done = some.append_column("n", pa.array(sums["n"])).append_column("docs", pa.array(sums["docs"]))
        yield from done.combine_chunks().to_batches(max_chunksize=1 << 16)


def _text_key(column: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    s = next(slices(column, 1 << 62), None)
    return span_hashes(s.data, s.offsets[:-1], s.offsets[1:]) if s else np.zeros(0, np.uint64)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = _Counted()
    for batch in batches:
        langs = batch["lang"].dictionary_encode()
        sources = batch["source"].dictionary_encode()
        width = max(1, len(sources.dictionary))
        group = (langs.indices.to_numpy().astype(np.int64) * width
                 + sources.indices.to_numpy())
        # a group's number in this batch, and a hash of its names that holds in all batches
        name = mix64(_text_key(langs.dictionary))[:, None] + _text_key(sources.dictionary)[None, :]
        name = mix64(name.ravel())
        for s in slices(batch["text"], SLICE):
            words: Words = s.words(TERM, lower=True)
            if not len(words.starts):
                continue
            of = group[s.first:s.first + s.rows][words.row]
            key = mix64(words.hashes() + name[of])
            order = np.argsort(key, kind="stable")  # rows ascend within a key
            key, row = key[order], words.row[order]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
            at = order[first]
            data = words.data.tobytes()
            terms = [data[a:b] for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist(),
                                               strict=True)]
            mine = of[at]
            yield from held.add(key[first], pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(mine // width)),
                 sources.dictionary.take(pa.array(mine % width)),
                 pa.array(terms, pa.binary()).cast(pa.string()),
                 pa.array(np.diff(np.concatenate((first, [len(key)])))),
                 pa.array(np.add.reduceat(fresh.astype(np.int64), first))],
                names=["lang", "source", "term", "n", "docs"]))
    yield from held.flush()


def price(count, total, kept) -> F.Column:
    """The exact price of a count in a group of ``total`` occurrences and ``kept`` terms."""
    wide = F.lit(SCALE).cast("decimal(38,0)") * (F.col(count) + F.lit(PRIOR)).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function(
        "div", wide, (F.col(total) + F.lit(PRIOR) * F.col(kept)).cast("decimal(20,0)"))


def _prices(levels: np.ndarray, total: int, kept: int) -> np.ndarray:
    """The same for an array of counts (Python integers where 64 bits are too few)."""
    if len(levels) and int(levels.max()) + PRIOR < (1 << 63) // SCALE:
        return 1 + SCALE * (levels + PRIOR) // (total + PRIOR * kept)
    return np.array([1 + SCALE * (int(c) + PRIOR) // (total + PRIOR * kept) for c in levels],
                    np.int64)


def _one_hot(rows: np.ndarray, groups: np.ndarray, counts: np.ndarray, totals: np.ndarray,
             terms: int, kept: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each group its level columns: (group, prices of the levels, level of each term)."""
    order = np.argsort(groups, kind="stable")
    cuts = np.searchsorted(groups[order], np.arange(len(totals) + 1))
    made = []
    for g in range(len(totals)):
        mine = order[cuts[g]:cuts[g + 1]]
        levels, level = np.unique(np.concatenate(([0], counts[mine])), return_inverse=True)
        of_term = np.zeros(terms, np.int64)
        of_term[rows[mine]] = level[1:]
        made.append((g, _prices(levels, int(totals[g]), kept), of_term))
    return made


def _panels(columns: list, terms: int) -> Iterator[tuple[list, np.ndarray]]:
    """Indicator matrices (terms x columns) of whole groups, at most ``PANEL`` columns or one
    group wide: ([(group, prices, first column)], matrix)."""
    held, width = [], 0
    for k, (g, prices, of_term) in enumerate(columns):
        held.append((g, prices, width, of_term))
        width += len(prices)
        if k + 1 == len(columns) or width + len(columns[k + 1][1]) > PANEL:
            matrix = np.zeros((terms, width), np.float32)
            for _, _, begin, level in held:
                matrix[np.arange(terms), begin + level] = 1
            yield [(a, b, c) for a, b, c, _ in held], matrix
            held, width = [], 0


def joint_values(rows, groups, counts, totals, terms: int, kept: int, left: np.ndarray,
                 right: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(g, h, sum of price differences over the block's terms) for g in ``left``, h in ``right``,
    each unordered pair once.

    ``rows, groups, counts``: term, group and (positive) count of the block's entries.
    """
    columns = _one_hot(rows, groups, counts, totals, terms, kept)
    for near, x in _panels([c for c in columns if left[c[0]]], terms):
        for far, y in _panels([c for c in columns if right[c[0]]], terms):
            pairs = [(g, h) for g, _, _ in near for h, _, _ in far]
            both = [g != h and not (left[h] and right[g] and g > h) for g, h in pairs]
            if not any(both):  # a tile with itself holds both orders
                continue
            joint = x.T @ y
            wanted = iter(both)
            for g, p, a in near:
                for h, q, b in far:
                    if not next(wanted):
                        continue
                    table = joint[a:a + len(p), b:b + len(q)]
                    i, j = np.nonzero(table)
                    yield g, h, int((table[i, j].astype(np.int64) * np.abs(p[i] - q[j])).sum())


def _tile(key, entries: pa.Table, members: pa.Table) -> pa.Table:
    """Pair sums of one block of terms for the sources of tiles ``i`` and ``j``."""
    i, j = key[2].as_py(), key[3].as_py()
    names = members["source"].to_pylist()
    tile = members["tile"].to_numpy()
    number = {name: k for k, name in enumerate(names)}
    totals = members["total"].to_numpy()
    kept = members["kept"][0].as_py() if len(names) else 0
    out: list[tuple[str, str, int]] = []
    if entries.num_rows and len(names):
        term = entries["term"].combine_chunks().dictionary_encode()
        group = np.array([number[x] for x in entries["source"].to_pylist()], np.int64)
        rows = term.indices.to_numpy().astype(np.int64)
        out = [(names[g], names[h], value) for g, h, value in joint_values(
            rows, group, entries["n"].to_numpy(), totals, len(term.dictionary), kept,
            tile == i, tile == j)]
    terms = len(pc.unique(entries["term"])) if entries.num_rows else 0
    return pa.table({
        "lang": pa.array([key[0].as_py()] * len(out), pa.string()),
        "a": pa.array([x[0] for x in out], pa.string()),
        "b": pa.array([x[1] for x in out], pa.string()),
        "value": pa.array([x[2] for x in out], pa.int64()),
        "terms": pa.array([terms] * len(out), pa.int64())})


def kept_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, n_lang, lead: occurrences of the kept terms by group and by language;
    ``lead`` marks one row of each (lang, term)."""
    counts = docs.select("text", "lang", "source").mapInArrow(_count_terms, _COUNTS).groupBy(
        "lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")  # a row for each source
    return counts.select(
        "lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"),
        F.sum("n").over(of_term).alias("n_lang"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("lead")).where(
        F.col("docs") >= least_docs).drop("docs")


def group_sizes(docs: DataFrame, kept: DataFrame, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, total, lang_total, kept (terms of the language), blocks, tiles, tile."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"),
                                                F.count_if("lead").alias("leads"))
    groups = docs.select("lang", "source").distinct().join(
        totals, ["lang", "source"], "left").fillna(0, ["total", "leads"])
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.sum("leads").alias("kept"),
        F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    return groups.drop("leads").join(langs, "lang").withColumn(
        "blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / block).cast("int"))).withColumn(
        "tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))


def _for_tiles(rows: DataFrame) -> DataFrame:
    """A row of a tile for every pair of tiles that it belongs to (i at most j)."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return other.withColumn("i", F.least("tile", "other")).withColumn(
        "j", F.greatest("tile", "other"))


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b, value: the sum of price differences of every two sources of a language."""
    entries = _for_tiles(kept.join(
        groups.select("lang", "source", "tile", "tiles", "blocks"), ["lang", "source"]).withColumn(
        "block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))).select(
        "lang", "block", "i", "j", "source", "term", "n")
    members = _for_tiles(groups.where("kept > 0").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).select(
        "lang", "block", "i", "j", "source", "tile", "total", "kept")
    by = ("lang", "block", "i", "j")
    sums = entries.groupBy(*by).cogroup(members.groupBy(*by)).applyInArrow(
        _tile, "lang string, a string, b string, value long, terms long")
    # a joint table does not name its groups in order
    sums = sums.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.sum("value").alias("value"), F.sum("terms").alias("terms"))
    zero = F.when(F.col("kept") > 0, price("none", "total", "kept")).otherwise(F.lit(0).cast("long"))
    sides = groups.withColumn("none", F.lit(0).cast("long")).select(
        "lang", "source", "kept", zero.alias("zero"))
    both = sides.withColumnRenamed("source", "a").alias("x").join(
        sides.select("lang", F.col("source").alias("b"), F.col("zero").alias("far")).alias("y"),
        "lang").where("a < b")
    # terms of which no block of the two has an entry have count 0 in both
    return both.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", (F.coalesce("value", F.lit(0).cast("long")) + F.abs(
            F.col("zero") - F.col("far")) * (F.col("kept") - F.coalesce(
                "terms", F.lit(0).cast("long")))).alias("value"))


def audit_sources(docs: DataFrame, least_docs: int = LEAST_DOCS, block: int = BLOCK,
                  tile: int = TILE, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    given = docs.select("text", *[F.coalesce(F.col(c), F.lit("")).alias(c)
                                  for c in ("lang", "source")])
    kept = cut(kept_counts(given, least_docs))
    groups = cut(group_sizes(given, kept, block, tile))
    values = pair_values(kept, groups)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(
        F.col("value").desc(), "item"))
    pairs = values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value"
                          ).unionByName(values.select(
                              "lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    priced = kept.join(groups.select("lang", "source", "total", "lang_total", "kept"),
                       ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"),
        (price("n", "total", "kept") - price("n_lang", "lang_total", "kept")).alias("value"))
    terms = priced.where("value > 0").withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(
        terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")
