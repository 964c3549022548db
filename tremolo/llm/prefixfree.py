"""Suffix-array dedup by prefix-free parsing (operator 9).

Every byte covered by a ``WIDTH``-byte string that also starts anywhere else, in another
document or the same one, is removed.

Parsing: a rolling hash over ``GRAM`` bytes triggers phrase ends. Of the grams in a
``WIDTH``-byte string the (leftmost) one with the least hash is its trigger; consecutive
strings with one trigger make a phrase, which spans their text and so overlaps its
neighbours by ``WIDTH - 1`` bytes, as phrases of a prefix-free parse overlap by their triggers. Equal strings
have equal triggers, wherever they stand, and no two strings of one phrase are equal.

Dictionary and parse: documents become sequences of phrases (the parse), and the distinct phrases
under their triggers are the dictionary. The corpus order is needed to a depth of ``WIDTH`` bytes
only, where neighbours are either equal or not, so it is kept by hash and not by alphabet:
(1) the parse is sorted by (trigger, phrase): neighbours with the same phrase are whole
repeats; (2) for triggers with several phrases, the dictionary's suffixes are sorted, each
cut to ``WIDTH`` bytes, and equal neighbours are the repeats that differ further out.

Scale: a row per phrase (about ``(WIDTH - GRAM) / 2`` bytes) is shuffled, not a row per
byte. Phrases repeated within a slice of text are decided there and sent on once, so a
passage with a million copies is no hot key. Step 2 reads dictionary phrases only, from their
documents' text (one shuffle of the texts that have some); a trigger with more than
``GROUP`` phrases is cut into shards by the hash of the suffixes. A trigger with very many phrases (boilerplate around
which everything else varies) is no hot bucket: a first pass counts the phrases of each trigger, and those of more
than ``HOT_SHARE`` of all phrases (hence at most ``1 / HOT_SHARE`` triggers, and no fewer than ``HOT_PHRASES`` phrases
each) are cut into their single strings, spread over ``SPLIT`` buckets by the string, where equal strings meet and one of a
slice is sent. So no bucket, and no string in however many contexts, grows with the corpus beyond that share.
Coordinates of repeats are joined to the texts at the end.

Cases: null and empty texts have no bytes; a null id is a document like any other, and ids may be of any type;
repeated rows are documents of their own (each makes the other a repeat), and rows that share an id but not the text
are told apart by 80 bits of id and text; texts shorter than ``WIDTH`` bytes lose nothing; an empty table gives an
empty result; input columns that clash with the new ones, and ``starts`` and ``counts``, are replaced or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremolo.llm.common import add_columns, cut
from tremolo.llm.tokens import (
    binary_array,
    binary_bytes,
    covered,
    minima,
    mix64,
    packed,
    pieces,
    runs,
    slices,
    span_hashes,
    summed,
    unpacked,
    window_hashes,
)

WIDTH = 400
GRAM = 48
GROUP = 2048
HOT_SHARE = 1 / (1 << 20)
HOT_PHRASES = 1 << 17
LOCAL_PHRASES = 16  # a task reports the triggers of as many phrases
SPLIT = 1 << 12
SLICE = 2 << 20
PLACE = (1 << 40) - 1
_PHRASE_BASE = 0xC2B2AE3D27D4EB4F

_PHRASES = "bucket long, phrase long, doc long, place long, n int, copies int, split boolean"
_SUFFIXES = "bucket long, shard int, doc long, place long, n int, repeated boolean, " \
    "text binary, offsets binary, hashes binary"
_SPANS = "doc long, place long, n int"


class _Phrases:
    """The phrases of a piece of text: rows, places of the first string and number of strings, triggers."""

    def __init__(self, s, width: int, gram: int):
        n = len(s.data) - width + 1
        self.any = n > 0
        if not self.any:
            return
        grams = window_hashes(s.data, gram)
        # the low bits hold the place, so that a minimum is the leftmost one
        bits = np.uint64(max(1, int(len(grams)).bit_length()))
        least = minima((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
        at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        row = np.repeat(np.arange(s.rows, dtype=np.int32), np.diff(s.offsets))
        valid = row[:n] == row[width - 1:]
        row = row[:n]
        cuts = np.ones(n, bool)
        cuts[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        self.first, self.count = runs(valid, cuts)
        self.any = len(self.first) > 0
        self.row, self.bucket = row[self.first], grams[at[self.first]]


def _text_pieces(batch: pa.RecordBatch, width: int):
    """Slices of a batch, a long text in pieces that share no string but miss none."""
    for whole in slices(batch["text"], SLICE):
        yield from pieces(whole, SLICE, width - 1)


def _trigger_counts(width: int, gram: int):
    """Phrases by trigger (of a task, ``LOCAL_PHRASES`` or more) and, without a trigger, all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, total, full = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 1 << 20
        for batch in batches:
            for s, _ in _text_pieces(batch, width):
                p = _Phrases(s, width, gram)
                if not p.any:
                    continue
                mine, n = np.unique(p.bucket, return_counts=True)
                total += int(n.sum())
                keys = np.concatenate((keys, mine[n > 1]))
                counts = np.concatenate((counts, n[n > 1]))
                if len(keys) > full:
                    keys, counts = summed(keys, counts)
                    full = max(full, 2 * len(keys))
        if total:
            keys, counts = summed(keys, counts) if len(keys) else (keys, counts)
            often = counts >= LOCAL_PHRASES
            yield pa.RecordBatch.from_arrays(
                [pa.array([*keys[often].astype(np.int64).tolist(), None], pa.int64()),
                 pa.array([*counts[often].tolist(), total], pa.int64())], names=["bucket", "n"])
    return run


def hot_triggers(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Sorted triggers with too many phrases for one bucket; at most ``1 / HOT_SHARE`` numbers."""
    counted = cut(docs.select("text").mapInArrow(_trigger_counts(width, gram), "bucket long, n long").groupBy(
        "bucket").agg(F.sum("n").alias("n")).where(f"bucket IS NULL OR n >= {HOT_PHRASES}"))
    total = counted.where("bucket IS NULL").first()
    limit = max(HOT_PHRASES, (total["n"] if total else 0) * HOT_SHARE)
    rows = counted.where("bucket IS NOT NULL").where(F.col("n") >= limit).select("bucket").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).astype(np.uint64))


def _split(s, p: _Phrases, many: np.ndarray, width: int):
    """The strings of hot triggers as phrases of their own: index of the phrase, place, bucket, hash."""
    of = np.repeat(np.flatnonzero(many), p.count[many])
    begin = np.cumsum(p.count[many]) - p.count[many]
    place = p.first[of] + np.arange(len(of)) - np.repeat(begin, p.count[many])
    string = window_hashes(s.data, width)[place]
    part = mix64(string) % np.uint64(SPLIT)
    return of, place, mix64(p.bucket[of] ^ mix64(part + np.uint64(1))), string


def _phrases(width: int, gram: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch["doc"].to_numpy(zero_copy_only=False)
            checks = batch["check"].to_numpy(zero_copy_only=False)
            for s, base in _text_pieces(batch, width):
                p = _Phrases(s, width, gram)
                if not p.any:
                    continue
                bucket, first, count, row = p.bucket, p.first, p.count, p.row
                phrase = span_hashes(s.data, first, first + count + width - 1, _PHRASE_BASE)
                split = np.zeros(len(first), bool)
                many = np.isin(bucket, hot) if len(hot) else split
                if many.any():
                    of, place, part, string = _split(s, p, many, width)
                    bucket = np.concatenate((bucket[~many], part))
                    phrase = np.concatenate((phrase[~many], string))
                    row = np.concatenate((row[~many], row[of]))
                    first = np.concatenate((first[~many], place))
                    count = np.concatenate((count[~many], np.ones(len(of), np.int64)))
                    split = np.arange(len(first)) >= int((~many).sum())
                bucket, phrase = bucket.astype(np.int64), phrase.astype(np.int64)
                doc = docs[s.first:s.first + s.rows][row]
                place = (checks[s.first:s.first + s.rows][row] << 40) | (base + first - s.offsets[row])
                # copies within the slice: all are repeats, one of them goes on
                order = np.lexsort((phrase, bucket))
                new = np.ones(len(order), bool)
                new[1:] = (bucket[order][1:] != bucket[order][:-1]) | (
                    phrase[order][1:] != phrase[order][:-1])
                starts = np.flatnonzero(new)
                copies = np.zeros(len(order), np.int64)
                copies[order[starts]] = np.diff(np.concatenate((starts, [len(order)])))
                sent = copies > 0
                spread = mix64((place + doc).astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(sent, bucket, spread)), pa.array(phrase), pa.array(doc),
                     pa.array(place), pa.array(count.astype(np.int32)),
                     pa.array(np.minimum(copies, 2).astype(np.int32)), pa.array(split)],
                    names=["bucket", "phrase", "doc", "place", "n", "copies", "split"])
    return run


def parse(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Phrases to act on: bucket, phrase, doc, place, n, repeated, listed, phrases.

    ``repeated``: another copy of the phrase exists. ``listed``: this row stands for its
    phrase in the dictionary of a trigger that has several (``phrases``).
    """
    hot = hot_triggers(docs, width, gram)
    rows = docs.mapInArrow(_phrases(width, gram, hot), _PHRASES)
    by = Window.partitionBy("bucket")
    order = by.orderBy("phrase", "doc", "place")
    sent = F.col("copies") > 0
    before, after = F.lag("phrase").over(order), F.lead("phrase").over(order)
    marked = rows.withColumn("before", before).withColumn("after", after).withColumn(
        "lowest", F.first("phrase").over(order)).withColumn(
        "last", (F.col("after").isNull() | (F.col("after") != F.col("phrase")))).withColumn(
        "phrases", F.sum(F.col("last").cast("int")).over(by))
    same = (F.coalesce(F.col("before") == F.col("phrase"), F.lit(False))
            | F.coalesce(F.col("after") == F.col("phrase"), F.lit(False)))
    return marked.select(
        "bucket", "doc", "place", "n", ((F.col("copies") != 1) | same).alias("repeated"),
        (sent & F.col("last") & ~F.col("split") & (F.col("after").isNotNull()
                                 | (F.col("lowest") != F.col("phrase")))).alias("listed"),
        "phrases").where("repeated OR listed")


def _suffixes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch["found"]
            for s in slices(batch["text"], SLICE):
                rows = []
                for row in range(s.rows):
                    base = int(s.offsets[row])
                    for f in found[s.first + row].as_py():
                        at = base + (f["place"] & PLACE)
                        raw = s.data[at:at + f["n"] + width - 1]
                        one = (f["bucket"], f["doc"], f["place"], f["n"], f["repeated"])
                        if f["shards"] == 1:
                            rows.append((*one, 0, raw.tobytes(), b"", b""))
                            continue
                        hashes = window_hashes(raw, width)
                        shard = hashes % np.uint64(f["shards"])
                        for k in np.unique(shard).tolist():
                            mine = np.flatnonzero(shard == k)
                            rows.append((*one, k, b"", packed(mine.astype(np.uint64), 4).tobytes(),
                                         hashes[mine].tobytes()))
                for lo in range(0, len(rows), 4096):
                    part = list(zip(*rows[lo:lo + 4096], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[0], pa.int64()), pa.array(part[5], pa.int32()),
                         pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64()),
                         pa.array(part[3], pa.int32()), pa.array(part[4], pa.bool_()),
                         *[pa.array(p, pa.binary()) for p in part[6:9]]],
                        names=["bucket", "shard", "doc", "place", "n", "repeated", "text",
                               "offsets", "hashes"])
    return run


def _equal_suffixes(width: int):
    """Repeats among the dictionary phrases of a trigger, from rows sorted by (bucket, shard)."""
    def decide(table: pa.Table) -> pa.RecordBatch:
        columns = table.combine_chunks().to_batches()[0] if table.num_rows else None
        if columns is None:
            return _span_rows([], [], [])
        bucket = columns["bucket"].to_numpy().astype(np.uint64)
        doc, place = columns["doc"].to_numpy(), columns["place"].to_numpy()
        repeated = columns["repeated"].to_numpy(zero_copy_only=False)
        raw, size = binary_bytes(columns["text"])
        owner, offset, keys = [], [], []
        if len(raw) >= width:  # strings of whole phrases; those across two rows are left out
            row = np.repeat(np.arange(len(size)), size)
            ok = np.flatnonzero(row[:len(raw) - width + 1] == row[width - 1:])
            owner.append(row[ok])
            offset.append(ok - (np.cumsum(size) - size)[row[ok]])
            keys.append(window_hashes(raw, width)[ok])
        packed_at, at_size = binary_bytes(columns["offsets"])
        if len(packed_at):
            owner.append(np.repeat(np.arange(len(at_size)), at_size // 4))
            offset.append(unpacked(packed_at, 4).astype(np.int64))
            keys.append(np.frombuffer(binary_bytes(columns["hashes"])[0].tobytes(), np.uint64))
        if not keys:
            return _span_rows([], [], [])
        row, at = np.concatenate(owner), np.concatenate(offset)
        with np.errstate(over="ignore"):
            key = mix64(np.concatenate(keys) + mix64(bucket)[row])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        twice &= ~repeated[row]  # those are whole repeats already
        step = np.ones(len(row), bool)
        step[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        first, count = runs(twice, step)
        return _span_rows(doc[row[first]], place[row[first]] + at[first], count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the (bucket, shard) that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            b = batch["bucket"].to_numpy()
            k = batch["shard"].to_numpy()
            tail = (b == b[-1]) & (k == k[-1])
            begin = int(np.flatnonzero(~tail)[-1]) + 1 if not tail.all() else 0
            if held:
                same = held[0]["bucket"][0].as_py() == b[0] and held[0]["shard"][0].as_py() == k[0]
                if same and begin == 0:
                    held.append(batch)
                    continue
            if begin:
                yield decide(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            elif held:
                yield decide(pa.Table.from_batches(held))
            held = [batch.slice(begin)]
        if held:
            yield decide(pa.Table.from_batches(held))
    return run


def _span_rows(doc, place, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(place, pa.int64()),
         pa.array(np.asarray(n, dtype=np.int32))], names=["doc", "place", "n"])


def _with_keys(docs: DataFrame) -> DataFrame:
    """``doc``: 64 bits of the id and the text, and ``check``: 16 more of the text. Rows that agree in
    both are the same row repeated and lose the same bytes."""
    return docs.withColumn("doc", F.xxhash64("doc_id", "text")).withColumn(
        "check", F.hash("text").bitwiseAND(F.lit(0xFFFF)).cast("long"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM,
                   group: int = GROUP) -> DataFrame:
    """doc, place, n: runs of n repeated ``width``-byte strings, where the first one starts."""
    texts = _with_keys(docs.where("text IS NOT NULL").select("doc_id", "text")).drop("doc_id")
    found = cut(parse(texts, width, gram))
    whole = found.where("repeated").select("doc", "place", "n")
    listed = found.where("listed").withColumn(
        "shards", F.ceil(F.col("phrases") / group).cast("int")).withColumn(
        "check", F.shiftrightunsigned("place", 40)).groupBy("doc", "check").agg(
        F.collect_list(F.struct("bucket", "doc", "place", "n", "repeated", "shards")).alias("found"))
    # a document that occurs in several rows is read once: the phrases were listed once
    of = texts.alias("a").join(listed.alias("b"), F.expr("a.doc = b.doc AND a.check = b.check")
                               ).select("a.doc", "a.check", "a.text", "b.found")
    rows = of.mapInArrow(_suffixes(width), _SUFFIXES)
    partly = rows.repartition("bucket", "shard").sortWithinPartitions(
        "bucket", "shard", "doc", "place").mapInArrow(_equal_suffixes(width), _SPANS)
    return whole.unionByName(partly)


def _remover(width: int):
    def remove(s, state) -> dict[str, list]:
        got: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        starts, counts = s.part["starts"], s.part["counts"]
        for row in range(s.rows):
            raw = s.data[s.offsets[row]:s.offsets[row + 1]]
            at = starts[row].as_py()
            n_removed = n_spans = 0
            if at:
                first = np.array(at, dtype=np.int64)
                gone = covered(first, first + np.array(counts[row].as_py()) + width - 1, len(raw))
                n_removed = int(gone.sum())
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                kept = raw[~gone].tobytes()
            else:
                kept = raw.tobytes()
            got["n_bytes"].append(len(raw))
            got["n_removed"].append(n_removed)
            got["n_spans"].append(n_spans)
            got["kept"].append(kept)
        return got
    return remove


def remove_repeated_bytes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM,
                          group: int = GROUP) -> DataFrame:
    """``docs`` without ``text``, with n_bytes, n_removed, n_spans and kept (binary)."""
    spans = repeated_spans(docs, width, gram, group).groupBy(
        "doc", F.shiftrightunsigned("place", 40).alias("check")).agg(F.collect_list(F.struct(
            F.col("place").bitwiseAND(F.lit(PLACE)).alias("start"),
            F.col("n").cast("long").alias("n"))).alias("spans")).select(
        F.col("doc").alias("_doc"), F.col("check").alias("_check"),
        F.col("spans.start").alias("starts"), F.col("spans.n").alias("counts"))
    plain = docs.drop("starts", "counts").alias("a")
    met = plain.join(spans, (F.xxhash64("a.doc_id", "a.text") == F.col("_doc")) & (
        F.hash("a.text").bitwiseAND(F.lit(0xFFFF)) == F.col("_check")), "left").select(
        "a.*", "starts", "counts")
    out = add_columns(met, _remover(width), [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())],
        keep_text=False)
    return out.drop("starts", "counts")
