"""N-gram Jaccard join by a MinHash LSH forest (operator 8).

Documents are sets of five-word shingles; two different texts are linked when the Jaccard
similarity of their sets is ``THRESHOLD`` or more. Result: one row per document with the
id of its class (connected texts and all copies of them) and the number of links.

Forest: each text has a label of ``DEPTH`` min-hashes in each of ``TREES`` trees. Labels sorted by prefix are a
trie: a node holds the texts that share a prefix, its children those that share one more min-hash. The
matched prefix is shortened level by level, from the full label on. At a level only nodes with several
children are looked at (texts of one child met a level deeper), and of these only nodes whose
texts are not connected yet by what deeper levels found. Shortening stops at the depth whose expected recall at
the threshold, ``1 - (1 - s ** depth) ** TREES``, reaches ``RECALL``.

Candidates: texts that meet in a node are compared by ``SKETCH`` of their min-hashes, one byte each, and connected
only if ``LEAST_ALIKE`` of them agree: a pair at the threshold fails that by chance once in some 300 000 times, and
texts that merely share a template do not pass. What is connected forms clusters.

Verification is exact and no pair is ever written out: a cluster is cut into blocks
of about ``BLOCK`` texts, and a task gets two blocks and counts, for all their pairs,
the common shingles by products of incidence matrices. It returns a row per text: its links in
those blocks and one neighbour to connect it by.

Scale: copies are one text from the start (a hash of the text), so a group of exact copies
is one row. Nodes are counted with partial aggregation; a node of more than ``NODE_BLOCK`` texts is cut
into pairs of blocks. Connected
components alternate large-star and small-star steps, checkpointed round by round.
Shingle sets are made for texts in clusters only. A cluster of m texts costs m * m / BLOCK
rows of shuffle, the price of counting every link; its memory per task is bounded.

Cases: null texts and texts without words are never linked (class: their own id); a
text of fewer than five words is a single shingle; copies of a text share its class and
links, and are not links of one another; a null id is kept (the class id is the smallest
id that is not null); an empty table gives an empty result. Texts are told apart by a
64-bit hash; ids are integers. Other columns of the input are kept, but for those named like the new ones or
like a name in ``_OWN``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.llm.common import cut
from tremolo.llm.tokens import (
    SPACE_WORD,
    Slice,
    binary_array,
    binary_bytes,
    mix64,
    slices,
    span_hashes,
    window_hashes,
)

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 8
RECALL = 0.995
MINHASH_BYTES = 4
SKETCH = 96  # bytes: the lowest one of as many min-hashes
LEAST_ALIKE = 0.615
NODE_BLOCK = 4096  # texts of a node that are compared in one task, at most about twice as many
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
COLUMNS = 8192  # shingles multiplied at a time


def matched_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH,
                  recall: float = RECALL) -> int:
    """Longest prefix that reaches the recall at the threshold (one at least)."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(s: Slice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a slice and their rows, in order of rows."""
    words = s.words(SPACE_WORD)
    hashes = words.hashes()
    at = np.flatnonzero(words.window_rows(size))
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < size))
    few = span_hashes(hashes, words.first[short], words.first[short + 1])
    rows = np.concatenate((words.row[at], short))
    values = np.concatenate((window_hashes(hashes, size)[at], few))
    order = np.argsort(rows, kind="stable")
    return values[order], rows[order]


def _labels(trees: int, depth: int, size: int):
    """Batches of (unit, label, sketch): for every row with words its min-hashes, tree by tree, and
    the lowest byte of ``SKETCH`` of them."""
    rng = np.random.default_rng(20240817)
    factors = rng.integers(1, 1 << 63, size=(trees, depth), dtype=np.uint64) * 2 + 1
    shifts = rng.integers(0, 1 << 63, size=(trees, depth), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch["text"]):
                values, rows = shingles(s, size)
                if not len(rows):
                    continue
                first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                least = np.zeros((len(first), trees * depth), np.uint32)
                with np.errstate(over="ignore"):
                    for t in range(trees):
                        for k in range(depth):
                            hashed = np.minimum.reduceat(values * factors[t, k] + shifts[t, k], first)
                            least[:, t * depth + k] = mix64(hashed).astype(np.uint32)
                part = batch.slice(s.first, s.rows).take(pa.array(rows[first]))
                width = trees * depth * MINHASH_BYTES
                sketch = np.ascontiguousarray(least[:, :SKETCH]).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["unit"],
                     binary_array(least.view(np.uint8).ravel(), np.full(len(first), width)),
                     binary_array(sketch.ravel(), np.full(len(first), sketch.shape[1]))],
                    names=["doc_id", "unit", "label", "sketch"])
    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node) of every node in ``edges`` (u, v), by alternating
    large-star and small-star steps until the edges stay the same."""
    def state(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(r)

    def star(sided: DataFrame, keep) -> DataFrame:
        least = sided.groupBy("u").agg(F.min("v").alias("m")).withColumn(
            "m", F.least("u", "m"))
        return sided.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))

    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(
        "u <> v").distinct())
    was = None
    while (mark := state(now)) != was:
        was = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, F.col("v") > F.col("u")).where("u <> v").distinct()
        # small-star: edges point from the larger to the smaller node
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct())
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch["text"]):
                values, rows = shingles(s, size)
                order = np.lexsort((values, rows))
                values, rows = values[order], rows[order]
                keep = np.ones(len(values), bool)
                keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
                values, rows = values[keep], rows[keep]
                n = np.bincount(rows, minlength=s.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch["unit"].slice(s.first, s.rows), batch["root"].slice(s.first, s.rows),
                     binary_array(values.view(np.uint8), n * 8)],
                    names=["unit", "root", "shingles"])
    return run


def _linked(threshold: float):
    """Links among the texts of one or two blocks: unit, links, hub (a text it connects to)."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        unit = table["unit"].to_numpy()
        block = table["block"].to_numpy()
        first, second = table["one"][0].as_py(), table["two"][0].as_py()
        chunk = table["shingles"].chunk(0) if table["shingles"].num_chunks else pa.array(
            [], pa.binary())
        raw, size = binary_bytes(chunk)
        n = size // 8
        values = np.frombuffer(raw.tobytes(), np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        order = np.argsort(values, kind="stable")
        values, row = values[order], row[order]
        new = np.ones(len(values), bool)
        new[1:] = values[1:] != values[:-1]
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1 if len(column) else new
        row, column = row[shared], column[shared]
        column = np.unique(column, return_inverse=True)[1] if len(column) else column
        common = np.zeros((len(n), len(n)), np.float32)
        width = int(column[-1]) + 1 if len(column) else 0
        for lo in range(0, width, COLUMNS):
            a, b = np.searchsorted(column, (lo, lo + COLUMNS))
            part = np.zeros((len(n), min(COLUMNS, width - lo)), np.float32)
            part[row[a:b], column[a:b] - lo] = 1
            common += part @ part.T
        union = n[:, None] + n[None, :] - common
        near = common >= threshold * union - 1e-6
        np.fill_diagonal(near, False)
        if first != second:  # pairs within a block are counted where it meets itself
            near &= block[:, None] != block[None, :]
        links = near.sum(axis=1)
        # connect each text to the smallest one that it reaches
        hub = unit.copy()
        while True:
            reach = np.where(near, hub[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(
                np.int64).max)
            lower = np.minimum(hub, reach)
            if (lower == hub).all():
                break
            hub = lower
        keep = links > 0
        return pa.table({"unit": unit[keep], "links": links[keep].astype(np.int64),
                         "hub": hub[keep]})
    return run


def _alike(sketch: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """(rows x others) whether enough bytes of the sketches agree."""
    need = int(np.ceil(LEAST_ALIKE * sketch.shape[1]))
    return (sketch[rows][:, None, :] == sketch[others][None, :, :]).sum(axis=2, dtype=np.uint8) >= need


def connect(sketch: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A component number for every text of a node; ``known``: equal numbers are connected already.

    Texts are gathered around leaders first. Then every text outside the largest component is compared with
    all those that are not connected to it, so no two alike texts stay apart."""
    comp = np.unique(known, return_inverse=True)[1]

    def merge(numbers: np.ndarray) -> None:
        if len(numbers) > 1:
            comp[np.isin(comp, numbers)] = numbers.min()

    first = np.unique(comp, return_index=True)[1]
    todo = first
    while len(todo) > 1:
        near = np.concatenate([_alike(sketch, todo[:1], part)[0] for part in np.array_split(
            todo, max(1, len(todo) // 4096))])
        near[0] = True
        merge(np.unique(comp[todo[near]]))
        todo = todo[~near]
    sizes = np.bincount(comp)
    small = np.flatnonzero(comp != sizes.argmax())
    small = small[np.argsort(sizes[comp[small]], kind="stable")]
    for lo in range(0, len(small), 32):
        rows = small[lo:lo + 32]
        for part in np.array_split(np.arange(len(comp)), max(1, len(comp) // 4096)):
            near = _alike(sketch, rows, part) & (comp[rows][:, None] != comp[part][None, :])
            for r in np.flatnonzero(near.any(axis=1)):
                merge(np.unique(np.append(comp[part[near[r]]], comp[rows[r]])))
    return comp


def _met(table: pa.Table) -> pa.Table:
    """unit, hub: texts of a node (or two blocks of one) that are alike, with the least of them."""
    unit, known = table["unit"].to_numpy(), table["hub"].to_numpy()
    raw, _ = binary_bytes(table["sketch"].combine_chunks())
    comp = connect(raw.reshape(len(unit), -1), known)
    order = np.lexsort((unit, comp))
    first = np.concatenate(([True], comp[order][1:] != comp[order][:-1]))
    hub = np.empty(len(unit), np.int64)
    hub[order] = unit[order][np.maximum.accumulate(np.where(first, np.arange(len(unit)), 0))]
    new = (hub != unit) & (hub != known)
    return pa.table({"unit": unit[new], "hub": hub[new]})


def candidates(units: DataFrame, trees: int = TREES, depth: int = DEPTH, least_depth: int | None = None,
               node_block: int = NODE_BLOCK) -> DataFrame:
    """u, v: edges that connect alike texts of a node, over all levels; ``units``: unit, label,
    sketch."""
    if least_depth is None:
        least_depth = matched_depth(trees=trees, depth=depth)
    size = depth * MINHASH_BYTES
    edges = hubs = None
    for level in range(depth, least_depth - 1, -1):
        # the whole label has no children: there, every text is one
        node, child = (F.expr(f"transform(sequence(0, {trees - 1}), t -> xxhash64(t, substring(label, t * {size} + 1, "
                              f"{n * MINHASH_BYTES})))") for n in (level, level + 1))
        labels = units.select("unit", "label")
        prefixes = labels.join(hubs, "unit") if edges is not None else labels.withColumn("hub", F.col("unit"))
        zipped = F.arrays_zip(node.alias("node"), (child if level < depth else node).alias("child"))
        rows = prefixes.select("unit", "hub", F.explode(zipped).alias("x")).select(
            "unit", "hub", "x.node", (F.col("x.child") if level < depth else F.col("unit")).alias("child"))
        nodes = rows.groupBy("node").agg(
            F.count("*").alias("n"), (F.min("child") != F.max("child")).alias("several"),
            (F.min("hub") != F.max("hub")).alias("apart")).where("several AND apart").select(
            "node", F.ceil(F.col("n") / node_block).cast("int").alias("parts"))
        members = rows.join(nodes, "node").select(
            "node", "unit", "hub", "parts", F.pmod(F.xxhash64("unit"), F.col("parts")).cast("int").alias("block"))
        pairs = members.join(units.select("unit", "sketch"), "unit").withColumn("other", F.explode(F.sequence(
            F.lit(0), F.col("parts") - 1))).select(
            "node", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
            "unit", "hub", "sketch")
        found = cut(pairs.groupBy("node", "one", "two").applyInArrow(_met, "unit long, hub long").distinct())
        edges = found if edges is None else edges.unionByName(found)
        least = edges.groupBy("unit").agg(F.min("hub").alias("h"))
        hubs = units.select("unit").join(least, "unit", "left").select(
            "unit", F.coalesce("h", "unit").alias("hub"))
    return edges.select(F.col("unit").alias("u"), F.col("hub").alias("v"))


def similar_texts(units: DataFrame, docs: DataFrame, threshold: float = THRESHOLD,
                  size: int = SHINGLE, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
                  block: int = BLOCK) -> DataFrame:
    """unit, links, root of every text that has a link; ``units``: unit, doc_id, label, sketch."""
    clusters = cut(components(candidates(units, trees, depth, matched_depth(threshold, trees, depth, recall))))
    wanted = clusters.join(units.select(F.col("unit").alias("node"), "doc_id"), "node")
    texts = docs.alias("a").join(wanted.alias("b"), F.expr(
        "a.doc_id <=> b.doc_id AND a.unit = b.node")).select("a.text", "a.unit", "b.root")
    sets = cut(texts.mapInArrow(_sets(size), "unit long, root long, shingles binary")
               .dropDuplicates(["unit"]))
    parts = sets.groupBy("root").agg(F.greatest(
        F.ceil(F.count("*") / block),
        F.ceil(F.sum(F.octet_length("shingles")) / (8 * BLOCK_SHINGLES))).cast("int").alias("parts"))
    blocks = sets.join(parts, "root").withColumn("block", F.pmod(F.xxhash64("unit"), F.col(
        "parts")).cast("int"))
    pairs = blocks.withColumn("other", F.explode(F.sequence(
        F.lit(0), F.col("parts") - 1))).select(
        "root", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
        "block", "unit", "shingles").repartition("root", "one", "two")  # not by cluster alone
    found = cut(pairs.groupBy("root", "one", "two").applyInArrow(
        _linked(threshold), "unit long, links long, hub long"))
    joined = components(found.select(F.col("unit").alias("u"), F.col("hub").alias("v")))
    # a text may be the smallest of its block and so its own hub there
    return found.groupBy("unit").agg(F.sum("links").alias("links")).join(
        joined.withColumnRenamed("node", "unit"), "unit", "left").select(
        "unit", "links", F.coalesce("root", "unit").alias("root"))


#: names used on the way
_OWN = ("_unit", "_first", "_key", "_class", "_links", "_copies")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE,
                 trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
                 block: int = BLOCK) -> DataFrame:
    """``docs`` with class_id, n_links (different texts) and n_copies (rows with its text)."""
    return _classed(docs.drop(*_OWN), threshold, size, trees, depth, recall, block).drop("_unit", "_first")


def _classed(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE,
             trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
             block: int = BLOCK) -> DataFrame:
    """jaccard_join() with _unit (hash of the text) and _first (the text that stands for its
    class: of those with the smallest id, nulls last, the one with the least hash); both are null
    for texts without words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.xxhash64("text").alias("unit"))
    signed = texts.where("text IS NOT NULL").mapInArrow(
        _labels(trees, depth, size), "doc_id long, unit long, label binary, sketch binary")
    units = cut(signed.groupBy("unit").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias(
        "copies"), F.first("label").alias("label"), F.first("sketch").alias("sketch")))
    linked = cut(similar_texts(units, texts, threshold, size, trees, depth, recall, block))
    of = units.select("unit", "doc_id", "copies").join(linked, "unit", "left").withColumn(
        "root", F.coalesce("root", "unit"))
    classes = of.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "unit")).alias("least"))
    known = of.join(classes, "root").select(
        F.col("unit").alias("_unit"), F.col("least.doc_id").alias("_class"),
        F.col("links").alias("_links"), F.col("copies").alias("_copies"),
        (F.col("unit") == F.col("least.unit")).alias("_first"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.drop("class_id", "n_links", "n_copies").withColumn(
        "_key", F.when(has_words, F.xxhash64("text")))
    return keyed.join(known, F.col("_key") == F.col("_unit"), "left").withColumns({
        "class_id": F.coalesce("_class", F.col("doc_id").cast("long")),
        "n_links": F.coalesce("_links", F.lit(0)).cast("long"),
        "n_copies": F.coalesce("_copies", F.lit(1)).cast("long"),
    }).drop("_key", "_class", "_links", "_copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each class: a row with the smallest id (without an id if
    none has one) and, of several texts with that id, the one with the least hash. Texts
    without words are classes of their own and stay.
    """
    docs = docs.drop(*_OWN)
    kept = _classed(docs).where(F.coalesce("_first", F.lit(True)) & F.col("doc_id").cast(
        "long").eqNullSafe(F.col("class_id")))
    columns = docs.columns
    single = kept.where("n_copies = 1").select(columns)
    copied = kept.where("n_copies > 1").dropDuplicates(["_unit"]).select(columns)
    return single.unionByName(copied)
