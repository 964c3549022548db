"""Chat formatting with cumulative-snapshot collapse (operator 4).

Chat systems often log the whole conversation again after every turn. A snapshot is a
conversation whose turns are a proper prefix of another one's. Every turn gets a hash of
its rank, role and text; the rolling prefix hash of a turn is the XOR of those up to it
(128 bits in two halves), so it can be built from parts. A conversation is kept when its
(turn count, hash) is no proper prefix of another (an anti-join), one of each set of equal
conversations (the smallest id) is kept, and what is kept is rendered.

Scale: turns are ranked and hashed in chunks, ranges of the rows sorted by conversation and
turn, so a conversation of any length is spread, also one whose turn numbers repeat; ranks and
hashes of the chunks before are added from (conversation, chunk) totals. Prefix hashes are
reduced to distinct ones before the anti-join, so a first turn shared by a third of all
conversations is one row. The rendering is one row per (conversation, block of ``BLOCK`` turns by
rank), so no row holds more turns than that, whatever their numbers are.

Cases: turns sort by (turn, role, text), nulls first; repeated rows are turns of their own;
a null role renders as ``unknown``, a null text as empty text, and null and empty differ in
the hash; rows with a null ``conv_id`` are one conversation with a null id; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.common import cut

BLOCK = 1024
TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")


def _before(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def _same(*keys: str) -> F.Column:
    return F.expr(" AND ".join(f"a.{k} <=> b.{k}" for k in keys))


def ranked(conversations: DataFrame) -> DataFrame:
    """conv_id, block (of ranks), chunk, n, role, text: every turn with its rank (from 1) in the conversation.

    Rows are dealt to chunks by ranges of (conv_id, turn, role, text, place); equal rows differ
    by place, so a chunk is bounded whatever the ids, turn numbers and texts are."""
    order = ["conv_id", "turn", "role", "text", "place"]
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn(
        "place", F.xxhash64(F.monotonically_increasing_id()))
    # bounds are sampled anew by each execution: the chunks are written once
    chunks = cut(turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "chunk", F.spark_partition_id()))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text", "place")
    counts = chunks.groupBy("conv_id", "chunk").agg(F.count("*").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(_before("conv_id")), F.lit(0))).drop("n")
    n = F.col("a.k") + F.col("b.base")
    return chunks.withColumn("k", F.row_number().over(inside)).alias("a").join(
        counts.alias("b"), _same("conv_id", "chunk")).select(
        "a.conv_id", F.floor((n - 1) / BLOCK).alias("block"), "a.chunk", n.alias("n"), "a.role", "a.text")


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, block, n (turns up to this one), h1, h2, role, text of every turn."""
    tag = [F.col("n"), F.col("role").isNull(), F.coalesce("role", F.lit("")),
           F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    tagged = ranked(conversations).withColumn("t1", F.xxhash64(F.lit(1), *tag)).withColumn(
        "t2", F.xxhash64(F.lit(2), *tag))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("n").rowsBetween(
        Window.unboundedPreceding, 0)
    local = tagged.withColumn("x1", F.bit_xor("t1").over(upto)).withColumn(
        "x2", F.bit_xor("t2").over(upto))
    chunks = tagged.groupBy("conv_id", "chunk").agg(
        F.bit_xor("t1").alias("t1"), F.bit_xor("t2").alias("t2"))
    zero = F.lit(0).cast("long")
    chunks = chunks.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(t).over(
        _before("conv_id")), zero).alias(t) for t in ("t1", "t2")])
    return local.alias("a").join(chunks.alias("b"), _same("conv_id", "chunk")).select(
        "a.conv_id", "a.block", "a.n", F.col("a.x1").bitwiseXOR(F.col("b.t1")).alias("h1"),
        F.col("a.x2").bitwiseXOR(F.col("b.t2")).alias("h2"), "a.role", "a.text")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations to keep; ``turns``: prefix_hashes()."""
    last = turns.groupBy("conv_id").agg(F.max("n").alias("n"))
    ends = turns.select("conv_id", "n", "h1", "h2").alias("a").join(
        last.alias("b"), F.expr("a.conv_id <=> b.conv_id")).select(
        "a.*", (F.col("a.n") == F.col("b.n")).alias("whole"))
    proper = ends.where("NOT whole").select("n", "h1", "h2").distinct()
    whole = ends.where("whole").groupBy("n", "h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select(
        "conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per kept conversation and block: conv_id, block, n_turns, n_copies, text."""
    opening, middle, closing = TEMPLATE
    line = F.concat(F.lit(opening), F.coalesce("role", F.lit("unknown")), F.lit(middle),
                    F.coalesce("text", F.lit("")), F.lit(closing))
    joined = turns.select("conv_id", "block", "n", line.alias("line")).alias("a").join(
        kept.alias("b"), F.expr("a.conv_id <=> b.conv_id")).select(
        "a.*", "b.n_turns", "b.n_copies")
    lines = F.array_sort(F.collect_list(F.struct("n", "line")))
    return joined.groupBy("conv_id", "block", "n_turns", "n_copies").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Collapse snapshots, then render the conversations that remain."""
    turns = cut(prefix_hashes(conversations))
    return render(turns, maximal(turns))
