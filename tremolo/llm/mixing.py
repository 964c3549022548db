"""Mixing sources to target weights by a low-discrepancy schedule (operator 6).

Each source is laid out in a shuffled order (by a hash of the document) and cut into blocks
of equal tokens. A schedule of slots maps the golden-ratio sequence ``frac(k * phi)``
through the sources' cumulative shares; the r-th slot of a source takes its block
``r mod n_blocks``, so a source wanted more than once is repeated block by block and every
prefix of the schedule is close to the target mix. What a document gives is the sum, over
its pieces in blocks, of piece tokens times the slots of that block.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share all
tokens; a target stops at ``MAX_EPOCHS`` times its source's size and the excess is shared
by weight among the others until none is above.

Scale: nothing runs per source in one task. The layout is range-partitioned by (source, shuffle key, size,
text, row): rows that share an id, or have none, are cut like any others, partition totals are added up
and running sums are taken within a partition only. Slots are ranked the same way, by chunks of
the schedule. Blocks have ``size / PER_SOURCE`` tokens, ``MAX_BLOCK`` at most, so slots
grow with tokens / MAX_BLOCK. The point-to-source search is an equi-join on grid cells.

Cases: null or empty texts have size 0 and give 0; sources without a word have target 0;
where no text has a word nothing is taken; a null source is a source of its own; rows of one id lie side by side,
by size and text, and repeated rows count as often as they occur. An empty table gives an empty result. Columns of the input other than the ones read are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremolo.llm.common import cut
from tremolo.operators import ordered

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
PER_SOURCE = 4096
MAX_BLOCK = 4096
CHUNK = 1 << 16  # slots ranked together
PHI = 0.6180339887498949


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, shuffle key, text hash and a number of every row."""
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", "source", F.coalesce(n, F.lit(0)).cast("long").alias("size"),
                       F.md5(F.concat(F.lit("mix:"), F.coalesce(
                           F.col("doc_id").cast("string"), F.lit("null")))).alias("key"),
                       F.xxhash64("text").alias("text_hash"),
                       F.monotonically_increasing_id().alias("row"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS,
            epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, block (tokens a block), n_blocks, lo, hi.

    One row per source. Water-filling: sources fill up in the order of size / weight, so
    with running sums over that order a source is capped exactly if its cap is below the
    share that the sources not filled before it would get. (lo, hi) is its part of [0, 1).
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                    F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                            turn.cast("int")).cast("double"))
    everything = Window.partitionBy()
    filling = Window.orderBy((F.col("source_size") / F.col("weight")),
                             F.col("source").asc_nulls_last()).rowsBetween(
                                 Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "left_weight", F.sum("weight").over(everything)
        - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))).withColumn(
        "left_tokens", F.col("total")
        - epochs * F.coalesce(F.sum("source_size").over(filling), F.lit(0)))
    s = s.withColumn("full", epochs * F.col("source_size")
                     <= F.col("left_tokens") * F.col("weight") / F.col("left_weight"))
    # the level at the first source that does not fill holds for all after it
    level = F.max(F.when(~F.col("full"), F.struct(
        -F.col("source_size") / F.col("weight"),
        (F.col("left_tokens") / F.col("left_weight")).alias("level")))).over(everything)
    s = s.withColumn("target", F.when(F.col("full"), (epochs * F.col("source_size")).cast("double"))
                     .otherwise(level["level"] * F.col("weight")))
    block = F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(
        F.col("source_size") / F.lit(PER_SOURCE)))).cast("long")
    s = s.withColumn("block", block).withColumn(
        "n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    # slots a source needs: its target over the mean size of its blocks
    need = F.when(F.col("source_size") > 0, F.col("target") * F.col("n_blocks")
                  / F.col("source_size")).otherwise(F.lit(0.0))
    s = s.withColumn("need", need).withColumn("needed", F.sum("need").over(everything))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("up", F.sum("need").over(running))
    some = F.col("needed") > 0  # without a word in any text there are no slots
    return s.withColumn("lo", F.when(some, (F.col("up") - F.col("need")) / F.col("needed")).otherwise(
        0.0)).withColumn("hi", F.when(~some, 0.0).when(
            F.row_number().over(order) == F.count("*").over(everything), 1.0).otherwise(
            F.col("up") / F.col("needed"))).select(
        "source", "source_size", "n_docs", "target", "block", "n_blocks", "need", "lo", "hi")


def schedule(sources: DataFrame, epochs: int = MAX_EPOCHS) -> DataFrame:
    """slot, source, block_no: the mix in order. Slots past a source's last allowed epoch are
    left out (rounding can ask for a few)."""
    spark = sources.sparkSession
    about = sources.agg(F.sum("need").alias("n"), F.count("*").alias("s")).first()
    slots, cells = int(round(about.n or 0)), 4 * max(1, about.s)
    points = spark.range(slots).select(F.col("id").alias("slot"), (
        (F.col("id") * F.lit(PHI)) % 1.0).alias("point")).withColumn(
        "cell", F.floor(F.col("point") * cells).cast("long"))
    parts = sources.where("hi > lo").select(
        "source", "n_blocks", "lo", "hi", F.explode(F.sequence(
            F.floor(F.col("lo") * cells), F.floor(F.col("hi") * cells))).alias("cell"))
    hit = points.join(parts, "cell").where("point >= lo AND point < hi").select(
        "slot", "source", "n_blocks", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    per = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)  # one row per source and chunk of slots
    per = per.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = hit.withColumn("r", F.row_number().over(inside) - 1).alias("a").join(
        per.alias("b"), F.expr("a.source <=> b.source AND a.chunk = b.chunk")).select(
        "a.slot", "a.source", "a.n_blocks", (F.col("a.r") + F.col("b.base")).alias("rank"))
    return ranked.where(F.col("rank") < epochs * F.col("n_blocks")).select(
        "slot", "source", F.pmod("rank", "n_blocks").alias("block_no"))


def layout(sized: DataFrame) -> DataFrame:
    """The rows with words, and start: where a document's tokens lie in its source."""
    return ordered.running_sum(sized.where("size > 0"), "source", ("key", "size", "text_hash", "row"),
                               "size", "start")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every row of ``docs``."""
    sized = cut(sizes(docs))
    sources = cut(targets(sized))
    times = schedule(sources).groupBy("source", "block_no").agg(F.count("*").alias("times"))
    placed = layout(sized).alias("a").join(
        sources.alias("b"), F.expr("a.source <=> b.source")).select(
        "a.*", F.col("b.block").alias("tokens"))
    last = F.floor((F.col("start") + F.col("size") - 1) / F.col("tokens"))
    pieces = placed.withColumn("block_no", F.explode(F.sequence(
        F.floor(F.col("start") / F.col("tokens")), last))).withColumn(
        "piece", F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("tokens"))
        - F.greatest("start", F.col("block_no") * F.col("tokens")))
    given = pieces.alias("a").join(times.alias("b"), F.expr(
        "a.source <=> b.source AND a.block_no = b.block_no"), "left").groupBy(
        "a.doc_id", "a.source", "a.row", "a.size").agg(
        F.sum(F.col("a.piece") * F.coalesce("b.times", F.lit(0))).cast("long").alias("taken"))
    given = given.unionByName(sized.where("size = 0").select(
        "doc_id", "source", "row", "size",
        F.lit(0).cast("long").alias("taken")))
    return given.alias("a").join(sources.alias("b"), F.expr("a.source <=> b.source")).select(
        "a.doc_id", "a.source", "a.size", "b.source_size", "b.target", "a.taken")
