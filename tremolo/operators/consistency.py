"""Answer consistency: each answer compared with its group leader's answer.

Groups are either fixed-size blocks of consecutive rows (``by="block"``, the
reference's 5-row rule) or all rows sharing a question number (``by="question"``).
The leader's answer is found by aggregation (``min_by`` over the row number, with a
map-side partial step, so a hot group is not gathered in one task) and joined back;
AQE splits a skewed join partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Verdict words written by the reference's check.
AGREE, DISAGREE = "evet", "hayır"


def dense_row_number(df: DataFrame, key: str, out: str = "row_no",
                     partitions: int | None = None) -> DataFrame:
    """0-based row number in ``key`` order (``key`` unique), without a single-partition
    window. Rows are range-partitioned on ``key`` (sampled bounds, so partitions stay
    balanced whatever the key distribution) and sorted inside each partition;
    ``monotonically_increasing_id`` then holds the partition id (upper bits) and the
    position in the partition (lower 33 bits). Offsets come from the per-partition
    counts: one row per partition, so that table has a fixed bound and is broadcast.
    Pass only the columns that are needed: the numbered rows are written once."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = (df.repartitionByRange(n, key).sortWithinPartitions(key)
         .withColumn("_mid", F.monotonically_increasing_id()))
    # Range bounds are sampled anew by each execution, so the numbered rows are
    # materialised once (reliable checkpoint in the shared folder) and both uses below
    # read the same partitions.
    from tremolo.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    d = d.checkpoint(eager=True)
    d = (d.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
         .withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid"), 33)))
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    wo = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(wo), F.lit(0)).alias("_off"))
    return (d.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_mid", "_pid", "_local", "_off"))


def answer_consistency(df: DataFrame, answer: str = "answer", row_no: str = "row_no",
                       by: str = "block", block_size: int = 5,
                       group_col: str | None = None) -> DataFrame:
    """Add ``grp``, ``leader_answer`` and ``verdict``: NULL on the leader (first row of
    the group), ``evet`` when the answer equals the leader's, otherwise ``hayır``.
    A NULL answer on either side never agrees (NaN != NaN in the reference)."""
    if by == "block":
        d = df.withColumn("grp", F.floor(F.col(row_no) / F.lit(block_size)).cast("long"))
    elif by == "question":
        if group_col is None:
            raise ValueError("by='question' needs group_col")
        d = df.withColumn("grp", F.col(group_col))
    else:
        raise ValueError("by must be 'block' or 'question'")
    leaders = (d.groupBy("grp")
               .agg(F.min(F.struct(F.col(row_no).alias("r"), F.col(answer).alias("a")))
                    .alias("_l"))
               .select("grp", F.col("_l.r").alias("_leader_row"),
                       F.col("_l.a").alias("leader_answer")))
    d = d.join(leaders, "grp")
    same = F.coalesce(F.col(answer) == F.col("leader_answer"), F.lit(False))
    verdict = (F.when(F.col(row_no) == F.col("_leader_row"), F.lit(None).cast("string"))
               .when(same, F.lit(AGREE)).otherwise(F.lit(DISAGREE)))
    return d.withColumn("verdict", verdict).drop("_leader_row")


def answer_agreement(checked: DataFrame) -> DataFrame:
    """AG26: number of rows per verdict (NULL = group leaders)."""
    return checked.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))
