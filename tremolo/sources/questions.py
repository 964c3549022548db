"""Question tables: CSV in (quoted fields with line breaks), CSV / parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.operators.ordered import ranks
from tremolo.sources.records import csv_records

# Column names of the reference's question files.
COL_GROUP, COL_QUESTION, COL_ANSWER, COL_VERDICT = "Soru No", "Soru", "Cevap", "Doğru Cevap"
QUESTION_SCHEMA = (f"`{COL_GROUP}` int, `{COL_QUESTION}` string, `{COL_ANSWER}` string, "
                   f"`{COL_VERDICT}` string")


def read_question_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: read a question CSV as (row_no, group_no, question, answer, verdict).

    Answers hold line breaks; ``records.csv_records`` cuts the file into records in any number of
    tasks. ``row_no`` is the 0-based place of the record in its file (of several files in order of
    their names), without header and blank lines."""
    found = csv_records(spark, path).where("record > 0").select(
        F.lit(0).alias("table"), "file", "record", F.from_csv("value", F.lit(QUESTION_SCHEMA), {"escape": '"'}
                                                             ).alias("r"))
    return ranks(found, "table", ("file", "record"), "row_no").select(
        "row_no", F.col(f"r.{COL_GROUP}").cast("long").alias("group_no"),
        F.col(f"r.{COL_QUESTION}").alias("question"),
        F.when(F.length(F.col(f"r.{COL_ANSWER}")) > 0, F.col(f"r.{COL_ANSWER}")).alias("answer"),
        F.col(f"r.{COL_VERDICT}").alias("verdict_in"))


def write_question_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """SNK1: write an answered / checked question table (CSV with header, or parquet)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    else:
        w.parquet(path)
