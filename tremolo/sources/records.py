"""Records of text files that hold line breaks, or no line breaks at all, read by many tasks.

A file is read as fragments between two separators, which Spark's text source cuts at any split of
the file. Whether a separator lies inside quotes follows from the number of quotes before it: the quotes of each
fragment are counted, and a running sum over range partitions gives their parity. Fragments up to a
separator outside quotes make a record. No task holds a file and no row more than a record, however long the file is.

Fragments are ordered by (file, start of the split, place in it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.operators.ordered import running_sum

_ORDER = ("block", "place")


def fragments(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """file, block, place, value: what lies between two separators."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value")


def records(parts: DataFrame, quotes: Column, separator: str) -> DataFrame:
    """file, record (from 0), value: fragments joined up to a separator outside quotes; ``quotes`` counts
    the quotes of a fragment's ``value``."""
    counted = running_sum(parts.withColumn("q", quotes.cast("long")), "file", _ORDER, "q", "before")
    ends = ((F.col("before") + F.col("q")) % 2 == 0).cast("long")
    numbered = running_sum(counted.withColumn("ends", ends).drop("q", "before"), "file", _ORDER, "ends", "record")
    whole = F.array_sort(F.collect_list(F.struct(*_ORDER, "value")))
    return numbered.groupBy("file", "record").agg(whole.alias("v")).select(
        "file", "record", F.array_join(F.transform("v", lambda x: x["value"]), separator).alias("value"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files whose quoted fields may hold line breaks (quotes are doubled), with
    the header (record 0 of a file) and without blank lines."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    found = records(fragments(spark, path, "\n"), quotes, "\n")
    plain = F.regexp_replace(F.col("value"), "\r$", "")
    return found.withColumn("value", F.when(F.col("record") == 0, F.regexp_replace(
        plain, "^\ufeff", "")).otherwise(plain)).where(F.col("value") != "")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """file, record, value: the text up to and including each closing brace outside strings."""
    quotes = F.regexp_count(F.regexp_replace("value", r"\\[\s\S]", ""), F.lit('"'))
    found = records(fragments(spark, path, "}"), quotes, "}")
    return found.withColumn("value", F.concat("value", F.lit("}")))
