"""The daily rollup as a Structured Streaming aggregation.

Readings arriving as files are rolled up per (machine, day, level) with the same
mergeable aggregates as the batch rollup (count, sum, min, max). A watermark on the
reading time bounds the state: a day is final once the watermark passes its end, and
is then appended to the sink. Late readings beyond the watermark are dropped by Spark,
so the watermark delay must cover the expected lateness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.sources.readings import finish_readings


def stream_readings(spark: SparkSession, path: str, schema: str, *, ts: str, value: str,
                    machine: str, reading_id: str, level_expr=None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming readings DataFrame over a folder of parquet files."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.parquet(path)
    from tremolo.functions.levels import band_level
    lv = level_expr if level_expr is not None else band_level(F.col(value))
    df = raw.select(F.col(reading_id).cast("long").alias("reading_id"),
                    F.col(machine).cast("string").alias("machine_id"),
                    F.col(ts).cast("timestamp_ntz").alias("ts"),
                    F.col(value).cast("double").alias("value"),
                    lv.alias("level_raw"))
    return finish_readings(df)


def streaming_daily_rollup(readings: DataFrame, watermark: str = "1 day") -> DataFrame:
    """(machine_id, period, level) -> n, n_value, sum_value, min_value, max_value,
    first_ts, last_ts, with ``period`` the day; emitted once per closed day."""
    # event time must be a zoned TIMESTAMP; the session time zone is UTC
    w = F.window(F.col("_event_time"), "1 day")
    return (readings.withColumn("_event_time", F.col("ts").cast("timestamp"))
            .withWatermark("_event_time", watermark)
            .groupBy("machine_id", w.alias("w"), "level")
            .agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"),
                 F.sum("value").alias("sum_value"), F.min("value").alias("min_value"),
                 F.max("value").alias("max_value"), F.min("ts").alias("first_ts"),
                 F.max("ts").alias("last_ts"))
            .select("machine_id", F.to_date(F.col("w.start")).alias("period"), "level", "n",
                    "n_value", "sum_value", "min_value", "max_value", "first_ts", "last_ts"))


def run_rollup_to_parquet(rollup_stream: DataFrame, out_path: str, checkpoint: str,
                          available_now: bool = True):
    """Append closed days to parquet; the checkpoint folder makes the query restartable
    (exactly-once file sink)."""
    writer = (rollup_stream.writeStream.outputMode("append").format("parquet")
              .option("path", out_path).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
