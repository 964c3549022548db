"""Readings: loaders (strict / lenient) and adapters from the driver tables.

Canonical readings schema:
  reading_id long, machine_id string, ts timestamp_ntz (UTC wall time), value double,
  level string (upper case), level_raw string (as stored), date date
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tremolo.functions.levels import band_level, in_band, normalize_level

RAW_CSV_SCHEMA = "Timestamp string, Value string, Situation string"
READING_COLUMNS = ["reading_id", "machine_id", "ts", "value", "level", "level_raw", "date"]

# Thresholds used when the driver's ``orders`` table stands in for a reading series
# (o_totalprice runs from about 1e3 to 5e5).
ORDERS_THRESHOLDS = (50000.0, 250000.0, 450000.0)


def _EPOCH_NTZ() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
_ZONED = r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)$"


def _to_utc_ntz(ts_text: Column, strict: bool) -> Column:
    """ISO 8601 text -> timestamp_ntz holding UTC wall time, whatever the session zone.

    Text with an offset (or ``Z``) is an instant and becomes its UTC wall time; text
    without one is kept as written (naive), as the reference does."""
    inst = F.to_timestamp(ts_text) if strict else F.try_to_timestamp(ts_text)
    zoned = F.timestamp_add("MICROSECOND", F.unix_micros(inst), _EPOCH_NTZ())
    naive = ts_text.cast("timestamp_ntz") if strict else ts_text.try_cast("timestamp_ntz")
    return F.when(ts_text.rlike(_ZONED), zoned).otherwise(naive)


def load_readings_csv(spark: SparkSession, path: str, mode: str = "strict",
                      machine_id: str = "M1") -> DataFrame:
    """Read a ``Timestamp, Value, Situation`` CSV.

    ``strict``: a bad timestamp or value fails the job (ANSI casts).
    ``lenient``: bad timestamps / values become NULL and those rows are dropped.
    No global sort is done; operators that need order bring their own.
    """
    raw = (spark.read.option("header", True).schema(RAW_CSV_SCHEMA).csv(path)
           .withColumn("reading_id", F.monotonically_increasing_id()))
    strict = mode == "strict"
    if mode not in ("strict", "lenient"):
        raise ValueError(f"mode must be strict or lenient, not {mode!r}")
    value = F.col("Value").cast("double") if strict else F.expr("try_cast(Value AS double)")
    df = raw.select(
        "reading_id",
        F.lit(machine_id).alias("machine_id"),
        _to_utc_ntz(F.col("Timestamp"), strict).alias("ts"),
        value.alias("value"),
        F.col("Situation").alias("level_raw"),
    )
    if not strict:
        df = df.dropna(subset=["ts", "value"])
    return finish_readings(df)


def finish_readings(df: DataFrame) -> DataFrame:
    """Add normalised ``level`` (from ``level_raw``) and ``date``; fix column order. A NaN value
    is a missing one."""
    return (df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
              .withColumn("level", normalize_level("level_raw"))
              .withColumn("date", F.to_date("ts"))
              .select(*READING_COLUMNS))


def readings_from_table(df: DataFrame, *, ts: str, value: str, machine: str | Column,
                        reading_id: str, level: str | None = None,
                        thresholds=None, only_level: str | None = None) -> DataFrame:
    """Adapter: any table with a time, a value, a machine key and a unique id becomes
    readings. Without a level column the level is banded from the value, and ``only_level`` reads
    that level's value range only."""
    if only_level is not None and level is None:
        df = df.where(in_band(only_level, value, thresholds))
    m = F.col(machine) if isinstance(machine, str) else machine
    lv = F.col(level) if level else band_level(F.col(value), thresholds)
    out = df.select(
        F.col(reading_id).cast("long").alias("reading_id"),
        m.cast("string").alias("machine_id"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        F.col(value).cast("double").alias("value"),
        lv.alias("level_raw"),
    )
    done = finish_readings(out)
    return done if only_level is None else done.where(F.col("level") == only_level)


def events_readings(spark: SparkSession, sf_dir: str, only_level: str | None = None) -> DataFrame:
    """Driver ``events`` as readings: one machine per ``event_type``, value banded with
    the reference thresholds."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return readings_from_table(ev, ts="ts", value="value", machine="event_type",
                               reading_id="event_id", only_level=only_level)


def orders_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver ``orders`` as a multi-year series: machine = order priority, value = total
    price, banded with ``ORDERS_THRESHOLDS``. Many readings share a time (ties)."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return readings_from_table(o, ts="o_orderdate", value="o_totalprice",
                               machine="o_orderpriority", reading_id="o_orderkey",
                               thresholds=ORDERS_THRESHOLDS)


def write_readings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Land readings as parquet partitioned by ``date``, so that day and range filters prune files, and sorted
    by machine and value inside, so that machine, value and level filters skip row groups by
    their statistics. A date of any size is cut into ranges."""
    by = ("date", "machine_id", "value")
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode(mode).partitionBy("date").parquet(path)


def clean_readings(df: DataFrame, *, ts: str, value: str, machine: str, reading_id: str,
                   level: str | None = None, thresholds=None) -> DataFrame:
    """SRC2 (lenient): text columns are coerced with ``try_*`` functions, typed ones are cast;
    rows whose time or value does not parse are dropped. No global sort is done."""
    is_text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    t = _to_utc_ntz(F.col(ts), strict=False) if ts in is_text else F.col(ts).cast("timestamp_ntz")
    v = F.col(value).try_cast("double") if value in is_text else F.col(value).cast("double")
    d = (df.withColumn("_t", t).withColumn("_v", v)
         .where(F.col("_t").isNotNull() & F.col("_v").isNotNull() & ~F.isnan("_v")))
    return readings_from_table(d, ts="_t", value="_v", machine=machine, reading_id=reading_id,
                               level=level, thresholds=thresholds)
