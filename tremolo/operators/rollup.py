"""Period rollup of readings: one row per (machine, period, level).

Every aggregate here is mergeable (count, sum, min, max), so the rollup is a single
hash aggregation with a map-side partial step: the shuffle carries at most
machines x periods x levels rows per map task, whatever the size of the readings.
Most catalogue answers are read from it instead of rescanning the readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAINS = ("day", "hour", "month", "year")


def period_expr(grain: str, ts: str = "ts", date: str = "date") -> Column:
    """Period key. ``day`` and coarser give a DATE, ``hour`` a timestamp_ntz."""
    if grain == "day":
        return F.col(date)
    if grain == "hour":
        t = F.col(ts)  # built from the wall-time fields: independent of the session zone
        return F.make_timestamp_ntz(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t),
                                    F.lit(0), F.lit(0))
    if grain in ("month", "year"):
        return F.trunc(F.col(date), grain)
    raise ValueError(f"grain must be one of {GRAINS}")


def rollup(readings: DataFrame, grain: str = "day") -> DataFrame:
    """(machine_id, period, level) -> n, n_value, sum_value, m2, min_value, max_value, first_ts,
    last_ts, n_midnight. ``m2`` is the sum of squared deviations from the group's mean, so that
    deviations of longer periods merge without cancellation; ``n_midnight`` counts the
    readings at exactly 00:00, so that instant bounds given as dates are answered exactly."""
    return (readings
            .groupBy("machine_id", period_expr(grain).alias("period"), "level")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.count("value").alias("n_value"),
                 F.sum("value").alias("sum_value"),
                 (F.var_pop("value") * F.count("value")).alias("m2"),
                 F.min("value").alias("min_value"),
                 F.max("value").alias("max_value"),
                 F.min("ts").alias("first_ts"),
                 F.max("ts").alias("last_ts"),
                 F.count_if(F.col("ts") == F.to_date("ts").cast("timestamp_ntz"))
                 .alias("n_midnight")))


def period_totals(roll: DataFrame) -> DataFrame:
    """Collapse levels: (machine_id, period) -> n, n_value, sum_value, min_value, max_value."""
    return (roll.groupBy("machine_id", "period")
            .agg(F.sum("n").alias("n"), F.sum("n_value").alias("n_value"),
                 F.sum("sum_value").alias("sum_value"),
                 F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
                 F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")))
