"""Incident summaries: root-cause shares and daily incident counts (chart tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def incidents_from_readings(readings: DataFrame, level: str = "RED",
                            cause_col: str = "machine_id") -> DataFrame:
    """An incidents table derived from readings: one row per (date, cause) with the
    number of readings at ``level`` that day; the cause is taken from ``cause_col``."""
    return (readings.where(F.col("level") == level)
            .groupBy("date", F.col(cause_col).alias("root_cause"))
            .agg(F.count(F.lit(1)).alias("incidents")))


def root_cause_share(incidents: DataFrame, explanations: DataFrame | None = None) -> DataFrame:
    """AG24: per root cause, the number of incident rows and its share of all rows (what
    the reference's pie shows), plus summed incidents and their share. With
    ``explanations`` (a fixed-size dimension) the text is joined on by broadcast."""
    per = (incidents.groupBy("root_cause")
           .agg(F.count(F.lit(1)).alias("rows"), F.sum("incidents").alias("incidents")))
    total = Window.partitionBy()  # over the per-cause table: one row per cause
    out = (per.withColumn("row_share", F.col("rows") / F.sum("rows").over(total))
           .withColumn("incident_share", F.col("incidents") / F.sum("incidents").over(total)))
    if explanations is not None:
        out = out.join(F.broadcast(explanations), "root_cause", "left")
    return out


def daily_incidents(incidents: DataFrame) -> DataFrame:
    """AG25: incidents per date."""
    return incidents.groupBy("date").agg(F.sum("incidents").alias("incidents"))
