"""Validated date-range requests (the chart tab's input check), for many requests at once.

A request (start, end) as ``YYYY-MM-DD`` text gets one status, tested in order:
``bad_format``, ``start_after_end``, ``out_of_bounds`` (outside the accepted dates),
``no_data`` (no reading in [start 00:00:00, end 23:59:59]), ``ok``.

Counting readings per request is one sweep over dates, which never joins requests with readings: the counts of
each day (split at 23:59:59) and the two bounds of every request are events in date order, and a running sum
over range partitions gives, at a bound, the readings before it. A request's count is the difference of its
bounds. The readings are read once, for the day counts, and the requests once; a date that most
requests ask for is cut like any other.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.operators.ordered import running_sum

# The accepted date range of the reference's chart tab.
MIN_DATE, MAX_DATE = "2023-01-08", "2023-12-23"


def day_counts(readings: DataFrame) -> DataFrame:
    """(date, n, n_last): readings that day, and those of them up to 23:59:59."""
    last_second = (F.col("ts") <= F.to_timestamp_ntz(F.col("date").cast("string")) +
                   F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))
    return readings.where("date IS NOT NULL").groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(last_second).alias("n_last"))


def range_requests(requests: DataFrame, readings: DataFrame, min_date: str = MIN_DATE,
                   max_date: str = MAX_DATE) -> DataFrame:
    """PF10: requests (request_id, start, end) -> status and number of readings."""
    pat = r"^\d{4}-\d{2}-\d{2}$"
    start, end = (F.try_to_date(F.col(c), "yyyy-MM-dd") for c in ("start", "end"))
    fmt_ok = F.coalesce(F.col("start").rlike(pat) & F.col("end").rlike(pat) & start.isNotNull()
                        & end.isNotNull(), F.lit(False))
    asked = requests.select(F.struct(*requests.columns).alias("request"), F.when(fmt_ok, start).alias("s"),
                            F.when(fmt_ok, end).alias("e"), F.monotonically_increasing_id().alias("row"))
    # at one date: start bounds, readings up to 23:59:59, end bounds, the readings after
    place = ("at date", "part int", "row long", "n long")

    def event(at, part, row, n):
        return F.struct(*[x.cast(p.split()[1]).alias(p.split()[0]) for x, p in zip((at, part, row, n), place)])
    row, none = F.col("row"), F.lit(None)
    bounds = asked.select("request", "s", "e", F.explode(F.when(F.col("s").isNull(), F.array(
        event(none, F.lit(0), row, none))).otherwise(F.array(
            event(F.col("s"), F.lit(0), row, none), event(F.col("e"), F.lit(2), row, none)))).alias("x"))
    days = day_counts(readings).select(F.explode(F.array(
        event(F.col("date"), F.lit(1), F.lit(-1), F.col("n_last")),
        event(F.col("date"), F.lit(3), F.lit(-1), F.col("n") - F.col("n_last")))).alias("x"))
    events = bounds.unionByName(days, allowMissingColumns=True).select("request", "s", "e", "x.*").withColumn(
        "line", F.lit(0))
    swept = running_sum(events, "line", ("at", "part", "row"), "n", "before").where("row >= 0")
    signed = F.when(F.col("part") == 2, F.col("before")).otherwise(-F.col("before"))
    counted = swept.groupBy("row").agg(F.first("request").alias("request"), F.first("s").alias("s"),
                                       F.first("e").alias("e"), F.sum(signed).alias("n"))
    lo, hi = _dt.date.fromisoformat(min_date), _dt.date.fromisoformat(max_date)
    status = (F.when(F.col("s").isNull(), F.lit("bad_format"))
              .when(F.col("s") > F.col("e"), F.lit("start_after_end"))
              .when((F.col("s") < F.lit(lo)) | (F.col("e") > F.lit(hi)), F.lit("out_of_bounds"))
              .when(F.col("n") == 0, F.lit("no_data"))
              .otherwise(F.lit("ok")))
    return counted.withColumn("status", status).select("request.*", "status", F.when(
        F.col("status") == "ok", F.col("n")).cast("long").alias("n_readings"))


def range_readings(readings: DataFrame, start: str, end: str) -> DataFrame:
    """The readings of one accepted range: [start 00:00:00, end + 1 day - 1 s]."""
    lo = F.to_timestamp_ntz(F.lit(start))
    hi = F.to_timestamp_ntz(F.lit(end)) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    return readings.where((F.col("ts") >= lo) & (F.col("ts") <= hi))
