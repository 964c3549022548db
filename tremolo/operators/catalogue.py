"""Catalogue of analytic questions over readings, as DataFrame operators.

Every operator answers per machine (the single-machine case is one ``machine_id``)
and returns numbers, dates and levels, never formatted text. Operators that only
need counts / sums / extrema per day read the period rollup; the exceptions
(instant bounds, sample std) scan the readings with the filter pushed to the scan.

Rankings that would need an order over the whole table are computed on rolled-up
tables partitioned by machine (at most days x levels rows per machine).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.functions.levels import LEVELS
from tremolo.operators.rollup import period_totals, rollup


class Prepared:
    """Readings together with their daily rollup, computed once.

    Every rollup-based operator below accepts either raw readings or a ``Prepared``;
    with a ``Prepared`` it reads the (small) stored rollup instead of rescanning the
    readings. Operators that need single readings (instant bounds, sample std) still
    read ``readings``."""

    def __init__(self, readings: DataFrame, day_roll: DataFrame):
        self.readings = readings
        self.day_roll = day_roll


def prepare(readings: DataFrame, materialize: bool = True) -> Prepared:
    """Compute the daily rollup once. With ``materialize`` it is checkpointed to the
    shared folder named by ``spark.checkpoint.dir`` (reliable, lineage cut), so later
    answers neither rescan the readings nor depend on cached blocks."""
    roll = rollup(readings, "day")
    if materialize:
        from tremolo.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(readings.sparkSession)
        roll = roll.checkpoint(eager=True)
    return Prepared(readings, roll)


def _readings(src) -> DataFrame:
    return src.readings if isinstance(src, Prepared) else src


def _roll(src, grain: str = "day", date_filter=None) -> DataFrame:
    """The rollup at ``grain``; ``date_filter`` (a function of the date column) is
    applied to the readings scan, or to the stored daily rollup."""
    if isinstance(src, Prepared) and grain in ("day", "month", "year"):
        roll = src.day_roll
        if date_filter is not None:
            roll = roll.where(date_filter(F.col("period")))
        if grain == "day":
            return roll
        return (roll.groupBy("machine_id", F.trunc("period", grain).alias("period"), "level")
                .agg(F.sum("n").alias("n"), F.sum("n_value").alias("n_value"),
                     F.sum("sum_value").alias("sum_value"),
                     F.min("min_value").alias("min_value"),
                     F.max("max_value").alias("max_value"),
                     F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")))
    r = _readings(src)
    if date_filter is not None:
        r = r.where(date_filter(F.col("date")))
    return rollup(r, grain)


def _to_date(d) -> _dt.date:
    return d if isinstance(d, _dt.date) else _dt.date.fromisoformat(str(d))


# ---------------------------------------------------------------- global / period stats

def value_range(readings) -> DataFrame:
    """AG1: min / max value per machine."""
    return (_roll(readings).groupBy("machine_id")
            .agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")))


def value_summary(readings: DataFrame) -> DataFrame:
    """AG2: min / max / mean value per machine."""
    return (_roll(readings).groupBy("machine_id")
            .agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
                 (F.sum("sum_value") / F.sum("n_value")).alias("mean_value")))


def day_summary(readings: DataFrame, day=None) -> DataFrame:
    """AG3 / AG4: min / max / mean per (machine, date); one day when ``day`` is given.
    The day filter is on ``date`` and reaches the scan (partition pruning on a
    date-partitioned table)."""
    flt = None if day is None else (lambda d: d == F.lit(_to_date(day)))
    return (period_totals(_roll(readings, "day", flt))
            .select("machine_id", F.col("period").alias("date"), "min_value", "max_value",
                    (F.col("sum_value") / F.col("n_value")).alias("mean_value"), "n"))


def day_range(readings: DataFrame, day=None) -> DataFrame:
    """AG3: min / max per (machine, date)."""
    return day_summary(readings, day).select("machine_id", "date", "min_value", "max_value")


def year_summary(readings: DataFrame, year: int) -> DataFrame:
    """AG5: min / max / mean in calendar year ``year``, written as a half-open ts range
    (``year(ts) = y`` would stay a row filter)."""
    lo, hi = _dt.date(year, 1, 1), _dt.date(year + 1, 1, 1)
    # on readings the date bounds become ts >= lo and ts < hi at the scan
    flt = lambda d: (d >= F.lit(lo)) & (d < F.lit(hi))
    return (_roll(readings, "day", flt).groupBy("machine_id")
            .agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
                 (F.sum("sum_value") / F.sum("n_value")).alias("mean_value"),
                 F.sum("n").alias("n")))


def yearly_mean(readings: DataFrame) -> DataFrame:
    """AG6: mean value per (machine, year)."""
    return (_roll(readings).groupBy("machine_id", F.year("period").cast("long").alias("year"))
            .agg((F.sum("sum_value") / F.sum("n_value")).alias("mean_value")))


def day_mode_level(readings: DataFrame, day=None) -> DataFrame:
    """AG7: the most frequent level per (machine, date); ties -> alphabetically smallest
    level, NULL levels ignored."""
    flt = None if day is None else (lambda d: d == F.lit(_to_date(day)))
    roll = _roll(readings, "day", flt).where(F.col("level").isNotNull())
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("level").alias("level")))
    return (roll.groupBy("machine_id", F.col("period").alias("date"))
            .agg(best.alias("b"))
            .select("machine_id", "date", F.col("b.level").alias("mode_level"),
                    (-F.col("b.neg_n")).alias("n")))


def level_count_between(readings: DataFrame, start, end, level: str = "RED") -> DataFrame:
    """AG8: rows at ``level`` with ``start <= ts <= end`` (instants; an end given as a date
    means its midnight, so the last day is lost as in the reference). A machine without
    such rows gives 0."""
    r = _readings(readings).where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"),
                                           F.lit(end).cast("timestamp_ntz")))
    counted = r.groupBy("machine_id").agg(F.count_if(F.col("level") == level).alias("n"))
    return _for_every_machine(readings, counted, "n")


def _for_every_machine(readings, counted: DataFrame, *counts: str) -> DataFrame:
    """``counted`` (one row per machine) with zeros for the machines it lacks."""
    source = readings.day_roll if isinstance(readings, Prepared) else _readings(readings)
    machines = source.select("machine_id").distinct()
    return machines.join(counted, "machine_id", "left").select(
        "machine_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def level_duration(readings: DataFrame, level: str = "GREEN", since=None) -> DataFrame:
    """AG9: rows at ``level`` counted as minutes (0 when there is none); hours = rows / 60.
    ``since`` is an optional lower date bound (the reference's question names one, its code
    has none)."""
    wanted = F.col("level") == level
    if since is not None:
        wanted = wanted & (F.col("period") >= F.lit(_to_date(since)))
    return (_roll(readings).groupBy("machine_id")
            .agg(F.sum(F.when(wanted, F.col("n")).otherwise(0)).alias("minutes"))
            .withColumn("hours", F.col("minutes") / F.lit(60.0)))


def peak_days(readings: DataFrame, level: str = "RED") -> DataFrame:
    """AG10: per machine, the days with the most rows at ``level``; all ties kept."""
    daily = (_roll(readings).where(F.col("level") == level)
             .select("machine_id", F.col("period").alias("date"), "n"))
    w = Window.partitionBy("machine_id")
    return (daily.withColumn("max_n", F.max("n").over(w))
            .where(F.col("n") == F.col("max_n")).drop("max_n"))


def level_dates(readings: DataFrame, level: str = "RED", start=None, end=None) -> DataFrame:
    """AG11 / AG12: distinct dates with a reading at ``level``, optionally within
    ``start <= date <= end`` (a date range, pruned at the scan)."""
    def flt(d):
        cond = F.lit(True)
        if start is not None:
            cond = cond & (d >= F.lit(_to_date(start)))
        if end is not None:
            cond = cond & (d <= F.lit(_to_date(end)))
        return cond

    use = flt if (start is not None or end is not None) else None
    return (_roll(readings, "day", use).where(F.col("level") == level)
            .select("machine_id", F.col("period").alias("date")).distinct())


def missing_periods(readings: DataFrame, grain: str = "day") -> DataFrame:
    """AG13: periods between each machine's first and last period with no reading.

    The calendar is generated per machine by ``sequence`` (its size grows with the time
    span, not with the rows) and anti-joined against the present periods."""
    present = period_totals(_roll(readings, grain)).select("machine_id", "period")
    step = F.expr("INTERVAL 1 DAY") if grain == "day" else F.expr("INTERVAL 1 HOUR")
    bounds = present.groupBy("machine_id").agg(F.min("period").alias("lo"),
                                              F.max("period").alias("hi"))
    calendar = bounds.select("machine_id",
                             F.explode(F.sequence("lo", "hi", step)).alias("period"))
    return calendar.join(present, ["machine_id", "period"], "left_anti")


def all_level_periods(readings: DataFrame, grain: str = "day", level: str = "RED") -> DataFrame:
    """AG14: periods in which every reading is at ``level`` (one pass: conditional sum
    against the total, no join)."""
    roll = _roll(readings, grain)
    return (roll.groupBy("machine_id", "period")
            .agg(F.sum("n").alias("n"),
                 F.sum(F.when(F.col("level") == level, F.col("n")).otherwise(0)).alias("n_level"))
            .where(F.col("n") == F.col("n_level"))
            .select("machine_id", "period", "n"))


def _levels_grid(machines: DataFrame) -> DataFrame:
    return machines.select("machine_id", F.explode(F.array(*[F.lit(x) for x in LEVELS]))
                           .alias("level"))


def _with_cutoff(roll: DataFrame, cutoff_of_max) -> DataFrame:
    """Attach per machine ``cutoff = f(max ts)`` to the rollup (window over a rolled-up table)."""
    w = Window.partitionBy("machine_id")
    return roll.withColumn("cutoff", cutoff_of_max(F.max("last_ts").over(w)))


def recent_level_days(readings: DataFrame, days: int = 90) -> DataFrame:
    """AG15: per machine and level, distinct days with a reading at that level and
    ``ts >= max(ts) - days``. A day counts when its last reading at the level is late
    enough, so the rollup answers exactly. Levels without such days give 0."""
    roll = _with_cutoff(_roll(readings), lambda mx: mx - F.expr(f"INTERVAL {int(days)} DAYS"))
    counted = (roll.where(F.col("last_ts") >= F.col("cutoff"))
               .groupBy("machine_id", "level").agg(F.countDistinct("period").alias("days")))
    grid = _levels_grid(roll.select("machine_id").distinct())
    return (grid.join(counted, ["machine_id", "level"], "left")
            .select("machine_id", "level", F.coalesce("days", F.lit(0)).alias("days")))


def recent_levels(readings: DataFrame, days: int = 30) -> DataFrame:
    """AG16: distinct levels seen in the last ``days`` days per machine."""
    roll = _with_cutoff(_roll(readings), lambda mx: mx - F.expr(f"INTERVAL {int(days)} DAYS"))
    return (roll.where((F.col("last_ts") >= F.col("cutoff")) & F.col("level").isNotNull())
            .select("machine_id", "level").distinct())


def least_fault_day(readings: DataFrame) -> DataFrame:
    """AG17: per machine, the day with the lowest share of non-green rows (a NULL level
    counts as a fault); earliest day on ties."""
    roll = _roll(readings)
    daily = (roll.groupBy("machine_id", "period")
             .agg((F.sum(F.when(F.coalesce(F.col("level") != "GREEN", F.lit(True)), F.col("n"))
                         .otherwise(0)) / F.sum("n")).alias("fault_share")))
    best = F.min(F.struct("fault_share", "period"))
    return (daily.groupBy("machine_id").agg(best.alias("b"))
            .select("machine_id", F.col("b.period").alias("date"),
                    F.col("b.fault_share").alias("fault_share")))


def _top_per_machine(df: DataFrame, order_cols, k: int) -> DataFrame:
    w = Window.partitionBy("machine_id").orderBy(*order_cols)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def most_variable_month(readings: DataFrame) -> DataFrame:
    """AG18: per machine, the month with the largest sample standard deviation of value;
    one-row months (NULL std) never win; earliest month on ties."""
    monthly = (_readings(readings)
               .groupBy("machine_id", F.trunc("date", "month").alias("month"))
               .agg(F.stddev_samp("value").alias("std_value"))
               .where(F.col("std_value").isNotNull() & ~F.isnan("std_value")))
    top = _top_per_machine(monthly, [F.desc("std_value"), F.asc("month")], 1)
    return top.select("machine_id", "month", "std_value")


#: no reading is older: a longer look-back means all data, and must not overflow a timestamp
MAX_LOOKBACK_MONTHS = 12 * 1500


def lookback_interval(months: Column) -> Column:
    """A look-back of so many months; beyond the calendar it reaches back over all data."""
    return F.make_ym_interval(F.lit(0), F.least(months, F.lit(MAX_LOOKBACK_MONTHS)).cast("int"))


def recent_months_days(readings: DataFrame, months: int, level: str | None = None) -> DataFrame:
    """AG19 / AG20: distinct days (at ``level`` if given) with ``ts >= max(ts) - months``
    calendar months (clamped at month end)."""
    roll = _with_cutoff(_roll(readings),
                        lambda mx: mx - lookback_interval(F.lit(months)))
    machines = roll.select("machine_id").distinct()
    r = roll.where(F.col("last_ts") >= F.col("cutoff"))
    if level is not None:
        r = r.where(F.col("level") == level)
    counted = r.groupBy("machine_id").agg(F.countDistinct("period").alias("days"))
    return (machines.join(counted, "machine_id", "left")
            .select("machine_id", F.coalesce("days", F.lit(0)).alias("days")))


def month_level_dates(readings: DataFrame, month: int, level: str = "RED") -> DataFrame:
    """AG21: dates at ``level`` in month-of-year ``month`` of any year (empty = no)."""
    return (_roll(readings)
            .where((F.col("level") == level) & (F.month("period") == int(month)))
            .select("machine_id", F.col("period").alias("date")).distinct())


def months_with_level(readings: DataFrame, level: str) -> DataFrame:
    """AG23: months (label yyyy-MM) with at least one reading at ``level``."""
    return (_roll(readings, "month").where(F.col("level") == level)
            .select("machine_id", F.date_format("period", "yyyy-MM").alias("month")).distinct())


def months_with_level_count(readings: DataFrame, level: str) -> DataFrame:
    """AG22: number of months with at least one reading at ``level``, 0 included."""
    return (_roll(readings, "month").groupBy("machine_id").agg(
        F.count_distinct(F.when(F.col("level") == level, F.col("period"))).alias("months")))


def top_days(readings: DataFrame, levels=("GREEN", "YELLOW"), k: int = 3) -> DataFrame:
    """The ``k`` days with most rows at ``levels``; earlier day first on ties."""
    daily = (_roll(readings).where(F.col("level").isin(list(levels)))
             .groupBy("machine_id", F.col("period").alias("date")).agg(F.sum("n").alias("n")))
    return _top_per_machine(daily, [F.desc("n"), F.asc("date")], k)


def top_months(readings: DataFrame, level: str = "GREEN", k: int = 3) -> DataFrame:
    """The ``k`` months with most rows at ``level``; earlier month first on ties."""
    monthly = (_roll(readings, "month").where(F.col("level") == level)
               .groupBy("machine_id", F.date_format("period", "yyyy-MM").alias("month"))
               .agg(F.sum("n").alias("n")))
    return _top_per_machine(monthly, [F.desc("n"), F.asc("month")], k)


def level_profile(readings: DataFrame, thresholds=None) -> DataFrame:
    """SRC7a / SRC7b: the alarm band table (level, lower, upper) with the readings seen
    in each band (n, min, max). The band table is fixed-size; the readings side is
    rolled up before the join."""
    from tremolo.functions.levels import level_bands_df
    stats = (_roll(readings).groupBy("level")
             .agg(F.sum("n").alias("n"), F.min("min_value").alias("min_value"),
                  F.max("max_value").alias("max_value")))
    bands_t = level_bands_df(_readings(readings).sparkSession, thresholds)
    return (bands_t.join(stats, "level", "left")
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("long")))
