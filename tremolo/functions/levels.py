"""Alarm levels: value banding and level normalisation (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Alarm bands in mm/s, half-open [lower, upper).
# GREEN below 2.8, YELLOW below 11.2, ORANGE below 14, RED from 14 up.
LEVEL_BANDS = (("GREEN", 2.8), ("YELLOW", 11.2), ("ORANGE", 14.0), ("RED", None))
LEVELS = ("GREEN", "YELLOW", "ORANGE", "RED")


def bands(thresholds: tuple[float, float, float] | None = None):
    """Band table as (level, lower, upper) tuples; ``thresholds`` replaces the three cut points."""
    cuts = thresholds or tuple(u for _, u in LEVEL_BANDS if u is not None)
    out, lower = [], None
    for (name, _), upper in zip(LEVEL_BANDS, list(cuts) + [None]):
        out.append((name, lower, upper))
        lower = upper
    return out


def band_level(value: Column | str, thresholds: tuple[float, float, float] | None = None) -> Column:
    """Value -> level. Half-open bands; NaN falls through every ``<`` test and lands in RED
    (as in the reference); a NULL value gives a NULL level."""
    v = F.col(value) if isinstance(value, str) else value
    expr = None
    for name, _lower, upper in bands(thresholds):
        if upper is None:
            expr = expr.otherwise(F.lit(name))
        elif expr is None:
            expr = F.when(v < F.lit(upper), F.lit(name))
        else:
            expr = expr.when(v < F.lit(upper), F.lit(name))
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(expr)


def in_band(level: str, value: Column | str, thresholds: tuple[float, float, float] | None = None) -> Column:
    """``band_level(value) = level`` written as the band's value range, which a parquet scan can check
    against the minimum and maximum of its row groups. NaN is above every number, hence RED."""
    v = F.col(value) if isinstance(value, str) else value
    for name, lower, upper in bands(thresholds):
        if name == level:
            parts = ([v >= F.lit(lower)] if lower is not None else []) + (
                [v < F.lit(upper)] if upper is not None else [])
            return parts[0] if len(parts) == 1 else parts[0] & parts[1]
    return F.lit(False)


def at_level(readings: DataFrame, level: str,
             thresholds: tuple[float, float, float] | None = None) -> DataFrame:
    """PF2: readings at ``level``. With ``thresholds`` (those that the levels were banded with; the
    module's own: ``()``) the value range is asked for as well, so that sorted files are skipped by their
    statistics; a value that is missing although there is a level was NaN, hence RED."""
    same = F.col("level") == level
    if thresholds is None:
        return readings.where(same)
    band = in_band(level, "value", thresholds or None)
    return readings.where(same & (band | F.col("value").isNull() if level == LEVELS[-1] else band))


def normalize_level(raw: Column | str) -> Column:
    """Stored level spelling (``Red``, ``red``, ``RED``) -> upper case, trimmed."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.upper(F.trim(c))


def level_bands_df(spark: SparkSession, thresholds=None) -> DataFrame:
    """The band table as a tiny DataFrame (level, lower, upper, level_order)."""
    rows = [(name, lo, up, i) for i, (name, lo, up) in enumerate(bands(thresholds))]
    return spark.createDataFrame(rows, "level string, lower double, upper double, level_order int")
