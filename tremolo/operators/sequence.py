"""Ordered-sequence operators over readings, without one task holding a whole series.

A plain ``Window.partitionBy(machine).orderBy(ts)`` puts every reading of a machine in one
task; with one machine holding a third of all rows that task holds a third of the table. Here
readings are range-partitioned by (machine, ts, reading_id): the bounds are sampled by Spark, so a
hot machine, a burst within a second, and readings that share one exact time are all cut into even
partitions. Only a partition's first reading needs data from outside it, and that is the last
reading of the partition before, so the carries are a row or two per partition.

``sweep`` reads each sorted partition once, batch by batch, and keeps nothing but those carries:
it emits changes and steps per day, and pieces of runs. A window keyed by the partition would
shuffle all readings a second time, as Spark cannot use a range partitioning for it.

Order is (machine, ts, reading_id). A NULL machine is a machine like any other. Readings without a time
stand before the others of their machine and have a NULL date; they are part of the changes and steps, but of no run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.operators.ordered import last_known, ranged, stored

_ORDER = ("ts", "reading_id")
_FACTS = ("kind string, pid int, k long, machine_id string, day int, first_level string, "
          "last_level string, changes long, steps long, start_us long, end_us long, n long, "
          "at_first boolean, at_last boolean")


def _EPOCH() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _micros(c: str | Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp_ntz (wall time; no time zone, so
    durations do not depend on the session time zone or DST)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", _EPOCH(), col)


def _time(us: str) -> Column:
    return F.timestamp_add("MICROSECOND", F.col(us), _EPOCH())


def with_previous(df: DataFrame, cols: list[str], key: str = "machine_id",
                  partitions: int | None = None) -> DataFrame:
    """Add ``prev_<c>`` for each column in ``cols`` (the value on the previous reading of
    the same ``key`` in (ts, reading_id) order) and ``has_prev``.

    Equal to ``lag(c) over (partition by key order by ts, reading_id)``, computed with windows
    over the range partitions plus the last reading of each (key, partition)."""
    d = last_known(df, key, _ORDER, F.struct(*[F.col(c) for c in cols]), "_prev", before=True,
                   partitions=partitions)
    for c in cols:
        d = d.withColumn(f"prev_{c}", F.col("_prev")[c])
    return d.withColumn("has_prev", F.col("_prev").isNotNull()).drop("_prev")


def level_changes(readings: DataFrame, partitions: int | None = None) -> DataFrame:
    """Readings with ``prev_level`` and ``is_change``: the level differs from the previous
    reading's. The first reading counts as a change, and so does a NULL level on either
    side (NULL != x is true in the reference)."""
    d = with_previous(readings, ["level"], partitions=partitions)
    return d.withColumn("is_change", F.coalesce(F.col("level") != F.col("prev_level"),
                                                F.lit(True)))


def transitions(readings: DataFrame, src: str = "GREEN", dst: str = "RED",
                partitions: int | None = None) -> DataFrame:
    """Readings at ``dst`` whose previous reading is at ``src``."""
    d = with_previous(readings, ["level"], partitions=partitions)
    return d.where((F.col("prev_level") == src) & (F.col("level") == dst))


# ------------------------------------------------------------------ one pass over sorted readings

def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """Equal values have equal codes, NULL is -1; and the values by code."""
    found = column.dictionary_encode()
    return (found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64),
            [*found.dictionary.to_pylist(), None])


class _Partition:
    """What ``sweep`` knows of a partition between two batches: its last reading, and the
    run that is still open."""

    def __init__(self, pid: int, level: str, gap_us: int, src: str, dst: str, daily: bool):
        self.pid, self.level, self.gap_us, self.src, self.dst = pid, level, gap_us, src, dst
        self.daily = daily
        self.head: tuple | None = None  # machine, level and day of the first reading
        self.last: pa.RecordBatch | None = None  # the last reading
        self.run: list | None = None  # machine, start, end, n of the open run
        self.k = 0

    def take(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.daily:
            yield from self._days(batch)
        yield from self._runs(batch)

    def _days(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.head is None:
            self.head = tuple(batch[c][0].as_py() for c in ("machine_id", "level", "day"))
        rows = batch if self.last is None else pa.concat_batches([self.last, batch])
        self.last = rows.slice(rows.num_rows - 1)
        machine, names = _codes(rows["machine_id"])
        level, levels = _codes(rows["level"])
        day = rows["day"].fill_null(-(1 << 31)).to_numpy(zero_copy_only=False)
        fresh = machine[1:] != machine[:-1]
        change = fresh | (level[1:] < 0) | (level[:-1] < 0) | (level[1:] != level[:-1])
        code = {v: c for c, v in enumerate(levels[:-1])}
        step = ~fresh & (level[:-1] == code.get(self.src, -2)) & (level[1:] == code.get(self.dst, -2))
        if rows is batch:  # the partition's first reading waits for the carry; its day has a row
            change, step = np.insert(change, 0, False), np.insert(step, 0, False)
        else:
            machine, day = machine[1:], day[1:]
        new = np.ones(len(machine), bool)
        new[1:] = (machine[1:] != machine[:-1]) | (day[1:] != day[:-1])
        at = np.flatnonzero(new)
        yield _fact_rows(
            "day", self.pid, len(at), machine_id=[names[c] for c in machine[at].tolist()],
            day=[None if d == -(1 << 31) else d for d in day[at].tolist()],
            changes=np.add.reduceat(change.astype(np.int64), at),
            steps=np.add.reduceat(step.astype(np.int64), at))

    def _runs(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at_level = pc.and_(pc.fill_null(pc.equal(batch["level"], self.level), False),
                           pc.is_valid(batch["us"]))
        rows = batch.filter(at_level)
        if not rows.num_rows:
            return
        keys, us, before = rows["machine_id"], rows["us"].to_numpy(), 0
        if self.run is not None:  # its last reading goes in front
            keys = pa.concat_arrays([pa.array([self.run[0]], pa.string()), keys.cast(pa.string())])
            us, before = np.concatenate(([self.run[2]], us)), self.run[3] - 1
        machine, names = _codes(keys)
        begin = np.ones(len(us), bool)
        begin[1:] = (machine[1:] != machine[:-1]) | (us[1:] - us[:-1] > self.gap_us)
        first = np.flatnonzero(begin)
        count = np.diff(np.concatenate((first, [len(us)])))
        start, end = us[first].copy(), us[first + count - 1]
        if self.run is not None:
            start[0], count[0] = self.run[1], count[0] + before
        done = len(first) - 1
        if done:
            yield self._pieces([names[c] for c in machine[first[:done]].tolist()], start[:done],
                               end[:done], count[:done], last=False)
        self.run = [names[machine[first[-1]]], int(start[-1]), int(end[-1]), int(count[-1])]

    def _pieces(self, machines, start, end, n, last: bool) -> pa.RecordBatch:
        k = np.arange(self.k, self.k + len(machines))
        self.k += len(machines)
        return _fact_rows("run", self.pid, len(machines), k=k, machine_id=machines, start_us=start,
                          end_us=end, n=n, at_first=k == 0, at_last=[last] * len(machines))

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.run is not None:
            machine, start, end, n = self.run
            yield self._pieces([machine], [start], [end], [n], last=True)
        if self.head is not None:
            machine, level, day = self.head
            behind, last_level = (self.last[c][0].as_py() for c in ("machine_id", "level"))
            one = machine == behind
            yield _fact_rows("edge", self.pid, 1 if one else 2,
                             machine_id=[machine, behind][:1 if one else 2],
                             day=[day, None][:1 if one else 2],
                             first_level=[level, None][:1 if one else 2],
                             last_level=[last_level] if one else [None, last_level],
                             at_first=[True, False][:1 if one else 2])


def _fact_rows(kind: str, pid: int, rows: int, **columns) -> pa.RecordBatch:
    kinds = {"kind": pa.string(), "pid": pa.int32(), "machine_id": pa.string(), "day": pa.int32(),
             "first_level": pa.string(), "last_level": pa.string(), "at_first": pa.bool_(),
             "at_last": pa.bool_()}
    columns |= {"kind": [kind] * rows, "pid": [pid] * rows}
    names = [f.split()[0] for f in _FACTS.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(c, [None] * rows), kinds.get(c, pa.int64())) for c in names], names=names)


def sweep(readings: DataFrame, level: str = "RED", gap_seconds: float = 60, src: str = "GREEN",
          dst: str = "RED", daily: bool = True, partitions: int | None = None) -> DataFrame:
    """All ordered facts of the readings in one pass over range partitions, stored: rows per (machine,
    day) and partition (``daily``), pieces of runs at ``level``, and the partitions' edges.
    ``runs_of`` and ``days_of`` put them together."""
    gap_us = int(round(gap_seconds * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            if batch.num_rows:
                part = part or _Partition(batch["pid"][0].as_py(), level, gap_us, src, dst, daily)
                yield from part.take(batch)
        if part:
            yield from part.close()

    rows = readings.select(F.col("machine_id").cast("string").alias("machine_id"), *_ORDER, "level")
    rows = ranged(rows, "machine_id", _ORDER, partitions).sortWithinPartitions("machine_id", *_ORDER)
    return stored(rows.select(
        "machine_id", "level", _micros("ts").alias("us"), F.unix_date(F.to_date("ts")).alias("day"),
        F.spark_partition_id().alias("pid")).mapInArrow(run, _FACTS))


def runs_of(facts: DataFrame, gap_seconds: float = 60) -> DataFrame:
    """The runs of a ``sweep`` (with the same gap): pieces at the edges of partitions are joined."""
    gap_us = int(round(gap_seconds * 1_000_000))
    pieces = facts.where("kind = 'run'")
    inner = pieces.where("NOT at_first AND NOT at_last").select(
        "machine_id", "start_us", "end_us", "n")
    w = Window.partitionBy("machine_id").orderBy("pid", "k")  # at most two pieces per partition
    begins = F.coalesce(F.col("start_us") - F.lag("end_us").over(w) > gap_us, F.lit(True))
    edges = pieces.where("at_first OR at_last").withColumn("_b", begins.cast("int")).withColumn(
        "_run", F.sum("_b").over(w)).groupBy("machine_id", "_run").agg(
        F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n").alias("n"))
    return inner.unionByName(edges.drop("_run")).select(
        "machine_id", _time("start_us").alias("start_ts"), _time("end_us").alias("end_ts"), "n",
        ((F.col("end_us") - F.col("start_us")) / F.lit(1e6)).alias("duration_s"))


def days_of(facts: DataFrame, src: str = "GREEN", dst: str = "RED") -> DataFrame:
    """machine_id, date, changes, steps of a ``sweep`` (with the same levels): the first reading of
    each partition is judged by the last one of the partition before."""
    w = Window.partitionBy("machine_id").orderBy("pid")  # at most two rows per partition
    before, prev = F.lag("pid").over(w), F.lag("last_level").over(w)
    change = before.isNull() | F.coalesce(F.col("first_level") != prev, F.lit(True))
    step = F.coalesce(before.isNotNull() & (prev == src) & (F.col("first_level") == dst), F.lit(False))
    heads = facts.where("kind = 'edge'").withColumn("_c", change.cast("long")).withColumn(
        "_s", step.cast("long")).where("at_first").select(
        "machine_id", "day", F.col("_c").alias("changes"), F.col("_s").alias("steps"))
    return facts.where("kind = 'day'").select("machine_id", "day", "changes", "steps").unionByName(
        heads).groupBy("machine_id", F.date_from_unix_date("day").alias("date")).agg(
        F.sum("changes").alias("changes"), F.sum("steps").alias("steps"))


def daily_transitions(readings: DataFrame, src: str = "GREEN", dst: str = "RED",
                      partitions: int | None = None) -> DataFrame:
    """Per (machine, date) the number of level changes and of direct ``src`` -> ``dst`` steps;
    W2, W3 and W4 follow from it."""
    return days_of(sweep(readings, src=src, dst=dst, partitions=partitions), src, dst)


def transition_dates(readings: DataFrame, src: str = "GREEN", dst: str = "RED") -> DataFrame:
    """Distinct dates with a direct ``src`` -> ``dst`` step."""
    return daily_transitions(readings, src, dst).where("steps > 0").select("machine_id", "date")


def transition_count(readings: DataFrame, src: str = "GREEN", dst: str = "RED") -> DataFrame:
    """Number of direct ``src`` -> ``dst`` steps per machine (0 when none)."""
    return daily_transitions(readings, src, dst).groupBy("machine_id").agg(
        F.sum("steps").alias("transitions"))


def change_density_top(readings: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` days with most level changes per machine; earlier day on ties."""
    daily = daily_transitions(readings).where("changes > 0").select("machine_id", "date", "changes")
    w = Window.partitionBy("machine_id").orderBy(F.desc("changes"), F.asc("date"))
    return (daily.withColumn("rank", F.row_number().over(w).cast("long"))
            .where(F.col("rank") <= k))


def level_runs(readings: DataFrame, level: str = "RED", gap_seconds: float = 60,
               partitions: int | None = None) -> DataFrame:
    """Runs of readings at ``level``. Only readings at the level are considered;
    a new run starts when the time since the previous such reading is strictly more
    than ``gap_seconds`` (readings at other levels in between do not split a run).

    Returns machine_id, start_ts, end_ts, n, duration_s (one-row runs last 0 s)."""
    facts = sweep(readings.where(F.col("level") == level), level, gap_seconds, daily=False,
                  partitions=partitions)
    return runs_of(facts, gap_seconds)


def longest_of(runs: DataFrame) -> DataFrame:
    """The longest run per machine; earliest start on ties."""
    w = Window.partitionBy("machine_id").orderBy(F.desc("duration_s"), F.asc("start_ts"))
    return (runs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .drop("_r"))


def longest_run(readings: DataFrame, level: str = "RED", gap_seconds: float = 60) -> DataFrame:
    """The longest run per machine; earliest start on ties."""
    return longest_of(level_runs(readings, level, gap_seconds))
