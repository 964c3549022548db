import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01, make_readings
from tremolo.operators import ordered
from tremolo.operators import sequence as seq
from tremolo.sources.readings import events_readings

T = dt.datetime.fromisoformat


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_runs_gap_is_strict_and_stitched(spark):
    rows = [
        (1, "2023-05-01 10:00:00", 20.0, None),
        (2, "2023-05-01 10:01:00", 20.0, None),   # 60 s -> same run
        (3, "2023-05-01 10:01:30", 1.0, None),    # green in between: does not split
        (4, "2023-05-01 10:02:00", 20.0, None),   # 60 s after the red at 10:01 -> same run
        (5, "2023-05-01 10:03:01", 20.0, None),   # 61 s -> new run
        (6, "2023-05-01 23:59:30", 20.0, None),   # run across midnight
        (7, "2023-05-02 00:00:30", 20.0, None),
        (8, "2023-05-02 00:01:30", 20.0, None),
        (9, "2023-05-03 08:00:00", 20.0, None),   # single-row run, 0 s
    ]
    r = make_readings(spark, rows)
    for parts in (1, 3, 9):
        runs = _rows(seq.level_runs(r, "RED", 60, parts), "start_ts", "end_ts", "n")
        assert runs == [
            (T("2023-05-01 10:00:00"), T("2023-05-01 10:02:00"), 3),
            (T("2023-05-01 10:03:01"), T("2023-05-01 10:03:01"), 1),
            (T("2023-05-01 23:59:30"), T("2023-05-02 00:01:30"), 3),
            (T("2023-05-03 08:00:00"), T("2023-05-03 08:00:00"), 1),
        ], parts
        longest = seq.longest_run(r, "RED", 60).collect()
        # two runs of 120 s: the earlier one wins
        assert [(x.start_ts, x.duration_s) for x in longest] == [(T("2023-05-01 10:00:00"), 120.0)]


def test_longest_run_tie_takes_earliest(spark):
    rows = [(1, "2023-01-01 00:00:00", 20.0, None), (2, "2023-01-01 00:01:00", 20.0, None),
            (3, "2023-01-02 00:00:00", 20.0, None), (4, "2023-01-02 00:01:00", 20.0, None)]
    got = seq.longest_run(make_readings(spark, rows), "RED", 60).collect()
    assert [x.start_ts for x in got] == [T("2023-01-01 00:00:00")]


def test_transitions_across_midnight_and_empty_day(spark):
    rows = [
        (1, "2023-03-01 23:59:00", 1.0, None),   # green
        (2, "2023-03-02 00:00:00", 20.0, None),  # red: green->red on 03-02
        (3, "2023-03-02 12:00:00", 1.0, None),   # green, then nothing on 03-03
        (4, "2023-03-04 06:00:00", 20.0, None),  # red: green->red on 03-04
        (5, "2023-03-04 06:01:00", 5.0, None),
    ]
    r = make_readings(spark, rows)
    assert _rows(seq.transition_dates(r), "date") == [(dt.date(2023, 3, 2),), (dt.date(2023, 3, 4),)]
    assert seq.transition_count(r).collect()[0].transitions == 2


def test_null_level_counts_as_change(spark):
    rows = [(1, "2023-03-01 00:00:00", 1.0, "Green"), (2, "2023-03-01 00:01:00", 1.0, "n"),
            (3, "2023-03-01 00:02:00", 1.0, "Green")]
    r = make_readings(spark, rows).withColumn(
        "level", F.when(F.col("reading_id") == 2, F.lit(None)).otherwise(F.col("level")))
    r = r.union(make_readings(spark, [(4, "2023-03-01 00:03:00", None, None)]).withColumn(
        "level", F.lit(None).cast("string")))
    ch = _rows(seq.level_changes(r), "reading_id", "is_change")
    # first row, GREEN->NULL, NULL->GREEN, GREEN->NULL are all changes
    assert ch == [(1, True), (2, True), (3, True), (4, True)]


def test_stitched_lag_equals_plain_window(spark):
    r = events_readings(spark, SF01)
    w = Window.partitionBy("machine_id").orderBy("ts", "reading_id")
    plain = r.select("reading_id", F.lag("level").over(w).alias("p"))
    for parts in (1, 7, 50):
        st = seq.with_previous(r, ["level"], partitions=parts).select(
            "reading_id", F.col("prev_level").alias("p"))
        assert plain.exceptAll(st).count() == 0 and st.exceptAll(plain).count() == 0


def test_runs_equal_plain_window_property(spark):
    rnd = random.Random(7)
    base = dt.datetime(2023, 1, 1)
    rows, t = [], base
    for i in range(400):
        t += dt.timedelta(seconds=rnd.choice([10, 30, 59, 60, 61, 120, 3000]))
        rows.append((i, t.isoformat(sep=" "), rnd.choice([1.0, 5.0, 20.0, 20.0]), None))
    r = make_readings(spark, rows)
    # plain single-window reference implementation
    red = [x for x in rows if x[2] >= 14]
    runs, start, prev, n = [], None, None, 0
    for _, ts, _, _ in red:
        ts = T(ts)
        if prev is None or (ts - prev).total_seconds() > 60:
            if start is not None:
                runs.append((start, prev, n))
            start, n = ts, 0
        prev, n = ts, n + 1
    runs.append((start, prev, n))
    for parts in (2, 40):
        got = _rows(seq.level_runs(r, "RED", 60, parts), "start_ts", "end_ts", "n")
        assert got == sorted(runs)


def test_runs_partition_red_rows_and_ignore_partitioning(spark):
    r = events_readings(spark, SF01)
    runs = seq.level_runs(r, "RED", 600)
    red = r.where(F.col("level") == "RED").count()
    assert runs.agg(F.sum("n")).first()[0] == red
    w = Window.partitionBy("machine_id").orderBy("start_ts")
    overlaps = (runs.withColumn("_prev_end", F.lag("end_ts").over(w))
                .where(F.col("_prev_end") >= F.col("start_ts")).count())
    assert overlaps == 0
    again = seq.level_runs(r.repartition(7, "reading_id"), "RED", 600)
    assert runs.exceptAll(again).count() == 0 and again.exceptAll(runs).count() == 0


def _plain(rows, gap):
    """Runs, and changes and steps per day, of (reading_id, machine, ts, level) by the definition."""
    order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[2] is not None, x[2] or T("2000-01-01"),
                                        x[0]))
    days, runs, prev, run = {}, [], None, None
    for _, machine, ts, level in order:
        day = days.setdefault((machine, ts and ts.date()), [0, 0])
        same = prev is not None and prev[0] == machine
        day[0] += not same or level is None or prev[1] is None or level != prev[1]
        day[1] += same and prev[1] == "GREEN" and level == "RED"
        prev = (machine, level)
        if level == "RED" and ts is not None:
            if run and run[0] == machine and (ts - run[2]).total_seconds() <= gap:
                run[2], run[3] = ts, run[3] + 1
            else:
                run = [machine, ts, ts, 1]
                runs.append(run)
    return sorted(map(tuple, runs), key=str), sorted(
        [(m, d, c, s) for (m, d), (c, s) in days.items()], key=str)


def _series(n, seed, hot=0.4):
    """A hot machine, a NULL machine, NULL levels and times, and a burst at one exact time."""
    r = random.Random(seed)
    rows, base = [], dt.datetime(2023, 9, 1, 23, 50)
    for i in range(n):
        machine = "M1" if r.random() < hot else r.choice(["A", "B", None, "Z"])
        ts = base + dt.timedelta(seconds=r.choice([0, r.randrange(1800), r.randrange(86400 * 3)]))
        if r.random() < .02:
            ts = None
        rows.append((i, machine, ts, r.choice(["GREEN", "RED", "RED", "YELLOW", None])))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame(rows, "reading_id long, machine_id string, ts timestamp_ntz, level string"
                                 ).withColumn("date", F.to_date("ts"))


def test_sweep_equals_the_definition(spark):
    """Any number of partitions, batches of a few rows, NULL machines, times and levels."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for seed, n in ((1, 0), (2, 1), (3, 60), (4, 500)):
        rows = _series(n, seed)
        runs, days = _plain(rows, 30)
        for parts, size in ((1, 7), (4, 1000), (30, 1)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            facts = seq.sweep(_frame(spark, rows), "RED", 30, partitions=parts)
            assert sorted([(x.machine_id, x.start_ts, x.end_ts, x.n) for x in seq.runs_of(
                facts, 30).collect()], key=str) == runs, (n, parts)
            assert sorted([tuple(x) for x in seq.days_of(facts).collect()], key=str) == days, (n, parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        alone = seq.level_runs(_frame(spark, rows), "RED", 30, partitions=5)
        assert sorted([(x.machine_id, x.start_ts, x.end_ts, x.n) for x in alone.collect()], key=str) == runs


def test_bursts_and_ties_are_cut_into_even_partitions(spark):
    """20 000 readings of one machine at one exact time do not meet in one task."""
    rows = _frame(spark, []).union(spark.range(20_000).selectExpr(
        "id", "'M'", "timestamp_ntz'2023-01-01 00:00:00'",
        "CASE WHEN id % 3 = 0 THEN 'GREEN' ELSE 'RED' END", "date'2023-01-01'"))
    sizes = ordered.ranged(rows, "machine_id", ("ts", "reading_id"), 16).groupBy(F.spark_partition_id()).count()
    sizes = [x["count"] for x in sizes.collect()]
    assert len(sizes) >= 12 and max(sizes) < 3 * 20_000 / 16
    got = seq.daily_transitions(rows, partitions=16).first()
    assert (got.changes, got.steps) == (1 + 6667 + 6666, 6667)


def test_ordered_queries_scan_the_readings_once(spark):
    """The sampling of the bounds and the one pass are the only reads of the readings."""
    from tremolo import registry as R
    for name in ("red_runs", "longest_red_run", "green_to_red_dates", "green_to_red_count",
                 "change_density_top"):
        df = R.QUERIES[name](spark, SF01)
        assert not [f for f in df.inputFiles() if "events" in f], name  # it reads the stored facts
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString(), name


def test_previous_with_null_machine_and_ties(spark):
    rows = _series(400, 6)
    r = _frame(spark, rows)
    w = Window.partitionBy("machine_id").orderBy("ts", "reading_id")
    plain = r.select("reading_id", F.lag("level").over(w).alias("p"), F.lag("reading_id").over(w).isNotNull())
    for parts in (3, 25):
        st = seq.with_previous(r, ["level"], partitions=parts).select("reading_id", "prev_level", "has_prev")
        assert st.count() == 400
        assert plain.exceptAll(st).count() == 0 and st.exceptAll(plain).count() == 0
