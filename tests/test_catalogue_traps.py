"""Hand-worked expectations for the traps of the catalogue (expected values are
worked out from the rows below, not from the code under test)."""
import datetime as dt

from pyspark.sql import functions as F

from conftest import make_readings
from tremolo.operators import catalogue as cat
from tremolo.operators import sequence as seq

D = dt.date


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_year_bounds_s1(spark):
    rows = [(1, "2023-12-30 12:00:00", 20.0, None), (2, "2023-12-31 00:00:00", 20.0, None),
            (3, "2023-12-31 00:01:00", 20.0, None), (4, "2023-12-31 23:59:00", 20.0, None),
            (5, "2024-01-01 00:00:00", 20.0, None)]
    r = make_readings(spark, rows)
    # instant bound (midnight of 12-31): rows 1, 2
    assert cat.level_count_between(r, "2023-01-01", "2023-12-31").first().n == 2
    # date bound: the whole last day counts
    assert _rows(cat.level_dates(r, "RED", "2023-01-01", "2023-12-31"), "date") == \
        [(D(2023, 12, 30),), (D(2023, 12, 31),)]
    # calendar year: four readings
    assert cat.year_summary(r, 2023).first().n == 4


def test_lookback_edges_s3_s4(spark):
    rows = [(1, "2023-03-02 00:00:00", 1.0, None),   # exactly max - 90 days -> in
            (2, "2023-03-01 23:59:59", 5.0, None),   # 1 s earlier -> out
            (3, "2023-05-31 00:00:00", 1.0, None)]   # max
    r = make_readings(spark, rows)
    got = {x.level: x.days for x in cat.recent_level_days(r, 90).collect()}
    assert got == {"GREEN": 2, "YELLOW": 0, "ORANGE": 0, "RED": 0}
    # 3 calendar months before 05-31 is 02-28 (clamped): all three days count
    assert cat.recent_months_days(r, 3).first().days == 3
    assert cat.recent_months_days(r, 3, "YELLOW").first().days == 1


def test_null_level_and_mode_ties_s5_s7(spark):
    rows = [(i, f"2023-04-01 0{i}:00:00", 1.0, None) for i in range(1, 4)] + \
           [(i, f"2023-04-01 0{i}:00:00", 5.0, None) for i in range(4, 7)] + \
           [(7, "2023-04-02 01:00:00", 1.0, "Green"), (8, "2023-04-02 02:00:00", 1.0, "x"),
            (9, "2023-04-02 03:00:00", 1.0, "x"), (10, "2023-04-02 04:00:00", 1.0, "Green")]
    r = make_readings(spark, rows).withColumn(
        "level", F.when(F.col("reading_id").isin(8, 9), F.lit(None)).otherwise(F.col("level")))
    modes = {x.date: x.mode_level for x in cat.day_mode_level(r).collect()}
    assert modes == {D(2023, 4, 1): "GREEN", D(2023, 4, 2): "GREEN"}  # 3/3 tie -> GREEN
    shares = {x.date: x.fault_share for x in
              cat.least_fault_day(r.where("date = '2023-04-02'")).collect()}
    assert shares == {D(2023, 4, 2): 0.5}  # NULL levels count as faults
    changes = _rows(seq.level_changes(r.where("date = '2023-04-02'")), "reading_id", "is_change")
    assert changes == [(7, True), (8, True), (9, True), (10, True)]  # NULL -> NULL is a change


def test_argmax_and_top_three_ties_s8_s9_s10(spark):
    rows, i = [], 0
    for day, n_red, n_green in (("2023-06-01", 2, 1), ("2023-06-02", 2, 0), ("2023-06-03", 1, 3),
                                ("2023-06-04", 0, 3), ("2023-06-05", 0, 3)):
        for k in range(n_red + n_green):
            i += 1
            rows.append((i, f"{day} {k:02d}:00:00", 20.0 if k < n_red else 1.0, None))
    r = make_readings(spark, rows)
    assert _rows(cat.peak_days(r, "RED"), "date") == [(D(2023, 6, 1),), (D(2023, 6, 2),)]
    top = _rows(cat.top_days(r, ("GREEN", "YELLOW"), 3), "rank", "date")
    assert top == [(1, D(2023, 6, 3)), (2, D(2023, 6, 4)), (3, D(2023, 6, 5))]
    # two days without faults: the earlier one
    assert cat.least_fault_day(r).first().date == D(2023, 6, 4)


def test_one_row_month_never_most_variable_s11(spark):
    rows = [(1, "2023-01-05 00:00:00", 1.0, None), (2, "2023-01-06 00:00:00", 3.0, None),
            (3, "2023-02-01 00:00:00", 500.0, None)]
    got = cat.most_variable_month(make_readings(spark, rows)).first()
    assert got.month == D(2023, 1, 1) and abs(got.std_value - 2 ** 0.5) < 1e-12


def test_missing_and_wholly_red_days(spark):
    rows = [(1, "2023-07-01 10:00:00", 20.0, None), (2, "2023-07-01 11:00:00", 20.0, None),
            (3, "2023-07-03 10:00:00", 20.0, None), (4, "2023-07-03 11:00:00", 1.0, None)]
    r = make_readings(spark, rows)
    assert _rows(cat.missing_periods(r, "day"), "period") == [(D(2023, 7, 2),)]
    assert _rows(cat.all_level_periods(r, "day", "RED"), "period") == [(D(2023, 7, 1),)]


def test_level_case_is_normalised_s23(spark):
    rows = [(1, "2023-08-01 00:00:00", 20.0, "RED"), (2, "2023-08-01 01:00:00", 20.0, "red"),
            (3, "2023-08-01 02:00:00", 20.0, "Red")]
    r = make_readings(spark, rows)
    assert cat.peak_days(r, "RED").first().n == 3


def test_since_bound_s14_and_empty_results_s15(spark):
    rows = [(1, "2023-01-10 00:00:00", 1.0, None), (2, "2023-01-20 00:00:00", 1.0, None),
            (3, "2023-01-21 00:00:00", 1.0, None)]
    r = make_readings(spark, rows)
    assert cat.level_duration(r, "GREEN").first().minutes == 3
    assert cat.level_duration(r, "GREEN", since="2023-01-15").first().minutes == 2
    # no red readings: empty answers, no error
    assert seq.longest_run(r, "RED", 60).count() == 0
    assert cat.peak_days(r, "RED").count() == 0
    empty = r.where("value > 1000")
    assert cat.value_summary(empty).count() == 0
    assert cat.day_mode_level(empty, "2023-01-10").count() == 0
