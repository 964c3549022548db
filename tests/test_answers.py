import datetime as dt

from pyspark.sql import functions as F

from conftest import SF01, make_readings
from tremolo.functions.text import join_sorted
from tremolo.operators import catalogue as cat
from tremolo.operators import sequence as seq
from tremolo.plans import answers as ans
from tremolo.sources.readings import events_readings, orders_readings


def _by_machine(df, col="answer"):
    return {r.machine_id: r[col] for r in df.collect()}


def test_prepared_rollup_gives_same_answers(spark):
    r = orders_readings(spark, SF01)
    src = cat.prepare(r)
    for fn in (cat.value_summary, cat.yearly_mean, cat.least_fault_day, cat.top_months):
        assert sorted(fn(src).collect()) == sorted(fn(r).collect()), fn.__name__
    assert sorted(cat.year_summary(src, 1998).collect()) == sorted(cat.year_summary(r, 1998).collect())
    assert sorted(cat.level_dates(src, "RED", "1996-01-01", "1996-06-30").collect()) == \
        sorted(cat.level_dates(r, "RED", "1996-01-01", "1996-06-30").collect())
    assert sorted(cat.months_with_level(src, "RED").collect()) == \
        sorted(cat.months_with_level(r, "RED").collect())


def test_catalogue_answers_match_single_operators(spark):
    r = events_readings(spark, SF01)
    a = ans.catalogue_answers(r, year=2024, gap_seconds=600, recent_days=7, recent_levels_days=2)
    got = {(x.machine_id, x.intent_id): x.answer for x in a.collect()}
    peak = _by_machine(cat.peak_days(r, "RED").groupBy("machine_id")
                       .agg(join_sorted(F.col("date")).alias("answer")))
    steps = _by_machine(seq.transition_count(r), "transitions")
    dates = _by_machine(seq.transition_dates(r).groupBy("machine_id")
                        .agg(join_sorted(F.col("date")).alias("answer")))
    top = seq.change_density_top(r, 3).collect()
    for m in peak:
        assert got[(m, 2)] == peak[m] and got[(m, 29)] == peak[m]
        assert got[(m, 27)] == str(steps[m])
        assert got[(m, 19)] == dates[m]
        want = ", ".join(str(x.date) for x in sorted((t for t in top if t.machine_id == m),
                                                    key=lambda t: t.rank))
        assert got[(m, 23)] == want
    assert {k[1] for k in got} == set(range(33)) - {7, 8, 9}


def test_every_question_has_an_answer_or_a_reason(spark):
    """Expected values worked out by hand; one bad row leaves the others alone."""
    readings = make_readings(spark, [
        (1, "2023-02-15 10:00:00", 1.0, None), (2, "2023-02-15 11:00:00", 20.0, None),
        (3, "2023-03-01 10:00:00", 5.0, None)])
    schema = ("qid long, machine_id string, status string, kind string, level string, months int, "
              "month_no int, intent_id int, needs_date boolean, date date, suggestions array<string>")
    day = dt.date(2023, 2, 15)
    rows = [(1, "M1", "pattern", "month_fault", "RED", None, 2, None, False, None, None),
            (2, "M1", "pattern", "month_fault", "RED", None, 3, None, False, None, None),
            (3, "M1", "pattern", "months_count", "ORANGE", None, None, None, False, None, None),
            (4, "M1", "pattern", "months_list", "YELLOW", None, None, None, False, None, None),
            (5, "M1", "pattern", "recent_months", None, 2_000_000_000, None, None, False, None, None),
            (6, "M1", "matched", None, None, None, None, 9, True, day, None),
            (7, "M1", "matched", None, None, None, None, 8, True, dt.date(2023, 2, 16), None),
            (8, "M2", "matched", None, None, None, None, 3, False, None, None),
            (9, None, "pattern", "recent_months", "RED", 1, None, None, False, None, None),
            (10, "M1", "matched", None, None, None, None, 25, False, None, None),
            (11, "M1", "not_found", None, None, None, None, 3, False, None, None)]
    got = {x.qid: (x.answer, x.error) for x in ans.answer_questions(
        spark.createDataFrame(rows, schema), readings).collect()}
    assert got == {
        1: ("2023-02-15", None), 2: (ans.NO, None), 3: ("0", None), 4: ("2023-03", None),
        5: ("2", None), 6: ("1.00 / 20.00 / 10.50", None), 7: (None, "no reading on that date"),
        8: (None, "no readings of that machine"), 9: (None, "no readings of that machine"),
        10: ("2023-02", None), 11: (None, None)}
