"""Answering routed questions: joins from question tables to pre-aggregated results.

Questions are never joined to readings. Every kind of question is answered from the
daily rollup, which is small next to the readings:
  * catalogue entries without parameters -> one answer row per (machine, entry),
    computed once per readings snapshot (J3);
  * entries that take a date -> the per-(machine, date) daily table (J4);
  * look-back questions -> days per (machine, level, months) (J5);
  * month questions -> a row per (machine, level) and per (machine, month).
All these answers form one table (machine, key, answer), which the questions meet in
a single left join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremolo.functions.levels import LEVELS, bands
from tremolo.functions.text import join_sorted
from tremolo.operators import catalogue as cat
from tremolo.operators import sequence as seq
from tremolo.plans.intents import entries
from tremolo.session import ensure_checkpoint_dir
from tremolo.sources.static import STATIC_ANSWERS


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on equal columns, NULL being equal to NULL: a NULL machine is a machine like any other."""
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    cond = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(r, cond, how).drop(*[f"_r_{c}" for c in on])


def daily_table(readings: DataFrame) -> DataFrame:
    """(machine_id, date) -> min, max, mean value and dominant level."""
    s = cat.day_summary(readings)
    m = cat.day_mode_level(readings).select("machine_id", "date", "mode_level")
    return _joined(s, m, ["machine_id", "date"])


def answer_day_questions(questions: DataFrame, readings: DataFrame,
                         date_col: str = "date") -> DataFrame:
    """Questions with (machine_id, date) get that day's statistics (NULL when the
    machine has no reading that day)."""
    daily = daily_table(readings).withColumnRenamed("date", date_col)
    return _joined(questions, daily, ["machine_id", date_col])


#: level of a look-back that asks for any reading
ANY_LEVEL = "ANY"


def lookback_days(readings) -> DataFrame:
    """(machine_id, level, months, days, span): days with a reading at ``level`` (``ANY_LEVEL``:
    at all) and ts >= max ts - months, for every look-back up to ``span`` months, which
    reaches over all data of the machine.

    A day's last reading at a level enters at one smallest look-back: the difference of the
    calendar months, or one more. Days are counted by that number and added up, so the
    table has machines x levels x months of data rows."""
    roll = cat._roll(readings).select("machine_id", "period", "level", "last_ts")
    last = roll.groupBy("machine_id").agg(F.max("last_ts").alias("_mx"))

    def month_index(ts: str) -> Column:
        return F.year(ts) * 12 + F.month(ts)

    apart = month_index("_mx") - month_index("last_ts")
    enters = apart + (F.col("last_ts") < F.col("_mx") - cat.lookback_interval(apart)).cast("int")
    seen = _joined(roll, last, ["machine_id"], "inner").withColumn("months", enters)
    by_level = seen.where("level IS NOT NULL").select("machine_id", "level", "months")
    at_all = seen.groupBy("machine_id", "period").agg(F.min("months").alias("months")).select(
        "machine_id", F.lit(ANY_LEVEL).alias("level"), "months")
    counted = by_level.unionByName(at_all).groupBy("machine_id", "level", "months").agg(
        F.count(F.lit(1)).alias("_n"))
    span = seen.groupBy("machine_id").agg(F.max("months").alias("span"))
    grid = span.select("machine_id", "span", F.explode(F.array(
        *[F.lit(x) for x in (*LEVELS, ANY_LEVEL)])).alias("level")).withColumn(
        "months", F.explode(F.sequence(F.lit(0), F.col("span"))))
    w = Window.partitionBy("machine_id", "level").orderBy("months")  # one row per month of data
    return _joined(grid, counted, ["machine_id", "level", "months"]).select(
        "machine_id", "level", "months", "span",
        F.sum(F.coalesce("_n", F.lit(0))).over(w).alias("days"))


def lookback_answers(params: DataFrame, readings) -> DataFrame:
    """AG19 / AG20 for many parameter sets at once: (machine_id, months, level) ->
    days with a reading (at ``level`` when it is not NULL) and ts >= max ts - months.

    ``params`` (distinct) meets :func:`lookback_days` by equi-joins only: a look-back
    beyond the data's span is the span's. Machines without readings give no row."""
    table = lookback_days(readings)
    spans = table.groupBy("machine_id").agg(F.max("span").alias("span"))
    days = table.select("machine_id", F.col("level").alias("_level"),
                        F.col("months").alias("_months"), "days")
    asked = _joined(params.select("machine_id", "months", "level"), spans, ["machine_id"], "inner").withColumns({
        "_level": F.coalesce("level", F.lit(ANY_LEVEL)),
        "_months": F.least("months", "span"),
    })
    return _joined(asked, days, ["machine_id", "_level", "_months"]).select(
        "machine_id", "months", "level", F.coalesce("days", F.lit(0)).alias("days"))


def answer_lookback_questions(questions: DataFrame, readings: DataFrame) -> DataFrame:
    """Questions with (machine_id, months, level) get their day count."""
    params = questions.select("machine_id", "months", "level").distinct()
    keys = ["machine_id", "months", "level"]
    ans = lookback_answers(params, readings).select(
        *[F.col(k).alias(f"_a_{k}") for k in keys], "days")
    cond = [F.col(k).eqNullSafe(F.col(f"_a_{k}")) for k in keys]
    return (questions.join(ans, cond, "left").drop(*[f"_a_{k}" for k in keys])
            .withColumn("days", F.when(F.col("months").isNotNull(),
                                       F.coalesce(F.col("days"), F.lit(0)))))


# ------------------------------------------------------------------ catalogue answers

#: the answer of a yes / no question that finds nothing (fixed value, as in the consistency check)
NO = "hayır"


def _fmt2(c: Column) -> Column:
    """Two places, half up; six places first, so that the order of a sum's terms cannot tell.
    NULL stays NULL."""
    return F.when(c.isNotNull(), F.format_string("%.2f", F.round(c, 6)))


def _listed(when: Column, what: str) -> Column:
    return join_sorted(F.when(when, F.col(what)))


def _rollup_answers(src, year: int, recent_days: int, recent_levels_days: int) -> DataFrame:
    """One row per machine with a column ``e<entry>`` for the entries that follow from rows of
    the daily rollup: a single aggregation."""
    w = Window.partitionBy("machine_id")  # days x levels rows per machine
    roll = (cat._roll(src)
            .withColumn("_top", F.max("n").over(Window.partitionBy("machine_id", "level")))
            .withColumn("_mx", F.max("last_ts").over(w)))
    level, day, n = F.col("level"), F.col("period"), F.col("n")
    begin, end = F.lit(_dt.date(year, 1, 1)), F.lit(_dt.date(year, 12, 31))
    in_year = day.between(begin, end)

    def recent(days: int) -> Column:
        return F.col("last_ts") >= F.col("_mx") - F.expr(f"INTERVAL {int(days)} DAYS")

    def of(cond: Column, col: str) -> Column:
        return F.when(cond, F.col(col))

    def mean(cond: Column) -> Column:
        return F.sum(of(cond, "sum_value")) / F.sum(of(cond, "n_value"))

    always, red = F.lit(True), level == "RED"
    range_text = F.concat_ws(" - ", _fmt2(F.min("min_value")), _fmt2(F.max("max_value")))
    peak_red = _listed(red & (n == F.col("_top")), "period")
    green = F.coalesce(F.sum(of(level == "GREEN", "n")), F.lit(0))
    red_in_year = F.coalesce(F.sum(F.when(red & in_year, F.when(day < end, n).otherwise(
        F.col("n_midnight")))), F.lit(0))

    def summary(cond: Column) -> Column:
        return F.concat_ws(" / ", _fmt2(F.min(of(cond, "min_value"))),
                           _fmt2(F.max(of(cond, "max_value"))), _fmt2(mean(cond)))

    answers = {
        1: _listed((level == "YELLOW") & (n == F.col("_top")), "period"),
        2: peak_red, 29: peak_red, 3: range_text,
        4: red_in_year.cast("string"),
        10: _listed((level == "ORANGE") & in_year, "period"),
        11: summary(in_year), 22: summary(always),
        14: F.concat(_fmt2(green / F.lit(60.0)), F.lit(" h ("), green.cast("string"), F.lit(" min)")),
        28: _listed(recent(recent_levels_days), "level"),
        32: _listed(red, "period"),
    }
    for entry, lv in ((15, "YELLOW"), (16, "ORANGE"), (17, "GREEN"), (18, "RED")):
        answers[entry] = F.count_if((level == lv) & recent(recent_days)).cast("string")
    return roll.groupBy("machine_id").agg(*[a.alias(f"e{i}") for i, a in answers.items()])


def _day_answers(src) -> DataFrame:
    """Entries that compare whole days: missing (12), all red (13), steadiest (20), best (24)."""
    level, n = F.col("level"), F.col("n")

    def share(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0))

    days = cat._roll(src).groupBy("machine_id", "period").agg(
        F.sum("n").alias("n"), share(level == "RED").alias("red"),
        share(level.isin("GREEN", "YELLOW")).alias("calm"),
        (share(F.coalesce(level != "GREEN", F.lit(True))) / F.sum("n")).alias("faults"))
    calendar = F.sequence(F.min("period"), F.max("period"), F.expr("INTERVAL 1 DAY"))
    missing = F.array_except(calendar, F.collect_set("period"))
    calm = F.when(F.col("calm") > 0, F.struct((-F.col("calm")).alias("k"), F.col("period").alias("p")))
    best = F.slice(F.array_sort(F.collect_list(calm)), 1, 3)
    return days.groupBy("machine_id").agg(
        F.array_join(F.transform(missing, lambda d: d.cast("string")), ", ").alias("e12"),
        _listed(F.col("n") == F.col("red"), "period").alias("e13"),
        F.array_join(F.transform(best, lambda x: x["p"].cast("string")), ", ").alias("e20"),
        F.min(F.struct("faults", "period"))["period"].cast("string").alias("e24"))


def _month_answers(src) -> DataFrame:
    """Entries that compare months: greenest (21), most variable (25); and years (26)."""
    per = Window.partitionBy("machine_id", "_month")  # days of a month x levels
    roll = cat._roll(src).withColumn("_month", F.trunc("period", "month"))
    apart = F.col("sum_value") / F.col("n_value") - F.col("_mean")
    months = (roll.withColumn("_mean", F.sum("sum_value").over(per) / F.sum("n_value").over(per))
              .groupBy("machine_id", "_month").agg(
        F.sum(F.when(F.col("level") == "GREEN", F.col("n")).otherwise(0)).alias("green"),
        F.sum("sum_value").alias("total"), F.sum("n_value").alias("n"),
        F.sum(F.col("m2") + F.col("n_value") * apart * apart).alias("m2")))
    green = F.when(F.col("green") > 0, F.struct((-F.col("green")).alias("k"),
                                                F.col("_month").alias("p")))
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    spread = F.when(std.isNotNull(), F.struct((-std).alias("k"), F.col("_month").alias("p")))
    of_months = months.groupBy("machine_id").agg(
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(green)), 1, 3),
                                 lambda x: F.date_format(x["p"], "yyyy-MM")), ", ").alias("e21"),
        F.date_format(F.min(spread)["p"], "yyyy-MM").alias("e25"))
    years = months.groupBy("machine_id", F.year("_month").alias("y")).agg(
        F.concat(F.date_format(F.min("_month"), "yyyy"), F.lit(": "),
                 _fmt2(F.sum("total") / F.sum("n"))).alias("t"))
    of_years = years.groupBy("machine_id").agg(F.array_join(F.transform(F.array_sort(
        F.collect_list(F.struct("y", "t"))), lambda x: x["t"]), ", ").alias("e26"))
    return _joined(of_months, of_years, ["machine_id"])


def _change_answers(changes: DataFrame) -> DataFrame:
    """Entries about level changes (19, 23, 27), from one count of changes per day."""
    dense = F.when(F.col("changes") > 0, F.struct((-F.col("changes")).alias("k"),
                                                  F.col("date").alias("p")))
    return changes.groupBy("machine_id").agg(
        _listed(F.col("steps") > 0, "date").alias("e19"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(dense)), 1, 3),
                                 lambda x: x["p"].cast("string")), ", ").alias("e23"),
        F.sum("steps").cast("string").alias("e27"))


def catalogue_answers(readings, year: int | None = None, gap_seconds: float = 60,
                      recent_days: int = 90, recent_levels_days: int = 30) -> DataFrame:
    """(machine_id, intent_id, answer) for every catalogue entry that takes no date;
    ``readings`` may be ``Prepared``.

    Values only (dates, numbers, levels) joined as text; numbers with two places. ``year`` is
    the calendar year of the entries that name one; by default the last year with readings.
    Computed once per readings snapshot: the rollup-based entries take three aggregations of
    the stored daily rollup (a NULL machine has its own), and the readings are read for the rollup and for one sorted
    pass that gives the level changes and the red runs. Every (machine, entry) has an answer; an empty list is
    an empty text. The result has machines x 30 rows."""
    src = readings if isinstance(readings, cat.Prepared) else cat.prepare(readings)
    if year is None:  # of an empty table any year has the same (no) answers
        year = src.day_roll.agg(F.year(F.max("period"))).first()[0] or 1970
    ordered = seq.sweep(src.readings, "RED", gap_seconds, "GREEN", "RED")
    runs = seq.longest_of(seq.runs_of(ordered, gap_seconds)).select("machine_id", F.concat_ws(
        " - ", F.date_format("start_ts", "yyyy-MM-dd HH:mm"),
        F.date_format("end_ts", "yyyy-MM-dd HH:mm")).alias("e0"))
    wide = _rollup_answers(src, year, recent_days, recent_levels_days)
    for part in (_day_answers(src), _month_answers(src), _change_answers(seq.days_of(ordered)), runs):
        wide = _joined(wide, part, ["machine_id"])
    for e in entries():
        if e.fn is not None and not e.params:  # registered; of several answers of a machine the least
            part = e.fn(src.readings).groupBy("machine_id").agg(F.min("answer").alias(f"e{e.intent_id}"))
            wide = _joined(wide, part, ["machine_id"])
    band_text = "; ".join(f"{lv}: {'' if lo is None else lo}-{'' if up is None else up}"
                          for lv, lo, up in bands())
    red_from = [lo for lv, lo, _ in bands() if lv == "RED"][0]
    fixed = {5: band_text, 6: str(red_from), **dict(STATIC_ANSWERS)}
    by_entry = {int(c[1:]): F.col(c) for c in wide.columns if c != "machine_id"}
    by_entry |= {i: F.lit(text) for i, text in fixed.items()}
    return wide.select("machine_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("intent_id"), F.coalesce(c, F.lit("")).alias("answer"))
        for i, c in sorted(by_entry.items())])).alias("_a")).select("machine_id", "_a.*")


# ------------------------------------------------------------------ whole question tables (B1, B2)

def _key(*parts) -> Column:
    return F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def month_answers(readings) -> DataFrame:
    """AG21-AG23 as (machine_id, key, answer): per level the number and the list of months that
    show it (0 and an empty text if none does), per month of the year its red dates of
    any year, or ``NO``."""
    roll = cat._roll(readings)
    level, grid = F.col("level"), F.explode(F.array(*[F.lit(x) for x in LEVELS]))
    label = F.date_format("period", "yyyy-MM")
    machines = roll.select("machine_id").distinct()
    found = roll.where(level.isNotNull()).groupBy("machine_id", "level").agg(
        F.collect_set(label).alias("m"))
    by_level = _joined(machines.select("machine_id", grid.alias("level")), found, [
        "machine_id", "level"]).withColumn("m", F.coalesce("m", F.array()))
    counts = by_level.select("machine_id", _key("months_count", level).alias("key"),
                             F.size("m").cast("string").alias("answer"))
    lists = by_level.select("machine_id", _key("months_list", level).alias("key"),
                            F.array_join(F.sort_array("m"), ", ").alias("answer"))
    red = roll.where(level == "RED").groupBy("machine_id", F.month("period").alias("month_no")).agg(
        join_sorted(F.col("period")).alias("dates"))
    faults = _joined(machines.withColumn("month_no", F.explode(F.sequence(F.lit(1), F.lit(12)))), red, [
        "machine_id", "month_no"]).select(
        "machine_id", _key("month_fault", F.col("month_no")).alias("key"),
        F.coalesce("dates", F.lit(NO)).alias("answer"))
    return counts.unionByName(lists).unionByName(faults)


def day_answers(readings) -> DataFrame:
    """J4 as (machine_id, key, answer): the three dated entries for every day with readings, and the
    registered ones for the dates that they give."""
    low, high = _fmt2(F.col("min_value")), _fmt2(F.col("max_value"))
    texts = {7: F.concat_ws(" - ", low, high), 8: F.coalesce("mode_level", F.lit("")),
             9: F.concat_ws(" / ", low, high, _fmt2(F.col("mean_value")))}
    out = daily_table(readings).select("machine_id", F.explode(F.array(*[
        F.struct(_key("entry", F.lit(i), F.col("date")).alias("key"), t.alias("answer"))
        for i, t in texts.items()])).alias("_a")).select("machine_id", "_a.*")
    for e in entries():
        if e.fn is not None and e.params:
            rows = readings.readings if isinstance(readings, cat.Prepared) else readings
            out = out.unionByName(e.fn(rows).groupBy(
                "machine_id", _key("entry", F.lit(e.intent_id), F.col("date")).alias("key")).agg(
                F.min("answer").alias("answer")))
    return out


def answer_questions(routed: DataFrame, readings, answers: DataFrame | None = None,
                     date_col: str = "date") -> DataFrame:
    """B1 / B2: attach answers to routed questions (``route_questions`` output plus a
    ``machine_id`` column). ``answer`` is filled for matched catalogue entries, dated
    entries and pattern questions; ``status`` says why it is empty otherwise. ``error`` says
    of a question that was understood why it has no answer all the same; no question can
    fail the others.

    The routed table is materialised once (checkpoint) and meets all answers in one left
    join on (machine, key). Questions without a key get keys of their own that match
    nothing, so they spread over the partitions instead of meeting on a NULL."""
    ensure_checkpoint_dir(routed.sparkSession)
    routed = routed.checkpoint(eager=True)
    src = readings if isinstance(readings, cat.Prepared) else cat.prepare(readings)
    answers = answers if answers is not None else catalogue_answers(src)
    status, kind, level = F.col("status"), F.col("kind"), F.col("level")
    dated = (status == "matched") & F.col("needs_date")
    pattern = status == "pattern"
    any_level = F.coalesce(level, F.lit(ANY_LEVEL))
    key = (F.when(dated, _key("entry", F.col("intent_id"), F.col(date_col)))
           .when(status == "matched", _key("entry", F.col("intent_id")))
           .when(pattern & (kind == "recent_months"),
                 _key("recent_months", F.col("months"), any_level))
           .when(pattern & (kind == "month_fault"), _key(kind, F.col("month_no")))
           .when(pattern, _key(kind, level)))
    back = lookback_answers(routed.where(pattern & (kind == "recent_months")).select(
        "machine_id", "months", "level").distinct(), src)
    known = (answers.select("machine_id", _key("entry", F.col("intent_id")).alias("key"), "answer")
             .unionByName(day_answers(src)).unionByName(month_answers(src))
             .unionByName(back.select(
                 "machine_id", _key("recent_months", F.col("months"), any_level).alias("key"),
                 F.col("days").cast("string").alias("answer"))))
    spread = _key("-", F.pmod(F.xxhash64(*[c for c in routed.columns if c != "suggestions"]),
                              F.lit(4096)))
    met = _joined(routed.withColumn("_asked", key).withColumn("key", F.coalesce("_asked", spread)),
                  known.withColumnRenamed("answer", "_answer"), ["machine_id", "key"])
    error = F.when(F.col("_asked").isNotNull() & F.col("_answer").isNull(), F.when(
        dated, F.lit("no reading on that date")).otherwise(F.lit("no readings of that machine")))
    return met.select(*routed.columns, F.col("_answer").alias("answer"), error.alias("error"))
