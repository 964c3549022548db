"""Registered queries over the driver tables, with their DuckDB oracle SQL.

Each query takes (spark, sf_dir) and returns a DataFrame; the SQL in ``ORACLE_SQL``
computes the same rows on the same parquet tables. Column names match on both
sides; averages and standard deviations are rounded to 4 places on both sides.
Readings come from two adapters (see ``tremolo.sources.readings``):
``events`` (machine = event_type, reference thresholds) and ``orders``
(machine = o_orderpriority, value = o_totalprice, thresholds 5e4 / 2.5e5 / 4.5e5).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.operators import catalogue as cat
from tremolo.sources.readings import events_readings, orders_readings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def _r4(c: str):
    return F.round(F.col(c), 4).alias(c)


# ------------------------------------------------------------------ SQL readings adapters

EV = """r AS (SELECT event_id AS reading_id, event_type AS machine_id, ts, value,
  CASE WHEN value IS NULL THEN NULL WHEN value < 2.8 THEN 'GREEN' WHEN value < 11.2 THEN 'YELLOW'
       WHEN value < 14 THEN 'ORANGE' ELSE 'RED' END AS level,
  CAST(ts AS DATE) AS date FROM events)"""

ORD = """r AS (SELECT o_orderkey AS reading_id, o_orderpriority AS machine_id, o_orderdate AS ts,
  o_totalprice AS value,
  CASE WHEN o_totalprice IS NULL THEN NULL WHEN o_totalprice < 50000 THEN 'GREEN'
       WHEN o_totalprice < 250000 THEN 'YELLOW' WHEN o_totalprice < 450000 THEN 'ORANGE'
       ELSE 'RED' END AS level,
  CAST(o_orderdate AS DATE) AS date FROM orders)"""


# ------------------------------------------------------------------ catalogue (AG / T / SRC7)

@register("peak_days_red", f"""WITH {EV}
SELECT machine_id, date, n FROM (
  SELECT machine_id, date, count(*) AS n, max(count(*)) OVER (PARTITION BY machine_id) AS mx
  FROM r WHERE level = 'RED' GROUP BY 1, 2) WHERE n = mx""")
def q_peak_days_red(spark, d):
    return cat.peak_days(events_readings(spark, d, "RED"), "RED")


@register("peak_days_yellow", f"""WITH {EV}
SELECT machine_id, date, n FROM (
  SELECT machine_id, date, count(*) AS n, max(count(*)) OVER (PARTITION BY machine_id) AS mx
  FROM r WHERE level = 'YELLOW' GROUP BY 1, 2) WHERE n = mx""")
def q_peak_days_yellow(spark, d):
    return cat.peak_days(events_readings(spark, d, "YELLOW"), "YELLOW")


@register("value_range", f"""WITH {EV}
SELECT machine_id, min(value) AS min_value, max(value) AS max_value FROM r GROUP BY 1""")
def q_value_range(spark, d):
    return cat.value_range(events_readings(spark, d))


@register("value_summary", f"""WITH {EV}
SELECT machine_id, min(value) AS min_value, max(value) AS max_value,
       round(avg(value), 4) AS mean_value FROM r GROUP BY 1""")
def q_value_summary(spark, d):
    return cat.value_summary(events_readings(spark, d)).select(
        "machine_id", "min_value", "max_value", _r4("mean_value"))


@register("day_summary", f"""WITH {EV}
SELECT machine_id, date, min(value) AS min_value, max(value) AS max_value,
       round(avg(value), 4) AS mean_value, count(*) AS n FROM r GROUP BY 1, 2""")
def q_day_summary(spark, d):
    return cat.day_summary(events_readings(spark, d)).select(
        "machine_id", "date", "min_value", "max_value", _r4("mean_value"), "n")


@register("day_range", f"""WITH {EV}
SELECT machine_id, date, min(value) AS min_value, max(value) AS max_value
FROM r WHERE date = DATE '2024-01-15' GROUP BY 1, 2""")
def q_day_range(spark, d):
    return cat.day_range(events_readings(spark, d), "2024-01-15")


@register("day_mode_level", f"""WITH {EV}
SELECT machine_id, date, level AS mode_level, n FROM (
  SELECT machine_id, date, level, count(*) AS n,
         row_number() OVER (PARTITION BY machine_id, date ORDER BY count(*) DESC, level) AS rn
  FROM r WHERE level IS NOT NULL GROUP BY 1, 2, 3) WHERE rn = 1""")
def q_day_mode_level(spark, d):
    return cat.day_mode_level(events_readings(spark, d))


@register("year_summary", f"""WITH {ORD}
SELECT machine_id, min(value) AS min_value, max(value) AS max_value,
       round(avg(value), 4) AS mean_value, count(*) AS n
FROM r WHERE ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1999-01-01' GROUP BY 1""")
def q_year_summary(spark, d):
    return cat.year_summary(orders_readings(spark, d), 1998).select(
        "machine_id", "min_value", "max_value", _r4("mean_value"), "n")


@register("yearly_mean", f"""WITH {ORD}
SELECT machine_id, CAST(year(ts) AS BIGINT) AS year, round(avg(value), 4) AS mean_value
FROM r GROUP BY 1, 2""")
def q_yearly_mean(spark, d):
    return cat.yearly_mean(orders_readings(spark, d)).select("machine_id", "year", _r4("mean_value"))


@register("red_count_period", f"""WITH {EV}
SELECT machine_id, count(*) FILTER (WHERE level = 'RED' AND ts BETWEEN TIMESTAMP '2024-01-01'
       AND TIMESTAMP '2024-01-15') AS n FROM r GROUP BY 1""")
def q_red_count_period(spark, d):
    return cat.level_count_between(events_readings(spark, d), "2024-01-01", "2024-01-15", "RED")


@register("level_duration", f"""WITH {EV}
SELECT machine_id, count(*) FILTER (WHERE level = 'GREEN') AS minutes,
       round(count(*) FILTER (WHERE level = 'GREEN') / 60.0, 4) AS hours FROM r GROUP BY 1""")
def q_level_duration(spark, d):
    return cat.level_duration(events_readings(spark, d), "GREEN").select(
        "machine_id", "minutes", _r4("hours"))


@register("orange_dates", f"""WITH {EV}
SELECT DISTINCT machine_id, date FROM r
WHERE level = 'ORANGE' AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def q_orange_dates(spark, d):
    return cat.level_dates(events_readings(spark, d), "ORANGE", "2024-01-05", "2024-01-20")


@register("all_red_dates", f"""WITH {EV}
SELECT DISTINCT machine_id, date FROM r WHERE level = 'RED'""")
def q_all_red_dates(spark, d):
    return cat.level_dates(events_readings(spark, d), "RED")


@register("missing_periods", f"""WITH {EV},
p AS (SELECT DISTINCT machine_id, date_trunc('hour', ts) AS period FROM r),
b AS (SELECT machine_id, min(period) AS lo, max(period) AS hi FROM p GROUP BY 1),
c AS (SELECT machine_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS period FROM b)
SELECT machine_id, period FROM c ANTI JOIN p USING (machine_id, period)""")
def q_missing_periods(spark, d):
    return cat.missing_periods(events_readings(spark, d), "hour")


@register("all_red_periods", f"""WITH {EV}
SELECT machine_id, date_trunc('hour', ts) AS period, count(*) AS n FROM r GROUP BY 1, 2
HAVING count(*) FILTER (WHERE level = 'RED') = count(*)""")
def q_all_red_periods(spark, d):
    return cat.all_level_periods(events_readings(spark, d), "hour", "RED")


_LEVELS_SQL = "(VALUES ('GREEN'), ('YELLOW'), ('ORANGE'), ('RED')) AS lv(level)"


@register("recent_level_days", f"""WITH {EV},
m AS (SELECT machine_id, max(ts) - INTERVAL 7 DAY AS cutoff FROM r GROUP BY 1),
c AS (SELECT r.machine_id, r.level, count(DISTINCT r.date) AS days
      FROM r JOIN m USING (machine_id) WHERE r.ts >= m.cutoff GROUP BY 1, 2)
SELECT m.machine_id, lv.level, coalesce(c.days, 0) AS days
FROM m CROSS JOIN {_LEVELS_SQL}
LEFT JOIN c ON c.machine_id = m.machine_id AND c.level = lv.level""")
def q_recent_level_days(spark, d):
    return cat.recent_level_days(events_readings(spark, d), 7)


@register("recent_levels", f"""WITH {EV},
m AS (SELECT machine_id, max(ts) - INTERVAL 2 DAY AS cutoff FROM r GROUP BY 1)
SELECT DISTINCT r.machine_id, r.level FROM r JOIN m USING (machine_id)
WHERE r.ts >= m.cutoff AND r.level IS NOT NULL""")
def q_recent_levels(spark, d):
    return cat.recent_levels(events_readings(spark, d), 2)


@register("least_fault_day", f"""WITH {EV},
dd AS (SELECT machine_id, date,
              sum(CASE WHEN level = 'GREEN' THEN 0 ELSE 1 END) / count(*) AS fault_share
       FROM r GROUP BY 1, 2)
SELECT machine_id, date, round(fault_share, 6) AS fault_share FROM (
  SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY fault_share, date) AS rn FROM dd)
WHERE rn = 1""")
def q_least_fault_day(spark, d):
    return cat.least_fault_day(events_readings(spark, d)).select(
        "machine_id", "date", F.round("fault_share", 6).alias("fault_share"))


@register("most_variable_month", f"""WITH {ORD},
mo AS (SELECT machine_id, CAST(date_trunc('month', ts) AS DATE) AS month,
              stddev_samp(value) AS s FROM r GROUP BY 1, 2)
SELECT machine_id, month, round(s, 4) AS std_value FROM (
  SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY s DESC, month) AS rn
  FROM mo WHERE s IS NOT NULL AND NOT isnan(s)) WHERE rn = 1""")
def q_most_variable_month(spark, d):
    return cat.most_variable_month(orders_readings(spark, d)).select(
        "machine_id", "month", _r4("std_value"))


@register("recent_months_days", f"""WITH {ORD},
m AS (SELECT machine_id, max(ts) - INTERVAL 3 MONTH AS cutoff FROM r GROUP BY 1),
c AS (SELECT r.machine_id, count(DISTINCT r.date) AS days FROM r JOIN m USING (machine_id)
      WHERE r.ts >= m.cutoff GROUP BY 1)
SELECT m.machine_id, coalesce(c.days, 0) AS days FROM m LEFT JOIN c USING (machine_id)""")
def q_recent_months_days(spark, d):
    return cat.recent_months_days(orders_readings(spark, d), 3)


@register("recent_months_level_days", f"""WITH {ORD},
m AS (SELECT machine_id, max(ts) - INTERVAL 6 MONTH AS cutoff FROM r GROUP BY 1),
c AS (SELECT r.machine_id, count(DISTINCT r.date) AS days FROM r JOIN m USING (machine_id)
      WHERE r.ts >= m.cutoff AND r.level = 'GREEN' GROUP BY 1)
SELECT m.machine_id, coalesce(c.days, 0) AS days FROM m LEFT JOIN c USING (machine_id)""")
def q_recent_months_level_days(spark, d):
    return cat.recent_months_days(orders_readings(spark, d), 6, "GREEN")


@register("month_fault_dates", f"""WITH {ORD}
SELECT DISTINCT machine_id, date FROM r WHERE level = 'RED' AND month(ts) = 2""")
def q_month_fault_dates(spark, d):
    return cat.month_level_dates(orders_readings(spark, d), 2, "RED")


@register("months_with_level", f"""WITH {ORD}
SELECT DISTINCT machine_id, strftime(ts, '%Y-%m') AS month FROM r WHERE level = 'ORANGE'""")
def q_months_with_level(spark, d):
    return cat.months_with_level(orders_readings(spark, d), "ORANGE")


@register("months_with_level_count", f"""WITH {ORD}
SELECT machine_id, count(DISTINCT strftime(ts, '%Y-%m')) FILTER (WHERE level = 'RED') AS months
FROM r GROUP BY 1""")
def q_months_with_level_count(spark, d):
    return cat.months_with_level_count(orders_readings(spark, d), "RED")


@register("top_stable_days", f"""WITH {EV}
SELECT machine_id, date, n, rank FROM (
  SELECT machine_id, date, count(*) AS n,
         row_number() OVER (PARTITION BY machine_id ORDER BY count(*) DESC, date) AS rank
  FROM r WHERE level IN ('GREEN', 'YELLOW') GROUP BY 1, 2) WHERE rank <= 3""")
def q_top_stable_days(spark, d):
    return cat.top_days(events_readings(spark, d), ("GREEN", "YELLOW"), 3).withColumn(
        "rank", F.col("rank").cast("long"))


@register("top_green_months", f"""WITH {ORD}
SELECT machine_id, month, n, rank FROM (
  SELECT machine_id, strftime(ts, '%Y-%m') AS month, count(*) AS n,
         row_number() OVER (PARTITION BY machine_id ORDER BY count(*) DESC,
                            strftime(ts, '%Y-%m')) AS rank
  FROM r WHERE level = 'GREEN' GROUP BY 1, 2) WHERE rank <= 3""")
def q_top_green_months(spark, d):
    return cat.top_months(orders_readings(spark, d), "GREEN", 3).withColumn(
        "rank", F.col("rank").cast("long"))


# ------------------------------------------------------------------ sequences

from tremolo.operators import sequence as seq  # noqa: E402

_RUNS_SQL = f"""WITH {EV},
lv AS (SELECT machine_id, ts, reading_id FROM r WHERE level = 'RED'),
p AS (SELECT *, lag(ts) OVER (PARTITION BY machine_id ORDER BY ts, reading_id) AS prev_ts FROM lv),
f AS (SELECT *, CASE WHEN prev_ts IS NULL OR epoch_us(ts) - epoch_us(prev_ts) > 600000000
                     THEN 1 ELSE 0 END AS s FROM p),
g AS (SELECT *, sum(s) OVER (PARTITION BY machine_id ORDER BY ts, reading_id
                             ROWS UNBOUNDED PRECEDING) AS run_no FROM f),
runs AS (SELECT machine_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n,
                (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s
         FROM g GROUP BY machine_id, run_no)"""


@register("red_runs", _RUNS_SQL + "\nSELECT * FROM runs")
def q_red_runs(spark, d):
    return seq.level_runs(events_readings(spark, d, "RED"), "RED", gap_seconds=600)


@register("longest_red_run", _RUNS_SQL + """
SELECT machine_id, start_ts, end_ts, n, duration_s FROM (
  SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY duration_s DESC, start_ts) AS rk
  FROM runs) WHERE rk = 1""")
def q_longest_red_run(spark, d):
    return seq.longest_run(events_readings(spark, d, "RED"), "RED", gap_seconds=600)


_PREV_SQL = f"""WITH {EV},
p AS (SELECT *, lag(level) OVER (PARTITION BY machine_id ORDER BY ts, reading_id) AS prev_level,
             row_number() OVER (PARTITION BY machine_id ORDER BY ts, reading_id) AS pos FROM r)"""


@register("green_to_red_dates", _PREV_SQL + """
SELECT DISTINCT machine_id, date FROM p WHERE prev_level = 'GREEN' AND level = 'RED'""")
def q_green_to_red_dates(spark, d):
    return seq.transition_dates(events_readings(spark, d), "GREEN", "RED")


@register("green_to_red_count", _PREV_SQL + """
SELECT machine_id, count(*) FILTER (WHERE prev_level = 'GREEN' AND level = 'RED') AS transitions
FROM p GROUP BY 1""")
def q_green_to_red_count(spark, d):
    return seq.transition_count(events_readings(spark, d), "GREEN", "RED")


@register("change_density_top", _PREV_SQL + """,
c AS (SELECT machine_id, date, count(*) AS changes FROM p
      WHERE pos = 1 OR level IS DISTINCT FROM prev_level GROUP BY 1, 2)
SELECT machine_id, date, changes, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY changes DESC, date) AS rank FROM c)
WHERE rank <= 3""")
def q_change_density_top(spark, d):
    return seq.change_density_top(events_readings(spark, d), 3)


@register("level_profile", f"""WITH {EV},
b AS (SELECT * FROM (VALUES ('GREEN', CAST(NULL AS DOUBLE), 2.8::DOUBLE, 0),
                            ('YELLOW', 2.8::DOUBLE, 11.2::DOUBLE, 1),
                            ('ORANGE', 11.2::DOUBLE, 14.0::DOUBLE, 2),
                            ('RED', 14.0::DOUBLE, CAST(NULL AS DOUBLE), 3))
      AS t(level, lower, upper, level_order)),
s AS (SELECT level, count(*) AS n, min(value) AS min_value, max(value) AS max_value
      FROM r GROUP BY 1)
SELECT b.level, b.lower, b.upper, CAST(b.level_order AS INTEGER) AS level_order,
       coalesce(s.n, 0) AS n, s.min_value, s.max_value
FROM b LEFT JOIN s USING (level)""")
def q_level_profile(spark, d):
    return cat.level_profile(events_readings(spark, d))


# ------------------------------------------------------------------ consistency (W5, AG26)

from tremolo.operators import consistency as cons  # noqa: E402


def _orders_answers(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", "o_custkey", F.col("o_orderstatus").alias("answer"))
    return cons.dense_row_number(o, "o_orderkey", "row_no")


_BLOCK_SQL = """WITH q AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no, o_orderkey,
                  o_orderstatus AS answer FROM orders),
b AS (SELECT *, row_no // 5 AS grp FROM q),
l AS (SELECT grp, answer AS leader_answer FROM b WHERE row_no % 5 = 0),
c AS (SELECT row_no, grp, o_orderkey, answer, leader_answer,
             CASE WHEN row_no % 5 = 0 THEN NULL WHEN answer = leader_answer THEN 'evet'
                  ELSE 'hayır' END AS verdict FROM b JOIN l USING (grp))"""


@register("answer_consistency", _BLOCK_SQL + "\nSELECT * FROM c")
def q_answer_consistency(spark, d):
    c = cons.answer_consistency(_orders_answers(spark, d), "answer", "row_no", by="block")
    return c.select("row_no", "grp", "o_orderkey", "answer", "leader_answer", "verdict")


@register("answer_agreement", _BLOCK_SQL + "\nSELECT verdict, count(*) AS n FROM c GROUP BY 1")
def q_answer_agreement(spark, d):
    c = cons.answer_consistency(_orders_answers(spark, d), "answer", "row_no", by="block")
    return cons.answer_agreement(c)


@register("answer_consistency_by_question", """WITH
q AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no, o_orderkey, o_custkey AS grp,
             o_orderstatus AS answer FROM orders),
l AS (SELECT grp, arg_min(answer, row_no) AS leader_answer, min(row_no) AS lr FROM q GROUP BY 1)
SELECT row_no, grp, o_orderkey, answer, leader_answer,
       CASE WHEN row_no = lr THEN NULL WHEN answer = leader_answer THEN 'evet' ELSE 'hayır' END
         AS verdict
FROM q JOIN l USING (grp)""")
def q_answer_consistency_by_question(spark, d):
    c = cons.answer_consistency(_orders_answers(spark, d), "answer", "row_no", by="question",
                                group_col="o_custkey")
    return c.select("row_no", "grp", "o_orderkey", "answer", "leader_answer", "verdict")


# ------------------------------------------------------------------ chats

from tremolo.operators import chats as ch  # noqa: E402


def _turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")


def _with_system(turns):
    return turns.where(F.col("role") == "system").select("conv_id").distinct()


_PAIRS_SQL = """WITH p AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
                  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations),
pr AS (SELECT conv_id, turn, text AS message, CASE WHEN nr = 'assistant' THEN nt END AS reply
       FROM p WHERE role = 'user')"""


@register("chat_pairs", _PAIRS_SQL + "\nSELECT * FROM pr")
def q_chat_pairs(spark, d):
    return ch.pairs(_turns(spark, d))


@register("chat_undo", _PAIRS_SQL + """
SELECT conv_id, turn, message, reply FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rk FROM pr) WHERE rk > 1""")
def q_chat_undo(spark, d):
    return ch.undo_last_pair(_turns(spark, d))


@register("chat_list", """SELECT DISTINCT conv_id FROM conversations""")
def q_chat_list(spark, d):
    return ch.list_sessions(ch.sessions_of(_turns(spark, d)))


@register("chat_read", """SELECT conv_id, turn, role, text FROM conversations""")
def q_chat_read(spark, d):
    """A table of requests, here one for every session."""
    t = _turns(spark, d)
    return ch.read_session(t, ch.sessions_of(t))


@register("chat_clear", """SELECT conv_id, turn, role, text FROM conversations
WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def q_chat_clear(spark, d):
    t = _turns(spark, d)
    return ch.clear_sessions(t, _with_system(t))


@register("chat_delete", """SELECT conv_id, turn, role, text FROM conversations
WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'assistant')""")
def q_chat_delete(spark, d):
    t = _turns(spark, d)
    sessions = ch.sessions_of(t)
    no_reply = sessions.join(t.where(F.col("role") == "assistant"), "conv_id", "left_anti")
    _, turns = ch.delete_sessions(sessions, t, no_reply)
    return turns


@register("chat_rename", """WITH
rn AS (SELECT DISTINCT conv_id AS old_id, conv_id + 1 AS new_id FROM conversations
       WHERE role = 'system'),
ow AS (SELECT new_id AS conv_id FROM rn WHERE new_id NOT IN (SELECT old_id FROM rn)),
kept AS (SELECT * FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM ow))
SELECT coalesce(rn.new_id, kept.conv_id) AS conv_id, turn, role, text
FROM kept LEFT JOIN rn ON kept.conv_id = rn.old_id""")
def q_chat_rename(spark, d):
    t = _turns(spark, d)
    renames = _with_system(t).select(F.col("conv_id").alias("old_id"),
                                     (F.col("conv_id") + 1).alias("new_id"))
    return ch.rename_sessions(t, renames)


@register("chat_append", """WITH
lst AS (SELECT conv_id, max(turn) AS mx FROM conversations GROUP BY 1),
lu AS (SELECT conv_id, arg_max(text, turn) AS message FROM conversations WHERE role = 'user'
       GROUP BY 1),
nw AS (SELECT lu.conv_id, mx + 1 AS turn, 'user' AS role, message AS text
       FROM lu JOIN lst USING (conv_id)
       UNION ALL
       SELECT lu.conv_id, mx + 2, 'assistant', 'Soru alındı: ' || message
       FROM lu JOIN lst USING (conv_id))
SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM nw""")
def q_chat_append(spark, d):
    t = _turns(spark, d)
    req = (t.where(F.col("role") == "user").groupBy("conv_id")
           .agg(F.max_by("text", "turn").alias("message"))
           .select("conv_id", F.lit(0).alias("req_no"), "message",
                   F.concat(F.lit("Soru alındı: "), "message").alias("reply")))
    return ch.append_messages(t, req)


@register("chat_new", """SELECT coalesce(max(conv_id), 0) + 1 AS conv_id FROM conversations""")
def q_chat_new(spark, d):
    return ch.new_session_id(ch.sessions_of(_turns(spark, d)))


@register("chat_nest", """SELECT CAST(conv_id AS VARCHAR) AS conv_id, count(*) AS n_messages,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages FROM conversations GROUP BY 1""")
def q_chat_nest(spark, d):
    """SNK2: a whole session per row in the nested shape, shown as one text."""
    n = ch.nest_sessions(_turns(spark, d), "text")
    return n.select(F.col("conv_id").cast("string").alias("conv_id"),
                    F.size("messages").cast("long").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: F.concat(
                        m["role"], F.lit(": "), m["content"])), "\n").alias("messages"))


@register("chat_flatten", """SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, role, text
FROM conversations""")
def q_chat_flatten(spark, d):
    """SRC5 / SNK2: every session to its JSON, a text per turn, and back to turns."""
    lines = ch.turn_lines(_turns(spark, d), "text")
    return ch.flatten_sessions(lines).withColumnRenamed("content", "text")


@register("chat_parse", """SELECT conv_id, turn,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(conv_id * 100 + turn AS INTEGER)) AS said_at,
  CASE WHEN role = 'user' THEN '🧑' ELSE '🤖' END AS icon, text FROM conversations""")
def q_chat_parse(spark, d):
    """Every turn to its stored content (time, icon, text) and back."""
    at = F.timestamp_add("MINUTE", (F.col("conv_id") * 100 + F.col("turn")).cast("int"),
                         F.lit("2024-01-01").cast("timestamp_ntz"))
    stored = _turns(spark, d).select("conv_id", "turn", ch.build_content(
        at, F.col("role"), F.col("text")).alias("content"))
    return ch.parse_content(stored).select("conv_id", "turn", "said_at", "icon", "text")


#: a change log over all conversations: (phase, which ones, action, new name); names beyond ``m`` are free
_LOG_PHASES = [(1, "true", "append", None), (2, "c % 5 = 0", "clear", None),
               (3, "c % 3 = 0", "append", None), (4, "c % 4 = 0", "rename", "c + m"),
               (5, "c % 7 = 0", "delete", None), (6, "c % 8 = 0", "rename", "c + 2 * m"),
               (7, "c % 10 = 1", "rename", "c - 1"), (8, "true", "append", None)]


def _change_log(spark, d):
    """Eight requests per conversation at most: seq is phase * 2^40 + conv_id. In phase 6 the renamed ones of
    phase 4 move on."""
    t = _turns(spark, d)
    m = t.agg((F.coalesce(F.max("conv_id"), F.lit(0)) + 1).alias("m"))
    said = F.when(F.col("role") == "user", F.col("turn"))
    base = t.groupBy(F.col("conv_id").alias("c")).agg(F.min_by("text", said).alias("said")).crossJoin(
        F.broadcast(m))  # one row
    steps = F.array(*[F.when(F.expr(which), F.struct(
        (F.lit(phase) * F.lit(1 << 40) + F.col("c")).alias("seq"),
        F.expr("c + m" if phase == 6 else "c").alias("conv_id"), F.lit(action).alias("action"),
        F.expr(new or "CAST(NULL AS BIGINT)").alias("new_id"))) for phase, which, action, new in _LOG_PHASES])
    return base.select("said", F.explode(F.filter(steps, lambda x: x.isNotNull())).alias("x")).select(
        "x.*", F.when(F.col("x.action") == "append", F.col("said")).alias("text"),
        F.when(F.col("x.action") == "append", F.lit("ok")).alias("reply"))


@register("chat_change_log", """WITH
t AS (SELECT conv_id AS c, turn, role, text FROM conversations),
m AS (SELECT coalesce(max(c), 0) + 1 AS m FROM t),
b AS (SELECT c, min_by(text, CASE WHEN role = 'user' THEN turn END) AS said, max(turn) + 1 AS base,
             m FROM t, m GROUP BY c, m),
o AS (SELECT *, c % 5 = 0 AS cleared, c % 4 <> 0 AND c % 7 = 0 AS dead,
             CASE WHEN c % 8 = 0 THEN c + 2 * m WHEN c % 4 = 0 THEN c + m
                  WHEN c % 10 = 1 AND c % 7 <> 0 THEN c - 1 ELSE c END AS name FROM b),
lost AS (SELECT name AS c FROM o WHERE name = c - 1),
alive AS (SELECT * FROM o WHERE NOT dead AND (name <> c OR c NOT IN (SELECT c FROM lost))),
said AS (
  SELECT name, c, phase, said FROM alive, (VALUES (1), (3)) p(phase)
  WHERE (phase = 3 AND c % 3 = 0) OR (phase = 1 AND NOT cleared)
  UNION ALL SELECT c, NULL, 8, said FROM b),
start AS (SELECT name, base FROM alive WHERE NOT cleared),
new AS (SELECT name AS conv_id, coalesce(base, 0) + 2 * (row_number() OVER (
          PARTITION BY name ORDER BY phase) - 1) AS turn, said FROM said LEFT JOIN start USING (name))
SELECT name AS conv_id, turn, role, text FROM alive JOIN t USING (c) WHERE NOT cleared
UNION ALL SELECT conv_id, turn, 'user', said FROM new
UNION ALL SELECT conv_id, turn + 1, 'assistant', 'ok' FROM new""")
def q_chat_change_log(spark, d):
    """Appends, clears, deletes and chained, failing and overwriting renames in one log."""
    from tremolo.operators import chat_log
    t = _turns(spark, d)
    return chat_log.apply_log(t, ch.sessions_of(t), _change_log(spark, d))[1]


# ------------------------------------------------------------------ incidents (AG24, AG25)

from tremolo.operators import incidents as inc  # noqa: E402
from tremolo.sources.static import EXPLANATIONS, explanations_df  # noqa: E402

_EXPL_SQL = ", ".join("('{}', '{}')".format(a, b) for a, b in EXPLANATIONS)
_INC_SQL = f"""WITH {EV},
inc AS (SELECT date, machine_id AS root_cause, count(*) AS incidents FROM r
        WHERE level = 'RED' GROUP BY 1, 2)"""


@register("root_cause_share", _INC_SQL + f""",
per AS (SELECT root_cause, count(*) AS n_rows, CAST(sum(incidents) AS BIGINT) AS n_incidents
        FROM inc GROUP BY 1)
SELECT per.root_cause, n_rows, n_incidents,
       round(n_rows / sum(n_rows) OVER (), 6) AS row_share,
       round(n_incidents / sum(n_incidents) OVER (), 6) AS incident_share, e.explanation
FROM per LEFT JOIN (VALUES {_EXPL_SQL}) AS e(root_cause, explanation) USING (root_cause)""")
def q_root_cause_share(spark, d):
    incidents = inc.incidents_from_readings(events_readings(spark, d))
    out = inc.root_cause_share(incidents, explanations_df(spark))
    return out.select("root_cause", F.col("rows").alias("n_rows"),
                      F.col("incidents").alias("n_incidents"),
                      F.round("row_share", 6).alias("row_share"),
                      F.round("incident_share", 6).alias("incident_share"), "explanation")


# Cause of a machine's red readings, so that each cause and its explanation occurs.
_CAUSES = (("error", "Bearing fault"), ("purchase", "Balance fault"))
_OTHER_CAUSE = "Process based alert"
_CAUSE_SQL = "CASE machine_id " + " ".join(
    f"WHEN '{m}' THEN '{c}'" for m, c in _CAUSES) + f" ELSE '{_OTHER_CAUSE}' END"


@register("explained_causes", f"""WITH {EV},
inc AS (SELECT date, {_CAUSE_SQL} AS root_cause, count(*) AS incidents FROM r
        WHERE level = 'RED' GROUP BY 1, 2)
SELECT root_cause, count(*) AS n_rows, CAST(sum(incidents) AS BIGINT) AS n_incidents,
       any_value(e.explanation) AS explanation
FROM inc LEFT JOIN (VALUES {_EXPL_SQL}) AS e(root_cause, explanation) USING (root_cause)
GROUP BY 1""")
def q_explained_causes(spark, d):
    """AG24 / SRC7e: causes with their explanations, incidents derived from the readings."""
    r = events_readings(spark, d).withColumn("cause", F.expr(_CAUSE_SQL))
    out = inc.root_cause_share(inc.incidents_from_readings(r, cause_col="cause"),
                               explanations_df(spark))
    return out.select("root_cause", F.col("rows").alias("n_rows"),
                      F.col("incidents").alias("n_incidents"), "explanation")


@register("daily_incidents", _INC_SQL + """
SELECT date, CAST(sum(incidents) AS BIGINT) AS incidents FROM inc GROUP BY 1""")
def q_daily_incidents(spark, d):
    return inc.daily_incidents(inc.incidents_from_readings(events_readings(spark, d)))


# ------------------------------------------------------------------ routing

from tremolo.plans import embedder  # noqa: E402
from tremolo.plans import routing as rt  # noqa: E402
from tremolo.plans.routing_sql import route_sql  # noqa: E402


@register("route_questions", route_sql(
    "SELECT conv_id, turn, text AS _text FROM conversations WHERE role = 'user'",
    ["conv_id", "turn"]))
def q_route_questions(spark, d):
    q = _turns(spark, d).where(F.col("role") == "user").select("conv_id", "turn", "text")
    r = rt.route_questions(q, ["conv_id", "turn"], "text")
    return r.withColumn("score", F.round("score", 6)).withColumn(
        "suggestions", F.array_join("suggestions", " | "))


from tremolo.plans.question_table import order_questions, order_questions_sql  # noqa: E402
from tremolo.plans.routing_sql import gate_sql, rewrite_sql  # noqa: E402

_ORDER_TEXTS = f"SELECT o_orderkey, question AS _text FROM ({order_questions_sql()})"


def _order_questions(spark, d):
    return order_questions(spark.read.parquet(f"{d}/orders.parquet"))


def _routed_shown(r):
    return r.withColumn("score", F.round("score", 6)).withColumn(
        "suggestions", F.array_join("suggestions", " | "))


@register("route_order_questions", route_sql(_ORDER_TEXTS, ["o_orderkey"]))
def q_route_order_questions(spark, d):
    """B3 / B4 over one question per order: every status, pattern kind and date form."""
    return _routed_shown(rt.route_questions(_order_questions(spark, d), ["o_orderkey"], "question"))


@register("route_order_questions_gated", route_sql(_ORDER_TEXTS, ["o_orderkey"], threshold=0.40,
                                                   gate=True))
def q_route_order_questions_gated(spark, d):
    """B5 over one question per order: the gate, the term rewrite and the threshold 0.40."""
    return _routed_shown(rt.route_questions(_order_questions(spark, d), ["o_orderkey"], "question",
                                            threshold=0.40, gate=True))


_EMBEDDER = (embedder.hashed_trigrams(256), "hashed-trigrams-256")


@register("route_orders_by_vector", route_sql(_ORDER_TEXTS, ["o_orderkey"], dims=256))
def q_route_orders_by_vector(spark, d):
    """B3 with vectors from an embedder (here the deterministic one) as router input."""
    return _routed_shown(rt.route_questions(
        _order_questions(spark, d), ["o_orderkey"], "question",
        vector=lambda texts, text, out: embedder.embed_questions(texts, text, *_EMBEDDER, out),
        catalogue_vectors=embedder.catalogue_vectors(spark, *_EMBEDDER)))


@register("order_question_terms", f"""SELECT o_orderkey, {rewrite_sql('question')} AS text,
  {gate_sql('question')} AS in_domain FROM ({order_questions_sql()})""")
def q_order_question_terms(spark, d):
    """X8 / X9 over one question per order."""
    from tremolo.functions import text as tx
    return _order_questions(spark, d).select(
        "o_orderkey", tx.normalize_terms(F.col("question")).alias("text"),
        tx.in_domain(F.col("question")).alias("in_domain"))


# ------------------------------------------------------------------ answering

from tremolo.functions import text as tx  # noqa: E402
from tremolo.plans import answers as ans  # noqa: E402

# Date spelling per order priority, so that every numeric form is exercised.
_DATE_FORMS = (("1-URGENT", "dd/MM/yyyy", "%d/%m/%Y"), ("2-HIGH", "dd.MM.yyyy", "%d.%m.%Y"),
               ("3-MEDIUM", "yyyy-MM-dd", "%Y-%m-%d"), ("4-NOT SPECIFIED", "dd-MM-yyyy", "%d-%m-%Y"),
               ("5-LOW", "yyyy/MM/dd", "%Y/%m/%d"))
_DAY_PHRASE = " tarihinde makine performansı hakkında bilgi alabilir miyim?"


def _order_day_questions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    txt = None
    for prio, jfmt, _ in _DATE_FORMS:
        e = F.date_format("o_orderdate", jfmt)
        txt = F.when(F.col("o_orderpriority") == prio, e) if txt is None else \
            txt.when(F.col("o_orderpriority") == prio, e)
    return o.select("o_orderkey", F.col("o_orderpriority").alias("machine_id"),
                    F.concat(txt, F.lit(_DAY_PHRASE)).alias("question"))


def _order_day_questions_sql():
    case = " ".join(f"WHEN '{p}' THEN strftime(o_orderdate, '{f}')" for p, _, f in _DATE_FORMS)
    return (f"SELECT o_orderkey, o_orderpriority AS machine_id, "
            f"(CASE o_orderpriority {case} END) || '{_DAY_PHRASE}' AS question FROM orders")


from tremolo.plans.routing_sql import date_sql, fold_sql, intents_sql  # noqa: E402


@register("extract_dates_numeric", f"""WITH q AS ({_order_day_questions_sql()})
SELECT o_orderkey, question, {date_sql(fold_sql('question'))} AS date FROM q""")
def q_extract_dates_numeric(spark, d):
    q = tx.add_question_fields(_order_day_questions(spark, d), "question", intents=False)
    return q.select("o_orderkey", "question", "date")


@register("answer_day_questions", f"""WITH {ORD},
q AS (SELECT o_orderkey, machine_id, {date_sql(fold_sql('question'))} AS date
      FROM ({_order_day_questions_sql()})),
dm AS (SELECT machine_id, date, level AS mode_level FROM (
        SELECT machine_id, date, level, row_number() OVER (PARTITION BY machine_id, date
                                                           ORDER BY count(*) DESC, level) AS rn
        FROM r WHERE level IS NOT NULL GROUP BY 1, 2, 3) WHERE rn = 1),
ds AS (SELECT machine_id, date, min(value) AS min_value, max(value) AS max_value,
              round(avg(value), 4) AS mean_value FROM r GROUP BY 1, 2)
SELECT q.o_orderkey, q.machine_id, q.date, ds.min_value, ds.max_value, ds.mean_value, dm.mode_level
FROM q LEFT JOIN ds USING (machine_id, date) LEFT JOIN dm USING (machine_id, date)""")
def q_answer_day_questions(spark, d):
    q = tx.add_question_fields(_order_day_questions(spark, d), "question", intents=False)
    q = q.select("o_orderkey", "machine_id", "date")
    a = ans.answer_day_questions(q, orders_readings(spark, d))
    return a.select("o_orderkey", "machine_id", "date", "min_value", "max_value",
                    _r4("mean_value"), "mode_level")


# Level word per order status, so that every level and both look-back forms occur.
_STATUS_WORD = (("F", "kırmızı"), ("O", "sarı"), ("P", "yeşil"))
_TR_NUM = ("bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz", "on")


def _order_lookback_questions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    word = None
    for st, w in _STATUS_WORD:
        word = F.when(F.col("o_orderstatus") == st, F.lit(w)) if word is None else \
            word.when(F.col("o_orderstatus") == st, F.lit(w))
    m = F.month("o_orderdate")
    num_words = F.create_map(*[x for i, w in enumerate(_TR_NUM) for x in (F.lit(i + 1), F.lit(w))])
    n_text = F.when(m <= 10, F.element_at(num_words, m)).otherwise(m.cast("string"))
    return o.select("o_orderkey", F.col("o_orderpriority").alias("machine_id"),
                    F.concat(F.lit("Son "), n_text, F.lit(" ayda "), word,
                             F.lit(" alarm seviyesinde kaç gün çalıştı?")).alias("question"))


def _order_lookback_questions_sql():
    word = " ".join(f"WHEN '{s}' THEN '{w}'" for s, w in _STATUS_WORD)
    num = " ".join(f"WHEN {i + 1} THEN '{w}'" for i, w in enumerate(_TR_NUM))
    return (f"SELECT o_orderkey, o_orderpriority AS machine_id, 'Son ' || "
            f"(CASE WHEN month(o_orderdate) <= 10 THEN (CASE month(o_orderdate) {num} END) "
            f"ELSE CAST(month(o_orderdate) AS VARCHAR) END) || ' ayda ' || "
            f"(CASE o_orderstatus {word} END) || ' alarm seviyesinde kaç gün çalıştı?' AS question "
            f"FROM orders")


_IT = intents_sql(fold_sql("question"))


@register("answer_recent_questions", f"""WITH {ORD},
q AS (SELECT o_orderkey, machine_id, {_IT['kind']} AS kind, {_IT['level']} AS level,
             {_IT['months']} AS months FROM ({_order_lookback_questions_sql()})),
m AS (SELECT machine_id, max(ts) AS mx FROM r GROUP BY 1),
pr AS (SELECT DISTINCT machine_id, months, level FROM q),
c AS (SELECT pr.machine_id, pr.months, pr.level, count(DISTINCT r.date) AS days
      FROM pr JOIN m USING (machine_id) JOIN r ON r.machine_id = pr.machine_id
       AND (pr.level IS NULL OR r.level = pr.level) AND r.ts >= m.mx - to_months(pr.months)
      GROUP BY 1, 2, 3)
SELECT q.o_orderkey, q.machine_id, q.kind, q.level, q.months, coalesce(c.days, 0) AS days
FROM q LEFT JOIN c ON c.machine_id = q.machine_id AND c.months = q.months
 AND c.level IS NOT DISTINCT FROM q.level""")
def q_answer_recent_questions(spark, d):
    q = _order_lookback_questions(spark, d)
    p = tx.add_question_fields(q, "question", date=False).select(
        "o_orderkey", "machine_id", "kind", "level", "months")
    return ans.answer_lookback_questions(p, orders_readings(spark, d)).select(
        "o_orderkey", "machine_id", "kind", "level", "months", "days")


from tremolo.plans.answers_sql import answers_sql  # noqa: E402

_USER_TEXTS = "SELECT conv_id, turn, text AS _text FROM conversations WHERE role = 'user'"
_ONE_MACHINE = EV.replace("event_type AS machine_id", "'RTF' AS machine_id")


@register("answer_questions", answers_sql(
    _ONE_MACHINE, route_sql(_USER_TEXTS, ["conv_id", "turn"]), ["conv_id", "turn"],
    "SELECT conv_id, turn, 'RTF' AS machine_id FROM conversations"))
def q_answer_questions(spark, d):
    """B1: route the user turns of the conversations and answer them from the whole
    events table taken as one machine (the reference's setting)."""
    q = _turns(spark, d).where(F.col("role") == "user").select("conv_id", "turn", "text")
    routed = rt.route_questions(q, ["conv_id", "turn"], "text").withColumn(
        "machine_id", F.lit("RTF"))
    readings = events_readings(spark, d).withColumn("machine_id", F.lit("RTF"))
    return _routed_shown(ans.answer_questions(routed, readings))


# ------------------------------------------------------------------ vectors

from tremolo.functions import vectors as fv  # noqa: E402
from tremolo.operators import vector_cells  # noqa: E402
from tremolo.operators.ordered import ranks  # noqa: E402
from tremolo.operators import vectors as vec  # noqa: E402


def _emb(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


_CENTROIDS_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pos AS (SELECT label, i, avg(v[i]) AS m, count(*) AS n
        FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM e) GROUP BY 1, 2),
cr AS (SELECT label, max(n) AS n, list(m ORDER BY i) AS raw FROM pos GROUP BY 1),
c AS (SELECT label, n, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y))))
             AS centroid FROM cr)"""


@register("vector_normalize", """SELECT vec_id, label,
  round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm_in,
  round(sqrt(list_sum(list_transform(n, lambda x: x * x))), 6) AS norm_out,
  round(n[1], 6) AS first_component
FROM (SELECT *, CASE WHEN sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) > 0
        THEN list_transform(CAST(embedding AS DOUBLE[]),
               lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))))
        ELSE CAST(embedding AS DOUBLE[]) END AS n FROM embeddings)""")
def q_vector_normalize(spark, d):
    e = _emb(spark, d).withColumn("n", fv.l2_normalize("embedding"))
    return e.select("vec_id", "label", F.round(fv.l2_norm("embedding"), 6).alias("norm_in"),
                    F.round(fv.l2_norm("n"), 6).alias("norm_out"),
                    F.round(F.element_at("n", 1), 6).alias("first_component"))


_TOPK_SQL = f"""WITH {_CENTROIDS_SQL},
s AS (SELECT e.vec_id, c.label, list_inner_product(e.v, c.centroid) AS score FROM e, c),
t AS (SELECT vec_id, label, score,
             row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS rank FROM s)"""


@register("vector_topk", _TOPK_SQL + """
SELECT vec_id, CAST(rank AS INTEGER) AS rank, label, round(score, 6) AS score FROM t WHERE rank <= 3""")
def q_vector_topk(spark, d):
    e = _emb(spark, d)
    t = vec.catalogue_topk(e.select("vec_id", "embedding"), vec.centroids(e), 3)
    return t.select("vec_id", "rank", "label", F.round("score", 6).alias("score"))


@register("intent_match", _TOPK_SQL + """
SELECT vec_id, label, round(score, 6) AS score FROM t WHERE rank = 1 AND score >= 0.40""")
def q_intent_match(spark, d):
    """T5 at the gated entry point's threshold, which some vectors reach."""
    e = _emb(spark, d)
    t = vec.catalogue_topk(e.select("vec_id", "embedding"), vec.centroids(e), 3)
    return vec.best_match(t, ["vec_id"], "label", 0.40).withColumn("score", F.round("score", 6))


@register("intent_suggestions", _TOPK_SQL + """,
b AS (SELECT vec_id, max(score) AS best FROM t GROUP BY 1)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, label, round(score, 6) AS score
FROM t JOIN b USING (vec_id) WHERE rank <= 3 AND best < 0.65 AND score >= 0.4""")
def q_intent_suggestions(spark, d):
    e = _emb(spark, d)
    t = vec.catalogue_topk(e.select("vec_id", "embedding"), vec.centroids(e), 3)
    return vec.suggestions(t, ["vec_id"], 0.65, 0.40).select(
        "vec_id", "rank", "label", F.round("score", 6).alias("score"))


_KNN_SQL = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS corpus_id, list_inner_product(a.v, b.v) AS score
      FROM e a, e b WHERE a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS rank
      FROM s)"""


@register("vector_knn", _KNN_SQL + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, corpus_id, round(score, 6) AS score
FROM t WHERE rank <= 5""")
def q_vector_knn(spark, d):
    e = _emb(spark, d)
    h = vec.knn(e, e, 5, exclude_self=True)
    return h.select("query_id", "rank", "corpus_id", F.round("score", 6).alias("score"))


@register("vector_knn_cells", _KNN_SQL + """
SELECT query_id, CAST(rank AS INTEGER) AS rank, corpus_id, round(score, 6) AS score
FROM t WHERE rank <= 3""")
def q_vector_knn_cells(spark, d):
    """J6 with pruning: cells whose bound stays below a query's third best score are skipped."""
    e = _emb(spark, d)
    h = vector_cells.knn_cells(e, e, 3, exclude_self=True)
    return h.select("query_id", "rank", "corpus_id", F.round("score", 6).alias("score"))


@register("retrieval_context", _KNN_SQL + """
SELECT t.query_id, string_agg('vec ' || e.vec_id || ', label ' || e.label, chr(10) ORDER BY t.rank)
         AS context
FROM t JOIN e ON e.vec_id = t.corpus_id WHERE t.rank <= 5 GROUP BY 1""")
def q_retrieval_context(spark, d):
    e = _emb(spark, d)
    h = vec.knn(e, e, 5, exclude_self=True)
    texts = e.select("vec_id", F.concat(F.lit("vec "), F.col("vec_id").cast("string"),
                                         F.lit(", label "), F.col("label").cast("string"))
                     .alias("text"))
    return vec.context_text(h, texts)


@register("route_orders_with_context", f"""WITH {EV}, {_CENTROIDS_SQL},
q AS ({route_sql(_ORDER_TEXTS, ["o_orderkey"])}),
o AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS place, count(*) OVER () AS n_labels FROM c
      WHERE label IS NOT NULL),
s AS (SELECT c.label, e.vec_id, row_number() OVER (PARTITION BY c.label
        ORDER BY list_inner_product(c.centroid, e.v) DESC, e.vec_id) AS rank FROM c, e),
t AS (SELECT label, string_agg('Tarih: ' || CAST(date AS VARCHAR) || ', Durum: ' || level ||
        ', Değer: ' || printf('%.2f', value), chr(10) ORDER BY rank) AS context
      FROM s JOIN r ON r.reading_id = s.vec_id WHERE rank <= 5 GROUP BY 1)
SELECT o_orderkey, status, context, '{vec.PROMPT_HEADER}' || chr(10) || context || chr(10) ||
       chr(10) || 'Soru: ' || {rewrite_sql('question')} || chr(10) || '{vec.PROMPT_FOOTER}' AS prompt
FROM (SELECT q.o_orderkey, status, CASE WHEN status IN ('needs_date', 'suggest', 'not_found')
             THEN context END AS context, question
      FROM q JOIN ({order_questions_sql()}) USING (o_orderkey)
        LEFT JOIN o ON o.place = o_orderkey % n_labels LEFT JOIN t USING (label))""")
def q_route_orders_with_context(spark, d):
    """B3 / X15 over the questions of all orders. The vector of a question is the centroid at
    place o_orderkey mod the number of labels, in label order."""
    e = _emb(spark, d)
    c = vec.centroids(e.where("label IS NOT NULL"))
    placed = ranks(c.withColumn("_all", F.lit(0)), "_all", ("label",), "vec_id")
    centroids = placed.select("vec_id", F.col("centroid").alias("embedding"))
    n = F.broadcast(placed.agg(F.greatest(F.count("*"), F.lit(1)).alias("_n")))  # one row
    q = _order_questions(spark, d).crossJoin(n).withColumn("vector", F.col("o_orderkey") % F.col("_n"))
    texts = events_readings(spark, d).select("reading_id", tx.row_text(
        F.col("date"), F.col("level_raw"), F.col("value")).alias("text"))
    routed = rt.route_questions(q, ["o_orderkey"], "question")
    return rt.with_shared_context(routed, q, "o_orderkey", "question", "vector",
                                  vec.knn(centroids, e, 5), texts).select(
        "o_orderkey", "status", "context", "prompt")


# ------------------------------------------------------------------ ranges (PF10), anomaly (AN1-AN3)

from tremolo.operators import anomaly as an  # noqa: E402
from tremolo.operators import ranges as rg  # noqa: E402

_ORDER_BOUNDS = ("1995-01-08", "2001-07-23")


def _order_range_requests(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    day = F.to_date("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    week_before = F.date_format(F.date_sub(day, 7), "yyyy-MM-dd")
    start = (F.when(F.col("o_orderstatus") == "P", F.date_format(day, "dd/MM/yyyy"))
             .when(F.col("o_orderstatus") == "O", iso).otherwise(week_before))
    end = F.when(F.col("o_orderstatus") == "O", week_before).otherwise(iso)
    return o.select(F.col("o_orderkey").alias("request_id"), start.alias("start"),
                    end.alias("end"))


@register("range_requests", f"""WITH {ORD},
q AS (SELECT o_orderkey AS request_id,
        CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%d/%m/%Y')
             WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
             ELSE strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d') END AS start,
        CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%d')
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS "end" FROM orders),
p AS (SELECT *, CAST(try_strptime(start, '%Y-%m-%d') AS DATE) AS s,
             CAST(try_strptime("end", '%Y-%m-%d') AS DATE) AS e,
             regexp_matches(start, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
               AND regexp_matches("end", '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AS fmt FROM q),
c AS (SELECT p.request_id, count(r.ts) AS n FROM p LEFT JOIN r
        ON r.ts >= CAST(p.s AS TIMESTAMP)
       AND r.ts <= CAST(p.e AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 SECOND
      WHERE p.fmt AND p.s IS NOT NULL AND p.e IS NOT NULL AND p.s <= p.e GROUP BY 1),
st AS (SELECT p.request_id, start, "end",
         CASE WHEN NOT (fmt AND s IS NOT NULL AND e IS NOT NULL) THEN 'bad_format'
              WHEN s > e THEN 'start_after_end'
              WHEN s < DATE '{_ORDER_BOUNDS[0]}' OR e > DATE '{_ORDER_BOUNDS[1]}' THEN 'out_of_bounds'
              WHEN coalesce(c.n, 0) = 0 THEN 'no_data' ELSE 'ok' END AS status, c.n
       FROM p LEFT JOIN c USING (request_id))
SELECT request_id, start, "end", status, CASE WHEN status = 'ok' THEN n END AS n_readings FROM st""")
def q_range_requests(spark, d):
    return rg.range_requests(_order_range_requests(spark, d), orders_readings(spark, d),
                             *_ORDER_BOUNDS)


@register("anomaly_points")
def q_anomaly_points(spark, d):
    """AN1 / AN2: isolation-forest labels over the whole events readings (rows-only:
    the forest is randomised, its properties are tested in pytest)."""
    p = an.anomaly_points(events_readings(spark, d))
    return p.select("reading_id", "machine_id", "ts", "value", "level", "score", "anomaly",
                    "color")


@register("anomaly_daily")
def q_anomaly_daily(spark, d):
    return an.anomaly_daily(an.anomaly_points(events_readings(spark, d)))


@register("anomaly_invariants", f"""WITH {EV}
SELECT machine_id, count(*) AS n, count(DISTINCT value) AS n_values, count(DISTINCT value) AS n_value_scores,
       count(*) AS n_labelled, true AS scores_in_range, true AS at_most_one_percent
FROM r WHERE value IS NOT NULL GROUP BY 1""")
def q_anomaly_invariants(spark, d):
    """AN1 / AN2 / J8: what holds for any forest: every reading is kept and coloured by its label, a value has
    one score, and at most one in a hundred of all readings is flagged."""
    p = an.anomaly_points(events_readings(spark, d))
    agreeing = F.when(F.col("anomaly") == -1, "red").otherwise("blue") == F.col("color")
    by_machine = p.groupBy("machine_id").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("n_values"),
        F.countDistinct("value", "score").alias("n_value_scores"), F.count_if(agreeing).alias("n_labelled"),
        F.bool_and((F.col("score") > 0) & (F.col("score") <= 1)).alias("scores_in_range"),
        F.count_if(F.col("anomaly") == -1).alias("_flagged"))
    over = by_machine.agg((100 * F.sum("_flagged") <= F.sum("n")).alias("at_most_one_percent"))
    return by_machine.drop("_flagged").crossJoin(F.broadcast(over))  # one row


# ------------------------------------------------------------------ loading and row level (SRC1-3, PF1, PF2, PF11)

from tremolo.functions.levels import band_level  # noqa: E402
from tremolo.sources.readings import clean_readings  # noqa: E402

_LOAD_SQL = f"""WITH {EV}
SELECT reading_id, machine_id, ts, value, level, level AS level_raw, date FROM r"""


@register("load_readings", _LOAD_SQL)
def q_load_readings(spark, d):
    return events_readings(spark, d)


@register("load_clean", _LOAD_SQL + " WHERE ts IS NOT NULL AND value IS NOT NULL")
def q_load_clean(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return clean_readings(ev, ts="ts", value="value", machine="event_type", reading_id="event_id")


@register("band_levels", f"""WITH {EV}
SELECT reading_id, value, level FROM r""")
def q_band_levels(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    return ev.select(F.col("event_id").alias("reading_id"), "value",
                     band_level(F.col("value")).alias("level"))


@register("filter_level", f"""WITH {EV}
SELECT reading_id, machine_id, ts, value FROM r WHERE level = 'RED'""")
def q_filter_level(spark, d):
    """PF2: the level is asked for as its value range, which reaches the scan."""
    return events_readings(spark, d, only_level="RED").select("reading_id", "machine_id", "ts", "value")


@register("row_texts", f"""WITH {EV}
SELECT reading_id, 'Tarih: ' || CAST(date AS VARCHAR) || ', Durum: ' || level || ', Değer: '
       || printf('%.2f', value) AS text FROM r""")
def q_row_texts(spark, d):
    """PF11: one text per reading. Values are stored with two decimals, so Spark's
    half-up formatting and the oracle's agree (they differ only on exact .005 ties)."""
    r = events_readings(spark, d)
    return r.select("reading_id", tx.row_text(F.col("date"), F.col("level_raw"),
                                              F.col("value")).alias("text"))


@register("normalize_terms", """SELECT conv_id, turn,
  regexp_replace(regexp_replace(text, '(?i)\\bmakinenin\\b', 'RTF makinesinin', 'g'),
                 '(?i)\\bmakine\\b', 'RTF makinesi', 'g') AS text
FROM conversations WHERE role = 'user'""")
def q_normalize_terms(spark, d):
    """X8 over every user turn (Java and RE2 word bounds differ only next to non-ASCII
    letters)."""
    t = _turns(spark, d).where(F.col("role") == "user")
    return t.select("conv_id", "turn", tx.normalize_terms(F.col("text")).alias("text"))


@register("domain_gate", """SELECT conv_id, turn,
  regexp_matches(lower(translate(text, 'İIı', 'iii')), '\\b(makine|titreşim|alarm|rtf)\\b')
    AS in_domain
FROM conversations WHERE role = 'user'""")
def q_domain_gate(spark, d):
    """X9 over every user turn (as X8 for word bounds)."""
    t = _turns(spark, d).where(F.col("role") == "user")
    return t.select("conv_id", "turn", tx.in_domain(F.col("text")).alias("in_domain"))


@register("route_questions_gated")
def q_route_questions_gated(spark, d):
    """The gated entry point (term rewrite, domain gate, threshold 0.40); rows-only."""
    q = _turns(spark, d).where(F.col("role") == "user").select("conv_id", "turn", "text")
    r = rt.route_questions(q, ["conv_id", "turn"], "text", threshold=0.40, gate=True)
    return r.withColumn("suggestions", F.array_join("suggestions", " | "))


from tremolo.plans.intents import CATALOGUE_QUESTIONS  # noqa: E402


_ORDER_MACHINES = "SELECT o_orderkey, o_orderpriority AS machine_id FROM orders"


def _answered_orders(spark, d, q):
    routed = rt.route_questions(q, ["o_orderkey"], "question").join(
        q.select("o_orderkey", "machine_id"), "o_orderkey")
    return _routed_shown(ans.answer_questions(routed, orders_readings(spark, d)))


def _catalogue_texts_sql():
    entry = " ".join("WHEN {} THEN '{}'".format(i, t.replace("'", "''"))
                     for i, t in enumerate(CATALOGUE_QUESTIONS))
    return (f"SELECT o_orderkey, replace((CASE o_orderkey % {len(CATALOGUE_QUESTIONS)} {entry} END),"
            f" '…', strftime(o_orderdate, '%d.%m.%Y')) AS _text FROM orders")


@register("answer_catalogue_questions", answers_sql(
    ORD, route_sql(_catalogue_texts_sql(), ["o_orderkey"]), ["o_orderkey"], _ORDER_MACHINES))
def q_answer_catalogue_questions(spark, d):
    """B1 / J3 / J4 over a question table derived from every order: the phrasing is the
    catalogue entry chosen by the order key (no row is filtered), entries that take a
    date get the order's date; machine = order priority, readings = orders."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    templates = F.array(*[F.lit(t) for t in CATALOGUE_QUESTIONS])
    text = F.element_at(templates, (F.pmod(F.col("o_orderkey"), F.lit(len(CATALOGUE_QUESTIONS)))
                                    + 1).cast("int"))
    text = F.regexp_replace(text, "…", F.date_format("o_orderdate", "dd.MM.yyyy"))
    return _answered_orders(spark, d, o.select(
        "o_orderkey", F.col("o_orderpriority").alias("machine_id"), text.alias("question")))


@register("answer_order_questions", answers_sql(
    ORD, route_sql(_ORDER_TEXTS, ["o_orderkey"]), ["o_orderkey"], _ORDER_MACHINES))
def q_answer_order_questions(spark, d):
    """B1-B4 over one question per order: every status, pattern kind and date form answered."""
    return _answered_orders(spark, d, _order_questions(spark, d))
