"""DuckDB SQL for answered question tables, used as the oracle of the answering queries.

Written from the readings ``r`` and not from a rollup: every entry is a query of its own.
"""

from __future__ import annotations

from tremolo.functions.levels import bands
from tremolo.sources.static import STATIC_ANSWERS

_DAYS = "string_agg(DISTINCT CAST(date AS VARCHAR), ', ' ORDER BY CAST(date AS VARCHAR))"


def _two(x: str) -> str:
    """Two places, half up, of the number as it is written."""
    return f"CAST(CAST(CAST(round({x}, 6) AS VARCHAR) AS DECIMAL(30, 2)) AS VARCHAR)"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _range(sep: str = " - ") -> str:
    return f"concat_ws('{sep}', {_two('min(value)')}, {_two('max(value)')})"


def _summary() -> str:
    return f"concat_ws(' / ', {_two('min(value)')}, {_two('max(value)')}, {_two('avg(value)')})"


def _per_machine(answer: str, where: str = "true", source: str = "r") -> str:
    return f"SELECT machine_id, {answer} AS a FROM {source} WHERE {where} GROUP BY 1"


def entries_sql(gap_seconds: int = 60, recent_days: int = 90, recent_levels_days: int = 30) -> str:
    """(machine_id, entry, a) from the CTEs below."""
    def recent(days: int) -> str:
        return f"ts >= mx - INTERVAL {days} DAY"

    in_year = "year(date) = (SELECT y FROM y)"
    bounds = "; ".join(f"{lv}: {'' if lo is None else lo}-{'' if up is None else up}"
                       for lv, lo, up in bands())
    red_from = next(lo for lv, lo, _ in bands() if lv == "RED")
    fixed = {5: bounds, 6: str(red_from), **dict(STATIC_ANSWERS)}
    top = ("SELECT machine_id, string_agg({label}, ', ' ORDER BY rk) AS a FROM (SELECT *, "
           "row_number() OVER (PARTITION BY machine_id ORDER BY {order}) AS rk FROM {source}) "
           "WHERE rk <= {k} GROUP BY 1")
    day = "CAST(date AS VARCHAR)"
    parts = {
        0: "SELECT machine_id, a FROM (SELECT *, row_number() OVER (PARTITION BY machine_id "
           "ORDER BY e - s DESC, s) AS rk, strftime(s, '%Y-%m-%d %H:%M') || ' - ' || "
           "strftime(e, '%Y-%m-%d %H:%M') AS a FROM runs) WHERE rk = 1",
        1: _per_machine(_DAYS, "level = 'YELLOW' AND n = best", "pk"),
        2: _per_machine(_DAYS, "level = 'RED' AND n = best", "pk"),
        3: _per_machine(_range()),
        4: _per_machine("CAST(count(*) FILTER (WHERE level = 'RED' AND ts BETWEEN "
                        "make_timestamp((SELECT y FROM y), 1, 1, 0, 0, 0) AND "
                        "make_timestamp((SELECT y FROM y), 12, 31, 0, 0, 0)) AS VARCHAR)"),
        10: _per_machine(_DAYS, f"level = 'ORANGE' AND {in_year}"),
        11: _per_machine(_summary(), in_year),
        12: "SELECT machine_id, string_agg(CAST(date AS VARCHAR), ', ' ORDER BY date) AS a FROM "
            "(SELECT machine_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) "
            "AS DATE) AS date FROM r GROUP BY 1) ANTI JOIN r USING (machine_id, date) GROUP BY 1",
        13: _per_machine(_DAYS, "reds = n", "dy"),
        14: f"SELECT machine_id, {_two('g / 60.0')} || ' h (' || g || ' min)' AS a FROM (SELECT "
        "machine_id, count(*) FILTER (WHERE level = 'GREEN') AS g FROM r GROUP BY 1)",
        19: _per_machine(_DAYS, "before = 'GREEN' AND level = 'RED'", "pv"),
        20: top.format(label=day, order="calm DESC, date", source="dy WHERE calm > 0", k=3),
        21: top.format(label="m", order="green DESC, m", source="mo WHERE green > 0", k=3),
        22: _per_machine(_summary()),
        23: top.format(label=day, order="c DESC, date", k=3, source=(
            "(SELECT machine_id, date, count(*) AS c FROM pv WHERE pos = 1 OR level IS DISTINCT "
            "FROM before OR level IS NULL GROUP BY 1, 2)")),
        24: top.format(label=day, order="faults / n, date", source="dy", k=1),
        25: top.format(label="m", order="s DESC, m", source="mo WHERE s IS NOT NULL", k=1),
        26: f"SELECT machine_id, string_agg(t, ', ' ORDER BY t) AS a FROM (SELECT machine_id, "
            f"year(date) || ': ' || {_two('avg(value)')} AS t FROM r GROUP BY machine_id, year(date)) "
            f"GROUP BY 1",
        27: _per_machine("CAST(count(*) FILTER (WHERE before = 'GREEN' AND level = 'RED') AS VARCHAR)",
                         source="pv"),
        28: _per_machine("string_agg(DISTINCT level, ', ' ORDER BY level)",
                         f"level IS NOT NULL AND {recent(recent_levels_days)}", "rx"),
        29: _per_machine(_DAYS, "level = 'RED' AND n = best", "pk"),
        32: _per_machine(_DAYS, "level = 'RED'"),
    }
    for entry, lv in ((15, "YELLOW"), (16, "ORANGE"), (17, "GREEN"), (18, "RED")):
        parts[entry] = _per_machine(
            f"CAST(count(DISTINCT date) FILTER (WHERE level = '{lv}' AND {recent(recent_days)}) "
            f"AS VARCHAR)", source="rx")
    for entry, text in fixed.items():
        parts[entry] = f"SELECT DISTINCT machine_id, {_text(text)} AS a FROM r"
    return f"""rx AS (SELECT *, max(ts) OVER (PARTITION BY machine_id) AS mx FROM r),
y AS (SELECT max(year(date)) AS y FROM r),
pk AS (SELECT machine_id, date, level, count(*) AS n,
              max(count(*)) OVER (PARTITION BY machine_id, level) AS best FROM r GROUP BY 1, 2, 3),
dy AS (SELECT machine_id, date, count(*) AS n, count(*) FILTER (WHERE level = 'RED') AS reds,
              count(*) FILTER (WHERE level IN ('GREEN', 'YELLOW')) AS calm,
              count(*) FILTER (WHERE level IS DISTINCT FROM 'GREEN') AS faults FROM r GROUP BY 1, 2),
mo AS (SELECT machine_id, strftime(ts, '%Y-%m') AS m, stddev_samp(value) AS s,
              count(*) FILTER (WHERE level = 'GREEN') AS green FROM r GROUP BY 1, 2),
pv AS (SELECT *, lag(level) OVER w AS before, row_number() OVER w AS pos FROM r
       WINDOW w AS (PARTITION BY machine_id ORDER BY ts, reading_id)),
ra AS (SELECT *, lag(ts) OVER (PARTITION BY machine_id ORDER BY ts, reading_id) AS p FROM r
       WHERE level = 'RED'),
rb AS (SELECT *, count(*) FILTER (WHERE p IS NULL OR ts - p > INTERVAL {gap_seconds} SECOND) OVER
       (PARTITION BY machine_id ORDER BY ts, reading_id ROWS UNBOUNDED PRECEDING) AS run FROM ra),
runs AS (SELECT machine_id, min(ts) AS s, max(ts) AS e FROM rb GROUP BY machine_id, run),
entries AS (""" + "\nUNION ALL ".join(
        f"SELECT machine_id, {i} AS entry, a FROM ({q})" for i, q in sorted(parts.items())) + ")"


def answers_sql(readings: str, routed: str, ids: list[str], machines: str) -> str:
    """``readings``: the CTE ``r``; ``routed``: the router's SQL; ``machines``: ids, machine_id."""
    using = ", ".join(ids)
    return f"""WITH {readings}, {entries_sql()},
q AS (SELECT * FROM ({routed}) JOIN (SELECT DISTINCT * FROM ({machines})) USING ({using})),
ms AS (SELECT machine_id, max(ts) AS mx, true AS has FROM r GROUP BY 1),
ds AS (SELECT machine_id, date, {_range()} AS span, {_summary()} AS summary FROM r GROUP BY 1, 2),
dm AS (SELECT machine_id, date, arg_min(level, (-n, level)) AS mode FROM pk WHERE level IS NOT NULL
       GROUP BY 1, 2),
bk AS (SELECT p.machine_id, p.months, p.level, count(DISTINCT r.date) AS days
       FROM (SELECT DISTINCT machine_id, months, level FROM q WHERE kind = 'recent_months') p
       JOIN ms USING (machine_id) JOIN r ON r.machine_id = p.machine_id
        AND (p.level IS NULL OR r.level = p.level) AND r.ts >= ms.mx - to_months(p.months)
       GROUP BY ALL),
ml AS (SELECT machine_id, level, count(DISTINCT strftime(ts, '%Y-%m')) AS n,
              string_agg(DISTINCT strftime(ts, '%Y-%m'), ', ' ORDER BY strftime(ts, '%Y-%m')) AS list
       FROM r GROUP BY 1, 2),
mf AS (SELECT machine_id, month(date) AS month_no, {_DAYS} AS dates FROM r WHERE level = 'RED'
       GROUP BY 1, 2),
x AS (SELECT q.*, CASE
        WHEN status = 'matched' AND needs_date THEN CASE WHEN ds.span IS NOT NULL THEN
          CASE intent_id WHEN 7 THEN ds.span WHEN 8 THEN coalesce(dm.mode, '') ELSE ds.summary END END
        WHEN NOT coalesce(ms.has, false) THEN NULL
        WHEN status = 'matched' THEN coalesce(entries.a, '')
        WHEN status <> 'pattern' THEN NULL
        WHEN kind = 'recent_months' THEN CAST(coalesce(bk.days, 0) AS VARCHAR)
        WHEN kind = 'months_count' THEN CAST(coalesce(ml.n, 0) AS VARCHAR)
        WHEN kind = 'months_list' THEN coalesce(ml.list, '')
        WHEN kind = 'month_fault' THEN coalesce(mf.dates, 'hayır') END AS answer
  FROM q LEFT JOIN ms ON ms.machine_id = q.machine_id
  LEFT JOIN entries ON entries.machine_id = q.machine_id AND entries.entry = q.intent_id
  LEFT JOIN ds ON ds.machine_id = q.machine_id AND ds.date = q.date
  LEFT JOIN dm ON dm.machine_id = q.machine_id AND dm.date = q.date
  LEFT JOIN bk ON bk.machine_id = q.machine_id AND bk.months = q.months
   AND bk.level IS NOT DISTINCT FROM q.level
  LEFT JOIN ml ON ml.machine_id = q.machine_id AND ml.level = q.level
  LEFT JOIN mf ON mf.machine_id = q.machine_id AND mf.month_no = q.month_no)
SELECT *, CASE WHEN answer IS NULL AND status IN ('matched', 'pattern') THEN
  CASE WHEN status = 'matched' AND needs_date THEN 'no reading on that date'
       ELSE 'no readings of that machine' END END AS error FROM x"""
