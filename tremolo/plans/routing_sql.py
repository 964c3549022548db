"""DuckDB SQL twin of the router, used as the oracle for registered routing queries.

Built from the same fixed word lists and patterns as the Spark expressions; it is a
second implementation (relational SQL over the same tables), not a code path of the
engine.
"""

from __future__ import annotations

from tremolo.functions import text as T
from tremolo.plans.intents import CATALOGUE_QUESTIONS, NEEDS_DATE


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(expr: str, pairs) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in pairs) + " END"


def fold_sql(col: str) -> str:
    return f"lower(translate({col}, 'İIı', 'iii'))"


def date_sql(f: str) -> str:
    num, tr, en = _q(T.DATE_NUM_RE), _q(T.DATE_TR_RE), _q(T.DATE_EN_RE)
    norm = f"regexp_replace(regexp_extract({f}, {num}, 0), '[/.]', '-', 'g')"
    d_num = (f"CASE WHEN regexp_extract({f}, {num}, 1) <> '' "
             f"THEN CAST(try_strptime({norm}, '%Y-%m-%d') AS DATE) "
             f"ELSE CAST(try_strptime({norm}, '%d-%m-%Y') AS DATE) END")
    tr_m = _case(f"regexp_extract({f}, {tr}, 2)",
                 [(T.fold_py(m), i + 1) for i, m in enumerate(T.TR_MONTHS)])
    d_tr = (f"CAST(try_strptime(regexp_extract({f}, {tr}, 3) || '-' || CAST({tr_m} AS VARCHAR) "
            f"|| '-' || regexp_extract({f}, {tr}, 1), '%Y-%m-%d') AS DATE)")
    en_m = _case(f"regexp_extract({f}, {en}, 2)", [(m, i + 1) for i, m in enumerate(T.EN_MONTHS)])
    day = (f"coalesce(nullif(regexp_replace(regexp_extract({f}, {en}, 1), '\\s', '', 'g'), ''), "
           f"nullif(regexp_replace(regexp_extract({f}, {en}, 3), '[,\\s]', '', 'g'), ''), '1')")
    d_en = (f"CAST(try_strptime(regexp_extract({f}, {en}, 4) || '-' || CAST({en_m} AS VARCHAR) "
            f"|| '-' || {day}, '%Y-%m-%d') AS DATE)")
    return (f"CASE WHEN regexp_matches({f}, {num}) THEN {d_num} "
            f"WHEN regexp_matches({f}, {tr}) THEN {d_tr} "
            f"WHEN regexp_matches({f}, {en}) THEN {d_en} END")


def intents_sql(f: str) -> dict[str, str]:
    mc, ml, mf = _q(T.MONTHS_COUNT_RE), _q(T.MONTHS_LIST_RE), _q(T.MONTH_FAULT_RE)
    lbn, lbw = _q(T.LOOKBACK_NUM_RE), _q(T.LOOKBACK_WORD_RE)
    colors = [(T.fold_py(w), _q(lv)) for w, lv in T.LEVEL_WORDS]
    back = (f"CASE WHEN regexp_matches({f}, {lbn}) "
            f"THEN TRY_CAST(regexp_extract({f}, {lbn}, 1) AS INTEGER) "
            f"WHEN regexp_matches({f}, {lbw}) THEN "
            + _case(f"regexp_extract({f}, {lbw}, 1)",
                    [(T.fold_py(w), i + 1) for i, w in enumerate(T.TR_NUMBERS)]) + " END")
    kind = (f"CASE WHEN regexp_matches({f}, {mc}) THEN 'months_count' "
            f"WHEN regexp_matches({f}, {ml}) THEN 'months_list' "
            f"WHEN regexp_matches({f}, {mf}) THEN 'month_fault' "
            f"WHEN ({back}) IS NOT NULL THEN 'recent_months' END")
    in_text = ("CASE " + " ".join(f"WHEN contains({f}, {_q(T.fold_py(w))}) THEN {_q(lv)}"
                                  for w, lv in T.LEVEL_WORDS) + " END")
    level = (f"CASE WHEN {kind} = 'months_count' THEN {_case(f'regexp_extract({f}, {mc}, 1)', colors)} "
             f"WHEN {kind} = 'months_list' THEN {_case(f'regexp_extract({f}, {ml}, 1)', colors)} "
             f"WHEN {kind} = 'month_fault' THEN 'RED' "
             f"WHEN {kind} = 'recent_months' THEN {in_text} END")
    month_no = _case(f"regexp_extract({f}, {mf}, 1)",
                     [(T.fold_py(m), i + 1) for i, m in enumerate(T.TR_MONTHS)])
    return {"kind": kind, "level": level,
            "months": f"CASE WHEN {kind} = 'recent_months' THEN {back} END",
            "month_no": f"CASE WHEN {kind} = 'month_fault' THEN {month_no} END"}


def rewrite_sql(col: str) -> str:
    """The inflected form, then the bare word."""
    return (f"regexp_replace(regexp_replace({col}, '(?i)\\bmakinenin\\b', 'RTF makinesinin', 'g'), "
            f"'(?i)\\bmakine\\b', 'RTF makinesi', 'g')")


def gate_sql(col: str) -> str:
    """X9."""
    return f"regexp_matches({fold_sql(col)}, '\\b(makine|titreşim|alarm|rtf)\\b')"


def catalogue_values() -> str:
    rows = ", ".join(f"({i}, {_q(q)})" for i, q in enumerate(CATALOGUE_QUESTIONS))
    return f"(VALUES {rows}) AS t(intent_id, question)"


def route_sql(source: str, ids: list[str], threshold: float = 0.65, suggest_at: float = 0.4,
              k: int = 3, gate: bool = False, dims: int | None = None) -> str:
    """``source`` is a SELECT giving ``ids`` and ``_text``; ``gate``: the gated entry point; ``dims``: vectors
    of hashed trigram counts (``embedder.hashed_trigrams``) instead of trigrams."""
    gram = "substring(f, i, 3)"
    if dims:
        gram = f"CAST('0x' || substr(md5({gram}), 1, 6) AS INTEGER) % {dims}"
    idl = ", ".join(ids)
    using = ", ".join(ids)
    it = intents_sql("f")
    off = f"NOT {gate_sql('_text')}" if gate else "false"
    return f"""WITH q AS (SELECT *, {off} AS off, {fold_sql(
        rewrite_sql('_text') if gate else '_text')} AS f FROM ({source})),
cat AS (SELECT CAST(intent_id AS INTEGER) AS intent_id, question FROM {catalogue_values()}),
catf AS (SELECT intent_id, {fold_sql('question')} AS f FROM cat),
qg AS (SELECT {idl}, {gram} AS gram, count(*) AS cnt
       FROM (SELECT {idl}, f, unnest(range(1, length(f) - 1)) AS i FROM q WHERE length(f) >= 3)
       GROUP BY ALL),
cg AS (SELECT intent_id, {gram} AS gram, count(*) AS cnt
       FROM (SELECT intent_id, f, unnest(range(1, length(f) - 1)) AS i FROM catf
             WHERE length(f) >= 3) GROUP BY ALL),
qn AS (SELECT {idl}, sqrt(sum(cnt * cnt)) AS qnorm FROM qg GROUP BY ALL),
cn AS (SELECT intent_id, sqrt(sum(cnt * cnt)) AS cnorm FROM cg GROUP BY ALL),
sc AS (SELECT {', '.join('qg.' + c for c in ids)}, cg.intent_id,
              sum(qg.cnt * cg.cnt) / (any_value(qn.qnorm) * any_value(cn.cnorm)) AS score
       FROM qg JOIN cg USING (gram) JOIN qn USING ({using}) JOIN cn USING (intent_id)
       GROUP BY ALL),
tk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {idl}
                                                   ORDER BY score DESC, intent_id) AS rk
                      FROM sc) WHERE rk <= {k}),
best AS (SELECT {idl}, intent_id, score FROM tk WHERE rk = 1),
sg AS (SELECT {', '.join('tk.' + c for c in ids)},
              string_agg(cat.question, ' | ' ORDER BY tk.rk) AS sugg
       FROM tk JOIN cat USING (intent_id) WHERE tk.score >= {suggest_at} GROUP BY ALL),
p AS (SELECT q.*, {it['kind']} AS kind, {it['level']} AS level, {it['months']} AS months,
             {it['month_no']} AS month_no, {date_sql('f')} AS date FROM q),
r AS (SELECT p.*, best.intent_id, best.score, sg.sugg,
             coalesce(best.intent_id IN ({', '.join(str(x) for x in NEEDS_DATE)}), false)
               AS needs_date
      FROM p LEFT JOIN best USING ({using}) LEFT JOIN sg USING ({using}))
SELECT {idl}, kind, level, months, month_no, intent_id, round(score, 6) AS score, needs_date, date,
       CASE WHEN off THEN 'off_topic' WHEN kind IS NOT NULL THEN 'pattern'
            WHEN score >= {threshold} THEN CASE WHEN needs_date AND date IS NULL
                                                THEN 'needs_date' ELSE 'matched' END
            WHEN sugg IS NOT NULL THEN 'suggest' ELSE 'not_found' END AS status,
       CASE WHEN NOT off AND kind IS NULL AND NOT coalesce(score >= {threshold}, false)
            THEN sugg END AS suggestions
FROM r"""
