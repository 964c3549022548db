"""Text functions over question columns (built-in expressions only, no UDFs).

Matching is done on *folded* text: ``İ``, ``I`` and ``ı`` become ``i`` and the rest
is lower-cased. The reference matches with Python's ``re.IGNORECASE``, which treats
those four letters as equal, so folding keeps its matches while making them the
same in Java (Spark) and RE2 (the DuckDB oracle), and it avoids Java turning
``İ`` into two characters when lower-casing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turkish month names, January to December.
TR_MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos",
             "eylül", "ekim", "kasım", "aralık")
# English month names, January to December.
EN_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august",
             "september", "october", "november", "december")
# Turkish number words one to ten.
TR_NUMBERS = ("bir", "iki", "üç", "dört", "beş", "altı", "yedi", "sekiz", "dokuz", "on")
# Level words, in the order they are tested.
LEVEL_WORDS = (("sarı", "YELLOW"), ("turuncu", "ORANGE"), ("yeşil", "GREEN"), ("kırmızı", "RED"))
# Words that mark a question as about the machine data.
DOMAIN_WORDS = ("makine", "titreşim", "alarm", "rtf")
# Term rewrites (whole words, any case).
TERM_REWRITES = (("makinenin", "RTF makinesinin"), ("makine", "RTF makinesi"))


def fold_py(s: str) -> str:
    """Python twin of :func:`fold`, for building patterns from the word lists."""
    return s.replace("İ", "i").replace("I", "i").replace("ı", "i").lower()


def fold(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.lower(F.translate(col, "İIı", "iii"))


# ---- the question grammar: patterns are put together from tokens, in folded text ----

_GAP = r"\s+"      # between two words
_LATER = ".*"      # anything on the same line
_YEAR, _PAIR, _DAY, _COUNT = "[0-9]{4}", "[0-9]{2}", "[0-9]{1,2}", "[0-9]+"


def _one_of(words) -> str:
    """A captured word of a list."""
    return _part("|".join(fold_py(w) for w in words))


def _part(pattern: str) -> str:
    return f"({pattern})"


def _phrase(*tokens: str) -> str:
    return _GAP.join(tokens)


def _whole(pattern: str) -> str:
    return rf"\b{pattern}\b"


def _numeric_date(*fields: str) -> str:
    """Fields in this order, with a dash, slash or dot between two."""
    return _part("[-/.]".join(fields))


_COLOR = _one_of(w for w, _ in LEVEL_WORDS)
#: year first or day first; the first part is set if the year is
DATE_NUM_RE = "|".join(_numeric_date(*f) for f in ((_YEAR, _PAIR, _PAIR), (_PAIR, _PAIR, _YEAR)))
#: day, month, year
DATE_TR_RE = _phrase(_part(_DAY), _one_of(TR_MONTHS), _part(_YEAR))
#: month and year, with a day in front or, before a comma, behind the month
DATE_EN_RE = (_part(_DAY + _GAP) + "?" + _one_of(EN_MONTHS) + _GAP
              + _part(_DAY + r",\s*") + "?" + _part(_YEAR))
LOOKBACK_NUM_RE = _phrase("son", _part(_COUNT), "ay")
LOOKBACK_WORD_RE = _phrase("son", _one_of(TR_NUMBERS), "ay")
MONTHS_COUNT_RE = _phrase("kaç", "ay", "boyunca") + _LATER + _whole(_COLOR)
MONTHS_LIST_RE = "hangi aylarda" + _LATER + _whole(_COLOR)
MONTH_FAULT_RE = _phrase(_one_of(TR_MONTHS), fold_py("ayında")) + _LATER + fold_py("arıza")
DOMAIN_RE = _whole(_one_of(DOMAIN_WORDS))


def _lookup(key: Column, pairs) -> Column:
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*flat), key)


def _date_parts(f: Column) -> dict[str, Column]:
    """Raw pattern matches for the date kinds ('' when absent)."""
    return {
        "num": F.regexp_extract(f, DATE_NUM_RE, 0),
        "iso": F.regexp_extract(f, DATE_NUM_RE, 1),
        "tr_d": F.regexp_extract(f, DATE_TR_RE, 1),
        "tr_m": F.regexp_extract(f, DATE_TR_RE, 2),
        "tr_y": F.regexp_extract(f, DATE_TR_RE, 3),
        "en_a": F.regexp_extract(f, DATE_EN_RE, 1),
        "en_m": F.regexp_extract(f, DATE_EN_RE, 2),
        "en_b": F.regexp_extract(f, DATE_EN_RE, 3),
        "en_y": F.regexp_extract(f, DATE_EN_RE, 4),
    }


def _date_from_parts(p: dict[str, Column], compat_dayfirst: bool) -> Column:
    norm = F.regexp_replace(p["num"], r"[/.]", "-")
    iso_date = F.try_to_date(norm, "yyyy-MM-dd")
    if compat_dayfirst:
        iso_date = F.coalesce(F.try_to_date(norm, "yyyy-dd-MM"), iso_date)
    d_num = F.when(p["iso"] != "", iso_date).otherwise(F.try_to_date(norm, "dd-MM-yyyy"))
    tr_month = _lookup(p["tr_m"], [(fold_py(m), i + 1) for i, m in enumerate(TR_MONTHS)])
    d_tr = F.try_to_date(F.concat_ws("-", p["tr_y"], tr_month.cast("string"), p["tr_d"]), "y-M-d")
    en_month = _lookup(p["en_m"], [(m, i + 1) for i, m in enumerate(EN_MONTHS)])
    day_a = F.regexp_replace(p["en_a"], r"\s", "")
    day_b = F.regexp_replace(p["en_b"], r"[,\s]", "")
    en_day = F.coalesce(F.nullif(day_a, F.lit("")), F.nullif(day_b, F.lit("")), F.lit("1"))
    d_en = F.try_to_date(F.concat_ws("-", p["en_y"], en_month.cast("string"), en_day), "y-M-d")
    # every kind's group used here is non-empty exactly when that kind matches
    return (F.when(p["num"] != "", d_num)
            .when(p["tr_m"] != "", d_tr)
            .when(p["en_m"] != "", d_en))


def extract_date(q: Column | str, compat_dayfirst: bool = False) -> Column:
    """First date in a question, as DATE (NULL when none or invalid).

    Tried in order: numeric ``YYYY-MM-DD`` / ``DD-MM-YYYY`` with ``-``, ``/`` or ``.``;
    ``15 Şubat 2023``; ``February 15, 2023`` / ``15 February 2023`` / ``February 2023``
    (day 1). The first kind that matches decides, even when its date is invalid.
    ``compat_dayfirst`` reads ISO text day-first when that is a valid date, as the
    reference's parser does (``2023-02-03`` -> 2023-03-02).

    One expression for single use; over tables prefer :func:`add_question_fields`,
    which folds the text once and extracts in stages."""
    return _date_from_parts(_date_parts(fold(q)), compat_dayfirst)


def _lookback_parts(f: Column) -> dict[str, Column]:
    return {"lb_num": F.regexp_extract(f, LOOKBACK_NUM_RE, 1),
            "lb_word": F.regexp_extract(f, LOOKBACK_WORD_RE, 1)}


def _lookback_from_parts(p: dict[str, Column]) -> Column:
    word = _lookup(p["lb_word"], [(fold_py(w), i + 1) for i, w in enumerate(TR_NUMBERS)])
    return (F.when(p["lb_num"] != "", p["lb_num"].try_cast("int"))
            .when(p["lb_word"] != "", word))


def lookback_months(q: Column | str) -> Column:
    """``son <n> ay`` -> n, written in digits or as a word one to ten; else NULL."""
    return _lookback_from_parts(_lookback_parts(fold(q)))


def _level_in_folded(f: Column) -> Column:
    expr = None
    for w, lv in LEVEL_WORDS:
        cond = F.instr(f, fold_py(w)) > 0
        expr = F.when(cond, F.lit(lv)) if expr is None else expr.when(cond, F.lit(lv))
    return expr


def level_in_text(q: Column | str) -> Column:
    """The first level word found (tested in the order sarı, turuncu, yeşil,
    kırmızı), as a level name; NULL when none."""
    return _level_in_folded(fold(q))


def _color_level(word: Column) -> Column:
    return _lookup(word, [(fold_py(w), lv) for w, lv in LEVEL_WORDS])


def _intent_parts(f: Column) -> dict[str, Column]:
    return {"mc": F.regexp_extract(f, MONTHS_COUNT_RE, 1),
            "ml": F.regexp_extract(f, MONTHS_LIST_RE, 1),
            "mf": F.regexp_extract(f, MONTH_FAULT_RE, 1),
            "lv": _level_in_folded(f)}


def _kind_from_parts(p: dict[str, Column], back: Column) -> Column:
    return (F.when(p["mc"] != "", F.lit("months_count"))
            .when(p["ml"] != "", F.lit("months_list"))
            .when(p["mf"] != "", F.lit("month_fault"))
            .when(back.isNotNull(), F.lit("recent_months")))


def _intent_fields(p: dict[str, Column], kind: Column, back: Column) -> dict[str, Column]:
    month_no = _lookup(p["mf"], [(fold_py(m), i + 1) for i, m in enumerate(TR_MONTHS)])
    level = (F.when(kind == "months_count", _color_level(p["mc"]))
             .when(kind == "months_list", _color_level(p["ml"]))
             .when(kind == "month_fault", F.lit("RED"))
             .when(kind == "recent_months", p["lv"]))
    return {"kind": kind, "level": level,
            "months": F.when(kind == "recent_months", back),
            "month_no": F.when(kind == "month_fault", month_no)}


def parse_intents(q: Column | str) -> Column:
    """The pattern intents, tested in order; returns a struct
    (kind, level, months, month_no) with kind NULL when no pattern matches.

    months_count: ``kaç ay boyunca ... <color>``  -> months showing the level
    months_list:  ``hangi aylarda ... <color>``   -> list of those months
    month_fault:  ``<month> ayında ... arıza``    -> red dates in that month
    recent_months: ``son <n> ay`` (+ optional level word) -> days in the last n months

    One expression for single use; over tables prefer :func:`add_question_fields`."""
    f = fold(q)
    p = _intent_parts(f)
    back = _lookback_from_parts(_lookback_parts(f))
    out = _intent_fields(p, _kind_from_parts(p, back), back)
    return F.struct(*[c.alias(k) for k, c in out.items()])


def add_question_fields(df: DataFrame, text: str, prefix: str = "",
                        compat_dayfirst: bool = False, intents: bool = True,
                        date: bool = True) -> DataFrame:
    """X1-X7 over a table: adds ``date`` and / or ``kind, level, months, month_no``
    (with ``prefix``).

    The text is folded once into a column; the look-back and the intent kind are
    materialised once each; every other pattern sits in the branch that needs it, so a
    pattern runs only when the earlier ones did not match. Each projection stays small
    enough for whole-stage code generation."""
    d = df.withColumn("_qf", fold(F.col(text)))
    f = F.col("_qf")
    if date:
        d = d.withColumn(prefix + "date", _date_from_parts(_date_parts(f), compat_dayfirst))
    if intents:
        d = d.withColumn("_back", _lookback_from_parts(_lookback_parts(f)))
        kind = (F.when(f.rlike(MONTHS_COUNT_RE), F.lit("months_count"))
                .when(f.rlike(MONTHS_LIST_RE), F.lit("months_list"))
                .when(f.rlike(MONTH_FAULT_RE), F.lit("month_fault"))
                .when(F.col("_back").isNotNull(), F.lit("recent_months")))
        d = d.withColumn("_kind", kind)
        p = {"mc": F.regexp_extract(f, MONTHS_COUNT_RE, 1),
             "ml": F.regexp_extract(f, MONTHS_LIST_RE, 1),
             "mf": F.regexp_extract(f, MONTH_FAULT_RE, 1),
             "lv": _level_in_folded(f)}
        fields = _intent_fields(p, F.col("_kind"), F.col("_back"))
        d = d.select("*", *[c.alias(prefix + k) for k, c in fields.items()]).drop("_kind", "_back")
    return d.drop("_qf")


def normalize_terms(q: Column | str) -> Column:
    """``makinenin`` -> ``RTF makinesinin``, then ``makine`` -> ``RTF makinesi``
    (whole words, any case). Not idempotent: ``RTF makine`` becomes ``RTF RTF makinesi``."""
    col = F.col(q) if isinstance(q, str) else q
    for src, dst in TERM_REWRITES:
        col = F.regexp_replace(col, r"(?iuU)\b" + src + r"\b", dst)
    return col


def in_domain(q: Column | str) -> Column:
    """The question mentions the machine, vibration, alarms or RTF."""
    return fold(q).rlike(DOMAIN_RE)


def row_text(date: Column, level: Column, value: Column) -> Column:
    """PF11: ``Tarih: <date>, Durum: <level>, Değer: <value, 2 places>``. Spark rounds
    half up where Python rounds the binary value (0.125 -> 0.13 here, 0.12 there)."""
    return F.format_string("Tarih: %s, Durum: %s, Değer: %.2f", date.cast("string"), level, value)


def join_sorted(values: Column, sep: str = ", ") -> Column:
    """Sorted distinct values joined with ``sep`` (aggregate expression)."""
    return F.array_join(F.sort_array(F.collect_set(values.cast("string"))), sep)
