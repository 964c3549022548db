"""A table of questions derived from the orders: one question per order, none left out.

The wording follows the order's key through the catalogue and the phrasings below, which are
chosen so that every routing status, pattern kind, date form and gate verdict occurs; dates,
months and look-backs are those of the order. The text is one SQL expression that reads the same in Spark
and in DuckDB, so both sides ask the same questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremolo.functions.text import EN_MONTHS, LEVEL_WORDS, TR_MONTHS, TR_NUMBERS
from tremolo.plans.intents import CATALOGUE_QUESTIONS

# <D>: the order's date, <M>: its Turkish month, <N>: its month number, <W>: that number as a
# word where there is one, <L>: a level word by order status.
PHRASINGS = (
    # the three other pattern kinds, and look-backs in digits and words
    "Makine kaç ay boyunca <L> seviyede kaldı?",
    "Geçen yıl hangi aylarda alarm <L> oldu?",
    "<M> ayında makinede arıza oldu mu?",
    "Son <N> ay içinde kaç gün <L> görüldü?",
    "SON <W> AYDA kaç gün veri var?",
    # dated entries in other words
    "<D> tarihinde RTF makinesinin değer aralığı ne oldu?",
    "<D> günü makinenin renk seviyesi neydi?",
    "RTF makinesinin değer aralığı neydi, <D> tarihinde?",
    "… tarihinde RTF makinesinin renk seviyesi neydi acaba?",
    # altered words: some close to an entry, some only near one
    "Tüm <L> günleri sırala",
    "Makineyi iyileştirmek için önerileriniz nelerdir?",
    "Makinenin performansını en çok ne etkiler?",
    "En az arıza hangi gün görüldü?",
    "Her ayın ortalama değeri nedir?",
    "Yeşilden kırmızıya geçişler ne zaman yapıldı?",
    "Titreşim değerlerinde en büyük değişiklik hangi haftada oldu?",
    # the bare word opens the gate, its inflected forms do not
    "makine rengi nedir",
    "makinenin rengi nedir",
    "Makine bakımı <D> günü yapıldı mı?",
    # off topic
    "Hava <D> günü nasıldı?",
    "What is the capital of France?",
    "Bugün ne yemek yapsam?",
    "rtf",
    "",
)

_STATUS = (("F", "kırmızı"), ("O", "sarı"), ("P", "yeşil"))


def _case(of: str, pairs, other: str = "") -> str:
    quoted = " ".join(f"WHEN {k} THEN '{v}'" for k, v in pairs)
    return f"(CASE {of} {quoted}{f' ELSE {other}' if other else ''} END)"


def question_expr() -> str:
    """The question of an order, in SQL that Spark and DuckDB both read."""
    texts = (*(q.replace("…", "<D>") for q in CATALOGUE_QUESTIONS), *PHRASINGS)
    day, month, year = (f"CAST({p}(o_orderdate) AS STRING)" for p in ("day", "month", "year"))
    dd, mm = f"lpad({day}, 2, '0')", f"lpad({month}, 2, '0')"
    tr = _case("month(o_orderdate)", [(i + 1, m.capitalize()) for i, m in enumerate(TR_MONTHS)])
    en = _case("month(o_orderdate)", [(i + 1, m.capitalize()) for i, m in enumerate(EN_MONTHS)])
    spelled = (f"(CASE o_custkey % 6 WHEN 0 THEN concat({dd}, '.', {mm}, '.', {year}) "
               f"WHEN 1 THEN concat({year}, '-', {mm}, '-', {dd}) "
               f"WHEN 2 THEN concat({day}, ' ', {tr}, ' ', {year}) "
               f"WHEN 3 THEN concat({en}, ' ', {day}, ', ', {year}) "
               f"WHEN 4 THEN concat({day}, ' ', {en}, ' ', {year}) "
               f"ELSE concat({en}, ' ', {year}) END)")
    word = _case("month(o_orderdate)", [(i + 1, w) for i, w in enumerate(TR_NUMBERS)], month)
    level = _case("o_orderstatus", [(f"'{s}'", w) for s, w in _STATUS], f"'{LEVEL_WORDS[1][0]}'")
    text = _case(f"o_orderkey % {len(texts)}", list(enumerate(texts)))
    for mark, value in (("D", spelled), ("M", tr), ("N", month), ("W", word), ("L", level)):
        text = f"replace({text}, '<{mark}>', {value})"
    return text


def order_questions(orders: DataFrame) -> DataFrame:
    """o_orderkey, machine_id (order priority) and question of every order."""
    return orders.select("o_orderkey", F.col("o_orderpriority").alias("machine_id"),
                         F.expr(question_expr()).alias("question"))


def order_questions_sql() -> str:
    return (f"SELECT o_orderkey, o_orderpriority AS machine_id, {question_expr()} AS question "
            f"FROM orders")
