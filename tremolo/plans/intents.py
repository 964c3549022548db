"""The question catalogue: 33 canned questions, each answered by a catalogue operator, and the
entries that a user registers beside them.

``intent_id`` of a canned question is its position in the list (0-32); three of them need a date. The router's
catalogue, the entries' need of a date and the answer columns are compiled from ``entries()``, so a
registered entry is matched, asked for its date and answered like the canned ones.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

# The catalogue questions, in catalogue order.
CATALOGUE_QUESTIONS = (
    "Makinenin en fazla arıza yaptığı tarih aralığını verebilir misin?",
    "Geçmişte sarı alarm seviyesinde en çok hangi tarihlerde görüldü?",
    "Geçmişte kırmızı alarm seviyesinde en çok hangi tarihlerde görüldü?",
    "Makine performansındaki dalgalanmalar hakkında bilgi verebilir misin?",
    "2023 aralığında makinede kaç kez alarm durumu oluştu?",
    "Makine hangi değerlerde sarı alarma geçiyor?",
    "Makine hangi değerlerde kırmızı alarma geçiyor?",
    "… tarihinde RTF makinesinin değer aralığı neydi?",
    "… tarihinde RTF makinesinin renk seviyesi neydi?",
    "… tarihinde makine performansı hakkında bilgi alabilir miyim?",
    "RTF makinesi 2023 aralığında turuncu alarm seviyesinde çalıştığı tarihler?",
    "2023 yılında makine performansı nasıldı?",
    "Son bir yıl içinde makine hangi günlerde tamamen durdu?",
    "Kırmızı seviyede çalıştığı tarihlerde makine tamamen durdu mu?",
    "15 Ocak 2023’ten itibaren yeşil alarmda çalışılan toplam süre nedir?",
    "Son üç ayda sarı alarm seviyesinde kaç gün çalıştı?",
    "Son üç ayda turuncu alarm seviyesinde kaç gün çalıştı?",
    "Son üç ayda yeşil alarm seviyesinde kaç gün çalıştı?",
    "Son üç ayda kırmızı alarm seviyesinde kaç gün çalıştı?",
    "Yeşilden direkt kırmızıya geçiş yapan günler hangileri?",
    "Hangisi renk değişimlerinin en düzenli olduğu tarihler?",
    "Makine, son bir yılda hangi aylarda daha çok yeşildi?",
    "Makine performansının zaman içindeki değişimi nasıl oldu?",
    "Renk değişimlerinin yoğun olduğu dönemler hangi tarihler?",
    "En düşük arıza oranı hangi tarihlerde?",
    "En fazla performans değişikliği hangi ayda oldu?",
    "Her yılın ortalama performansı nedir?",
    "Yeşilden kırmızıya kaç kez geçiş yapıldı?",
    "Son bir ayda hangi renk aralıklarında çalıştı?",
    "En yüksek değerlerde alarm verdiği günler hangileri?",
    "Makine iyileştirme önerileri nelerdir?",
    "Makinenin performansını ne etkileyebilir?",
    "Tüm kırmızı günleri listele",
)
# The entries that take a date (value range, dominant level, summary of a day).
NEEDS_DATE = (7, 8, 9)


class Intent(NamedTuple):
    """``fn`` gives the answers of a registered entry; the canned ones (None) are answered together in
    ``plans.answers``."""

    intent_id: int
    question: str
    fn: Callable | None = None
    params: tuple[str, ...] = ()


PARAMS = ((), ("date",))
_REGISTERED: dict[int, Intent] = {}


def register_intent(intent_id: int, question: str, fn: Callable[[DataFrame], DataFrame],
                    params: tuple[str, ...] = ()) -> Intent:
    """Add an entry to the catalogue.

    ``fn`` takes the readings and returns its answers for all machines at once: (machine_id,
    answer), or with ``params=("date",)`` (machine_id, date, answer) for every date that has one. A number
    that is taken, an empty question, other parameters and a function that cannot be called with the
    readings alone are refused."""
    if intent_id in {e.intent_id for e in entries()}:
        raise ValueError(f"intent {intent_id} exists")
    if not question or not question.strip():
        raise ValueError("an intent needs a question")
    if tuple(params) not in PARAMS:
        raise ValueError(f"params must be one of {PARAMS}")
    try:
        inspect.signature(fn).bind(None)
    except TypeError as e:
        raise TypeError(f"the function of intent {intent_id} must take the readings alone: {e}") from e
    _REGISTERED[intent_id] = Intent(intent_id, question, fn, tuple(params))
    return _REGISTERED[intent_id]


def unregister_intent(intent_id: int) -> None:
    """Remove a registered entry (canned ones stay)."""
    _REGISTERED.pop(intent_id, None)


def entries() -> list[Intent]:
    """All entries of the catalogue, by number."""
    canned = [Intent(i, q, None, ("date",) if i in NEEDS_DATE else ())
              for i, q in enumerate(CATALOGUE_QUESTIONS)]
    return sorted(canned + list(_REGISTERED.values()), key=lambda e: e.intent_id)


def dated() -> list[int]:
    """Numbers of the entries that need a date."""
    return [e.intent_id for e in entries() if "date" in e.params]


def catalogue_df(spark: SparkSession) -> DataFrame:
    """(intent_id int, question string, needs_date boolean); the 33 rows and the registered ones."""
    rows = [(e.intent_id, e.question, "date" in e.params) for e in entries()]
    return spark.createDataFrame(rows, "intent_id int, question string, needs_date boolean")
