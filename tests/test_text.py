import datetime as dt

import pytest
from pyspark.sql import functions as F

from tremolo.functions import text as T

D = dt.date


@pytest.mark.parametrize("q,expected,compat", [
    ("15/02/2023 tarihinde değer aralığı", D(2023, 2, 15), False),
    ("15.02.2023 günü", D(2023, 2, 15), False),
    ("15-02-2023", D(2023, 2, 15), False),
    ("2023-02-15", D(2023, 2, 15), False),
    ("2023-02-03", D(2023, 2, 3), False),
    ("2023-02-03", D(2023, 3, 2), True),
    ("2023-02-15", D(2023, 2, 15), True),
    ("31/02/2023", None, False),
    ("15 Şubat 2023 tarihinde", D(2023, 2, 15), False),
    ("15 ŞUBAT 2023", D(2023, 2, 15), False),
    ("3 KASIM 2023", D(2023, 11, 3), False),
    ("February 15, 2023", D(2023, 2, 15), False),
    ("February 2023", D(2023, 2, 1), False),
    ("15 February 2023", D(2023, 2, 15), False),
    ("geçen hafta", None, False),
    ("2023/02.15", D(2023, 2, 15), False),          # separators may differ
    ("sıra 120-02-2023", D(2023, 2, 20), False),    # two digits before the month count
    ("5-2-2023", None, False),                      # one digit is no numeric day
    ("5  Mart\t2023", D(2023, 3, 5), False),
    ("115 Mart 2023", D(2023, 3, 15), False),
    ("15 Mart23", None, False),
    ("march 7,2023", D(2023, 3, 7), False),
    ("7 march 9, 2023", D(2023, 3, 7), False),      # the day in front wins
    ("marchy 2023", None, False),
    ("31/02/2023 ve 15 Şubat 2023", None, False),   # the first kind that matches decides
])
def test_extract_date(spark, q, expected, compat):
    df = spark.createDataFrame([(q,)], "q string")
    assert df.select(T.extract_date("q", compat).alias("d")).first().d == expected


def test_intents_and_lookback(spark):
    rows = [
        ("Son 4 ayda turuncu alarm seviyesinin görüldüğü aylar hangileri?", "recent_months", "ORANGE", 4, None),
        ("Son üç ay içinde kaç gün veri var", "recent_months", None, 3, None),
        ("SON ON AYDA KIRMIZI", "recent_months", "RED", 10, None),
        ("Makine kaç ay boyunca KIRMIZI durum gösterdi", "months_count", "RED", None, None),
        ("Geçen yıl hangi aylarda makine kırmızı alarm verdi?", "months_list", "RED", None, None),
        ("Mart ayında arıza oldu mu?", "month_fault", "RED", None, 3),
        ("Makinenin performansını ne etkileyebilir?", None, None, None, None),
        ("son 12 aylık", "recent_months", None, 12, None),
        ("son onbir ay", None, None, None, None),
        ("kaç ay boyunca yeşilimsi", None, None, None, None),     # a whole colour word is asked for
        ("hangi  aylarda sarı", None, None, None, None),           # one space between these two
        ("KASIM  AYINDA hiç ARIZA", "month_fault", "RED", None, 11),
        ("arıza mart ayında", None, None, None, None),             # the order counts
        ("son 99999999999 ay", None, None, None, None),            # too large a number
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "q string")
    got = [tuple(x.p) for x in df.select(T.parse_intents("q").alias("p")).collect()]
    assert got == [r[1:] for r in rows]


def test_normalize_terms_and_gate(spark):
    df = spark.createDataFrame([("makine",), ("Makine",), ("makinenin",), ("makinesi",),
                                ("RTF makine",), ("hava nasıl",)], "q string")
    out = df.select(T.normalize_terms("q").alias("n"), T.in_domain("q").alias("g")).collect()
    assert [r.n for r in out] == ["RTF makinesi", "RTF makinesi", "RTF makinesinin", "makinesi",
                                  "RTF RTF makinesi", "hava nasıl"]
    assert [r.g for r in out] == [True, True, False, False, True, False]


def test_level_in_text_order(spark):
    df = spark.createDataFrame([("kırmızı ve sarı",), ("YEŞİL",), ("mavi",)], "q string")
    assert [r.l for r in df.select(T.level_in_text("q").alias("l")).collect()] == \
        ["YELLOW", "GREEN", None]


def test_row_text(spark):
    df = spark.createDataFrame([(D(2023, 1, 2), "Red", 15.0)], "d date, l string, v double")
    assert df.select(T.row_text(F.col("d"), F.col("l"), F.col("v"))).first()[0] == \
        "Tarih: 2023-01-02, Durum: Red, Değer: 15.00"
