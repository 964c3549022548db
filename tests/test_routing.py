import datetime as dt

from pyspark.sql import functions as F

from tremolo.plans import answers as ans
from tremolo.plans import routing as rt

from conftest import make_readings


#: phrasings of our own, by the entry that they mean
PARAPHRASES = {
    1: ["Geçmişte sarı alarm seviyesi en çok hangi tarihlerde görüldü?", "Sarı alarm seviyesinde en çok hangi tarihlerde görüldü acaba?"],
    2: ["Geçmişte kırmızı alarm seviyesi en çok hangi tarihlerde oldu?", "En çok hangi tarihlerde kırmızı alarm seviyesinde görüldü?"],
    3: ["Performanstaki dalgalanmalar hakkında bilgi verir misin?"],
    5: ["Makine hangi değerde sarı alarma geçer?"],
    6: ["Makine hangi değerde kırmızı alarma geçer?"],
    10: ["2023 aralığında turuncu alarm seviyesinde çalıştığı tarihler neler?"],
    11: ["Makinenin 2023 yılındaki performansı nasıldı?"],
    12: ["Makine son bir yıl içinde hangi günlerde tamamen durmuş?"],
    19: ["Yeşilden kırmızıya direkt geçiş yapan günler hangileridir?"],
    20: ["Renk değişimlerinin en düzenli olduğu tarihler hangisi?"],
    23: ["Renk değişimlerinin yoğun olduğu dönemler hangileri?"],
    24: ["Hangi tarihlerde arıza oranı en düşük?"],
    25: ["Hangi ayda en fazla performans değişikliği oldu?"],
    26: ["Yılların ortalama performansı nedir?"],
    27: ["Kaç kez yeşilden kırmızıya geçiş yapıldı?"],
    30: ["Makine için iyileştirme önerileri nelerdir?"],
    31: ["Performansı ne etkileyebilir?"],
    32: ["Bütün kırmızı günleri listele"],
}


def test_paraphrases_route_to_their_catalogue_entry(spark):
    rows = [(i, k, q) for i, qs in PARAPHRASES.items() for k, q in enumerate(qs)]
    q = spark.createDataFrame(rows, "want int, k int, question string")
    got = rt.route_questions(q, ["want", "k"], "question").collect()
    assert sum(x.intent_id == x.want for x in got) >= 0.95 * len(rows)
    # "son üç ayda ..." questions take the look-back pattern before the catalogue
    back = spark.createDataFrame([(1, "Son üç ayda sarı alarm seviyesinde kaç gün çalıştı?")], "i int, q string")
    assert rt.route_questions(back, ["i"], "q").first().status == "pattern"


def test_route_and_answer_small_table(spark):
    readings = make_readings(spark, [
        (1, "2023-02-15 10:00:00", 1.0, None), (2, "2023-02-15 11:00:00", 20.0, None),
        (3, "2023-03-01 10:00:00", 5.0, None)]).withColumn("machine_id", F.lit("RTF"))
    qs = spark.createDataFrame([
        (1, "15/02/2023 tarihinde RTF makinesinin değer aralığı neydi?"),
        (2, "… tarihinde RTF makinesinin değer aralığı neydi?"),
        (3, "Son 1 ayda kırmızı alarm seviyesinde kaç gün çalıştı?"),
        (4, "Tüm kırmızı günleri listele"),
        (5, "Hava bugün nasıl olacak acaba?")], "qid long, text string")
    routed = rt.route_questions(qs, ["qid"], "text").withColumn("machine_id", F.lit("RTF"))
    got = {x.qid: (x.status, x.answer) for x in ans.answer_questions(routed, readings).collect()}
    assert got[1] == ("matched", "1.00 - 20.00")
    assert got[2][0] == "needs_date" and got[2][1] is None
    assert got[3] == ("pattern", "1")          # cutoff 2023-02-01 10:00; red on 02-15
    assert got[4] == ("matched", str(dt.date(2023, 2, 15)))
    assert got[5][0] == "not_found"


def test_dated_question_without_readings_that_day(spark):
    readings = make_readings(spark, [(1, "2023-02-15 10:00:00", 1.0, None)]).withColumn(
        "machine_id", F.lit("RTF"))
    qs = spark.createDataFrame([(1, "20/02/2023 tarihinde RTF makinesinin değer aralığı neydi?"),
                                (2, "15.02.2023 tarihinde RTF makinesinin renk seviyesi neydi?")],
                               "qid long, text string")
    routed = rt.route_questions(qs, ["qid"], "text").withColumn("machine_id", F.lit("RTF"))
    got = {x.qid: (x.status, x.intent_id, x.answer)
           for x in ans.answer_questions(routed, readings).collect()}
    assert got[1] == ("matched", 7, None)
    assert got[2] == ("matched", 8, "GREEN")


def test_every_order_question_reaches_the_context_stage(spark):
    from conftest import SF001
    from tremolo.registry import QUERIES
    got = QUERIES["route_orders_with_context"](spark, SF001).toPandas()
    assert len(got) == spark.read.parquet(f"{SF001}/orders.parquet").count()
    still = got.status.isin(rt.OPEN)
    assert 10 < still.sum() < len(got)
    assert got.prompt.notna().equals(still) and got.context.notna().equals(still)
