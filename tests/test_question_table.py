"""The derived question table: every routing outcome occurs, with hand-worked cases."""

import datetime as dt

from conftest import SF001
from tremolo.plans import routing as rt
from tremolo.plans.question_table import order_questions

QS = "qid long, text string"


def test_every_outcome_occurs(spark):
    q = order_questions(spark.read.parquet(f"{SF001}/orders.parquet"))
    assert q.where("question IS NULL").count() == 0
    r = rt.route_questions(q, ["o_orderkey"], "question").cache()
    assert r.count() == q.count()
    status = {x[0] for x in r.select("status").distinct().collect()}
    assert status == {"pattern", "matched", "needs_date", "suggest", "not_found"}
    kinds = {x[0] for x in r.where("status = 'pattern'").select("kind").distinct().collect()}
    assert kinds == {"months_count", "months_list", "month_fault", "recent_months"}
    assert r.where("status = 'matched' AND needs_date").count() > 0
    gated = rt.route_questions(q, ["o_orderkey"], "question", threshold=0.40, gate=True)
    assert {"off_topic", "matched", "pattern"} <= {
        x[0] for x in gated.select("status").distinct().collect()}


def test_hand_worked_routes(spark):
    qs = spark.createDataFrame([
        (1, "Makine kaç ay boyunca kırmızı seviyede kaldı?"),
        (2, "Ekim ayında makinede arıza oldu mu?"),
        (3, "SON DOKUZ AYDA kaç gün veri var?"),
        (4, "3 Kasım 1996 tarihinde RTF makinesinin renk seviyesi neydi?"),
        (5, "March 4, 1997 tarihinde RTF makinesinin renk seviyesi neydi?"),
        (6, "March 1997 tarihinde RTF makinesinin renk seviyesi neydi?"),
        (7, "… tarihinde RTF makinesinin renk seviyesi neydi?"),
        (8, "What is the capital of France?"), (9, None), (10, "")], QS)
    got = {x.qid: x for x in rt.route_questions(qs, ["qid"], "text").collect()}
    assert (got[1].kind, got[1].level) == ("months_count", "RED")
    assert (got[2].kind, got[2].month_no) == ("month_fault", 10)
    assert (got[3].kind, got[3].months, got[3].level) == ("recent_months", 9, None)
    for qid, date in ((4, dt.date(1996, 11, 3)), (5, dt.date(1997, 3, 4)), (6, dt.date(1997, 3, 1))):
        assert (got[qid].status, got[qid].intent_id, got[qid].date) == ("matched", 8, date)
    assert got[7].status == "needs_date"
    assert [got[i].status for i in (8, 9, 10)] == ["not_found"] * 3


def test_gate_reads_the_question_as_asked(spark):
    qs = spark.createDataFrame([(1, "makinenin rengi nedir"), (2, "makine rengi nedir"),
                                (3, "Titreşim arttı mı?"), (4, None)], QS)
    got = {x.qid: x.status for x in rt.route_questions(
        qs, ["qid"], "text", threshold=0.40, gate=True).collect()}
    assert got[1] == "off_topic" and got[4] == "off_topic"
    assert got[2] != "off_topic" and got[3] != "off_topic"


def test_texts_are_not_shuffle_keys(spark):
    q = order_questions(spark.read.parquet(f"{SF001}/orders.parquet"))
    plan = rt.route_questions(q, ["o_orderkey"], "question")._jdf.queryExecution().executedPlan()
    keys = [ln for ln in plan.toString().splitlines() if "Exchange hashpartitioning" in ln]
    assert keys and not any("_match" in ln.split("hashpartitioning")[1].split(")")[0] for ln in keys)
