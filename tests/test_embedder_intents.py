"""The embedder surface as router input, and intents that a user registers."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import make_readings
from tremolo.plans import answers as ans
from tremolo.plans import embedder, intents
from tremolo.plans import routing as rt

LOAD, NAME = embedder.hashed_trigrams(64), "test-trigrams-64"


def test_vectors_and_one_load_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        model = LOAD()

        def few(texts):
            assert len(texts) <= 3
            return model(texts)
        return few

    texts = ["merhaba dünya", None, "", "ab", "merhaba dünya", "makine"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(7)
    got = {}
    for _ in range(2):
        got = {x.i: x.vector for x in embedder.embed(df, "t", load, f"log-{tmp_path}", batch=3).collect()}
    want = LOAD()([t or "" for t in texts])
    for i, t in enumerate(texts):
        assert got[i] is None if t is None else np.array_equal(got[i], want[i])
    with open(log) as f:
        loads = f.read().split()
    assert len(loads) == len(set(loads))  # no worker loaded twice


def test_an_embedder_must_return_a_row_per_text(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)
    with pytest.raises(Exception, match="a row per text"):
        embedder.embed(df, "t", lambda: (lambda texts: np.zeros((1, 4))), "wrong").collect()


def test_router_takes_vectors(spark):
    q = spark.createDataFrame([(1, "Tüm kırmızı günleri listele"), (2, "xyzzy"), (3, "2023 yılında makine performansı"),
                               (4, "ab"), (5, None)], "i long, q string")
    asked = embedder.embed_questions(q, "q", LOAD, NAME)
    got = {x.i: x for x in rt.route_questions(asked, ["i"], "q", vector="vector", catalogue_vectors=(
        embedder.catalogue_vectors(spark, LOAD, NAME))).collect()}
    assert got[1].status == "matched" and got[1].intent_id == 32 and abs(got[1].score - 1) < 1e-9
    assert got[3].intent_id == 11
    assert got[4].status == got[5].status == "not_found" and got[4].score is None
    # the same, each distinct text embedded once by the router
    again = rt.route_questions(q, ["i"], "q", vector=lambda t, text, out: embedder.embed_questions(
        t, text, LOAD, NAME, out), catalogue_vectors=embedder.catalogue_vectors(spark, LOAD, NAME))
    assert {x.i: x for x in again.collect()} == got
    # any vectors will do: here the questions' own are swapped
    swapped = asked.withColumn("vector", F.when(F.col("i") != 1, F.col("vector")))
    assert {x.i: x.status for x in rt.route_questions(swapped, ["i"], "q", vector="vector", catalogue_vectors=(
        embedder.catalogue_vectors(spark, LOAD, NAME))).collect()}[1] == "not_found"


@pytest.fixture()
def extra_intents(spark):
    def count(readings):
        return readings.groupBy("machine_id").agg(F.count("*").cast("string").alias("answer"))

    def of_day(readings):
        return readings.groupBy("machine_id", "date").agg(F.concat(
            F.count("*").cast("string"), F.lit(" ölçüm")).alias("answer"))
    intents.register_intent(33, "Toplam kaç ölçüm kaydı tutuldu?", count)
    intents.register_intent(40, "… gününde toplam kaç ölçüm kaydı tutuldu acaba?", of_day, ("date",))
    yield
    intents.unregister_intent(33)
    intents.unregister_intent(40)


def test_a_registered_intent_is_routed_and_answered(spark, extra_intents):
    readings = make_readings(spark, [
        (1, "2023-02-15 10:00:00", 1.0, None), (2, "2023-02-15 11:00:00", 20.0, None),
        (3, "2023-03-01 10:00:00", 5.0, None)])
    q = spark.createDataFrame([(1, "Toplam kaç ölçüm kaydı tutuldu?"),
                               (2, "15-02-2023 gününde toplam kaç ölçüm kaydı tutuldu acaba?"),
                               (3, "… gününde toplam kaç ölçüm kaydı tutuldu acaba?"),
                               (4, "Tüm kırmızı günleri listele"),
                               (5, "16-02-2023 gününde toplam kaç ölçüm kaydı tutuldu acaba?")], "i long, q string")
    routed = rt.route_questions(q, ["i"], "q").withColumn("machine_id", F.lit("M1"))
    got = {x.i: (x.status, x.intent_id, x.answer, x.error) for x in ans.answer_questions(routed, readings).collect()}
    assert got == {1: ("matched", 33, "3", None), 2: ("matched", 40, "2 ölçüm", None),
                   3: ("needs_date", 40, None, None), 4: ("matched", 32, "2023-02-15", None),
                   5: ("matched", 40, None, "no reading on that date")}
    assert intents.catalogue_df(spark).count() == 35 and intents.dated() == [7, 8, 9, 40]
    suggested = rt.route_questions(q.where("i = 1"), ["i"], "q", threshold=1.01).first()
    assert suggested.suggestions[0] == "Toplam kaç ölçüm kaydı tutuldu?"


def test_wrong_registrations_are_refused(extra_intents):
    ok = lambda r: r
    for args, error in (((33, "x", ok), ValueError), ((5, "x", ok), ValueError), ((50, " ", ok), ValueError),
                        ((50, "x", ok, ("month",)), ValueError), ((50, "x", lambda: 1), TypeError),
                        ((50, "x", lambda a, b: 1), TypeError)):
        with pytest.raises(error):
            intents.register_intent(*args)
    assert {e.intent_id for e in intents.entries()} == {*range(33), 33, 40}
