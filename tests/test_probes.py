"""Cases that once gave wrong answers or failed."""

import math

from pyspark.sql import functions as F

from tests.conftest import make_readings
from tremolo.operators import catalogue as cat
from tremolo.operators import chats as ch
from tremolo.plans.answers import lookback_answers
from tremolo.sources.readings import clean_readings

TURNS = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_look_back_beyond_the_calendar_takes_all_data(spark):
    r = make_readings(spark, [(1, "2023-01-08 00:00:00", 20.0, None),
                              (2, "2023-12-23 00:00:00", 1.0, None)])
    q = spark.createDataFrame([("M1", 2_000_000_000, None), ("M1", 1, None)],
                              "machine_id string, months int, level string")
    assert {x.months: x.days for x in lookback_answers(q, r).collect()} == {2_000_000_000: 2, 1: 1}
    assert cat.recent_months_days(r, 2_000_000_000).collect()[0].days == 2


def test_nan_is_missing(spark):
    r = make_readings(spark, [(1, "2023-01-08 00:00:00", 1.0, "GREEN"),
                              (2, "2023-01-08 00:01:00", math.nan, "GREEN"),
                              (3, "2023-01-08 00:02:00", 5.0, "GREEN")])
    got = cat.value_summary(r).collect()[0]
    assert (got.min_value, got.max_value, got.mean_value) == (1.0, 5.0, 3.0)
    raw = spark.createDataFrame([(1, "2023-01-08 00:00:00", "NaN"), (2, "2023-01-08 00:01:00", "2")],
                                "id long, t string, v string")
    kept = clean_readings(raw.withColumn("m", F.lit("M1")), ts="t", value="v", machine="m",
                          reading_id="id")
    assert [x.value for x in kept.collect()] == [2.0]


def test_renames(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b"), (3, 0, "user", "c")],
                                  TURNS)
    names = "old_id long, new_id long"
    absent = ch.rename_sessions(turns, spark.createDataFrame([(9, 1)], names))
    assert rows_of(absent.select("conv_id", "text")) == [(1, "a"), (2, "b"), (3, "c")]
    both = ch.rename_sessions(turns, spark.createDataFrame([(1, 3), (2, 3)], names))
    assert rows_of(both.select("conv_id", "text")) == [(3, "b")]
    swap = ch.rename_sessions(turns, spark.createDataFrame([(1, 2), (2, 1)], names))
    assert rows_of(swap.select("conv_id", "text")) == [(1, "b"), (2, "a"), (3, "c")]


def test_new_session_of_text_ids(spark):
    ids = spark.createDataFrame([("Sohbet 1",), ("Sohbet 12",), ("notes",)], "conv_id string")
    assert ch.new_session_id(ids).collect()[0].conv_id == 13


def test_pairs_with_gaps_between_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 2, "assistant", "b"),
                                   (1, 1023, "user", "c"), (1, 5000, "assistant", "d"),
                                   (1, 5001, "user", "e")], TURNS)
    got = rows_of(ch.pairs(turns).select("turn", "message", "reply").where("reply IS NOT NULL"))
    assert got == [(0, "a", "b"), (1023, "c", "d")]


def test_every_session_is_listed(spark):
    ids = spark.range(100).select(F.col("id").alias("conv_id"))
    assert ch.list_sessions(ids).count() == 100 and ch.list_sessions(ids, 3).count() == 3


def test_zero_counts_are_rows(spark):
    r = make_readings(spark, [(1, "2023-01-08 00:00:00", 1.0, "GREEN")]).unionByName(
        make_readings(spark, [(2, "2024-03-08 00:00:00", 20.0, "RED")], machine="M2"))
    for src in (r, cat.prepare(r)):
        assert rows_of(cat.level_count_between(src, "2024-01-01", "2024-12-31")) == [
            ("M1", 0), ("M2", 1)]
        assert rows_of(cat.level_duration(src, "GREEN").select("machine_id", "minutes")) == [
            ("M1", 1), ("M2", 0)]
        assert rows_of(cat.months_with_level_count(src, "RED")) == [("M1", 0), ("M2", 1)]


def test_catalogue_year_is_that_of_the_data(spark):
    from tremolo.plans.answers import catalogue_answers
    r = make_readings(spark, [(1, "1997-01-08 00:00:00", 12.0, None),
                              (2, "1998-03-08 00:00:00", 12.5, None)])
    got = {x.intent_id: x.answer for x in catalogue_answers(r).collect()}
    assert got[4] == "0" and got[10] == "1998-03-08" and got[11] == "12.50 / 12.50 / 12.50"


def test_top_k_in_chunks_equals_a_full_sort(spark, monkeypatch):
    import numpy as np

    from tremolo.operators import vectors as vec
    rng = np.random.default_rng(3)
    q, c = rng.integers(-2, 3, (37, 4)).astype(float), rng.integers(-2, 3, (211, 4)).astype(float)
    ids = np.arange(211)
    want = [(i, int(j), float(q[i] @ c[j])) for i in range(37)
            for j in sorted(ids, key=lambda j: (-(q[i] @ c[j]), j))[:5]]
    monkeypatch.setattr(vec, "SCORE_CELLS", 256 * 10)
    got = vec._topk_rows(np.arange(37), q, ids, c, 5, False)
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(want)


def test_trees_are_sampled_by_one_rule_at_every_size(spark):
    from tremolo.operators.anomaly import sample_trees
    for n in (10, 400, 60_000):
        v = spark.range(n).select(F.col("id").alias("reading_id"),
                                  F.col("id").cast("double").alias("value"))
        sizes = {r.tree: r.n for r in sample_trees(v, n).groupBy("tree").agg(
            F.count("*").alias("n"), F.count_distinct("value").alias("d")).collect()}
        assert sizes == {t: min(n, 256) for t in range(100)}
        # different trees see different rows, and all parts of the table
        if n == 60_000:
            seen = sample_trees(v, n).select("value").distinct()
            assert seen.count() > 18_000
            assert abs(seen.agg(F.avg("value")).first()[0] - n / 2) < n / 50
