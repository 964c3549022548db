import random

from pyspark.sql import functions as F

from conftest import SF01, make_readings
from tremolo.operators import anomaly as an
from tremolo.operators import ranges as rg
from tremolo.sources.readings import events_readings


def _labels(df):
    return {r.reading_id: (r.anomaly, round(r.score, 12)) for r in
            df.select("reading_id", "anomaly", "score").collect()}


def test_forest_properties(spark):
    rnd = random.Random(1)
    rows = [(i, f"2023-03-{1 + i // 1440:02d} {(i // 60) % 24:02d}:{i % 60:02d}:00",
             round(rnd.gauss(3.0, 0.5), 2), None) for i in range(3000)]
    for j, v in enumerate([80.0, 95.0, 120.0]):   # planted far outliers
        rows.append((10_000 + j, "2023-03-02 12:00:30", v, None))
    r = make_readings(spark, rows)
    p = an.anomaly_points(r)
    lab = _labels(p)
    flagged = [k for k, (a, _) in lab.items() if a == -1]
    assert len(flagged) <= 0.01 * len(lab)
    assert {10_000, 10_001, 10_002} <= set(flagged)
    # score depends on the value only
    by_value = {}
    for row in p.select("value", "score").collect():
        by_value.setdefault(row.value, set()).add(round(row.score, 12))
    assert all(len(s) == 1 for s in by_value.values())
    # same labels whatever the partitioning
    assert _labels(an.anomaly_points(r.repartition(7))) == lab
    assert sorted(x.color for x in p.where("anomaly = -1").select("color").distinct().collect()) \
        == ["red"]


def test_constant_column_has_no_anomalies(spark):
    rows = [(i, f"2023-03-01 00:{i // 60:02d}:{i % 60:02d}", 5.0, None) for i in range(500)]
    p = an.anomaly_points(make_readings(spark, rows))
    assert p.where("anomaly = -1").count() == 0


def test_anomaly_on_events_range(spark):
    ev = events_readings(spark, SF01)
    p = an.anomaly_points(ev, "2024-01-05", "2024-01-10")
    n = ev.where((F.col("ts") >= "2024-01-05") & (F.col("ts") <= "2024-01-10 23:59:59")).count()
    assert p.count() == n
    assert p.where("anomaly = -1").count() <= 0.01 * n
    d = an.anomaly_daily(p).collect()
    assert sum(x.n for x in d) == n


def test_range_requests_statuses_and_last_second(spark):
    rows = [(1, "2023-02-01 10:00:00", 1.0, None), (2, "2023-02-03 23:59:59", 1.0, None),
            (3, "2023-02-03 23:59:59.500", 1.0, None), (4, "2023-02-05 00:00:00", 1.0, None)]
    r = make_readings(spark, rows)
    req = spark.createDataFrame([
        (1, "2023-02-01", "2023-02-03"), (2, "2023/02/01", "2023-02-03"),
        (3, "2023-02-04", "2023-02-01"), (4, "2023-01-01", "2023-02-03"),
        (5, "2023-02-04", "2023-02-04"), (6, "2023-02-02", "2023-02-05"),
        (7, "2023-02-31", "2023-03-01")], "request_id long, start string, end string")
    got = {x.request_id: (x.status, x.n_readings) for x in rg.range_requests(req, r).collect()}
    assert got == {1: ("ok", 2),          # the reading 0.5 s after 23:59:59 is lost
                   2: ("bad_format", None), 3: ("start_after_end", None),
                   4: ("out_of_bounds", None), 5: ("no_data", None), 6: ("ok", 3),
                   7: ("bad_format", None)}


def test_nearest_rank_quantile_is_exact(spark):
    import math

    import numpy as np
    rng = np.random.default_rng(5)
    vals = np.round(rng.beta(2, 5, size=5000), 3)   # many ties, some buckets crowded
    df = spark.createDataFrame([(float(v),) for v in vals], "score double")
    for q in (0.5, 0.9, 0.99, 1.0):
        want = float(np.sort(vals)[max(1, math.ceil(q * len(vals))) - 1])
        assert an.nearest_rank_quantile(df, q) == want
    assert an.nearest_rank_quantile(df.limit(0), 0.5) is None


def test_step_function_equals_the_trees(spark):
    """Scores of the merged steps are those of walking every tree, on and beside the breaks."""
    from types import SimpleNamespace

    import numpy as np
    rng = np.random.default_rng(3)
    forest, trees = [], []
    for t in range(30):
        leaves = an._grow(np.sort(np.round(rng.normal(3, 1, 64), 1)), np.random.default_rng([1, t]), 6)
        trees.append(leaves)
        forest += [SimpleNamespace(tree=t, lower=lo, path=p) for lo, _, p in leaves]
    breaks, scores = an.step_function(forest, 64)
    assert len(scores) == len(breaks) + 1 <= 30 * 64
    values = np.concatenate((breaks, np.nextafter(breaks, -np.inf), [-1e9, 1e9, 0.0]))
    norm = float(an.c_factor([64])[0])
    for v in values:
        paths = [p for leaves in trees for lo, up, p in leaves if lo <= v < up]
        assert len(paths) == 30
        got = scores[np.searchsorted(breaks, v, side="right")]
        assert abs(got - 2.0 ** (-np.mean(paths) / norm)) < 1e-12
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    udf = an.score_column(breaks, scores, spark)
    assert df.select(udf("value").alias("s")).distinct().count() <= len(scores)


def test_range_requests_equal_counting(spark):
    """Random requests, many at the same dates, against counting readings one by one."""
    import datetime as dt
    rnd = random.Random(4)
    days = [dt.date(2023, 2, 1) + dt.timedelta(days=k) for k in range(40)]
    rows = [(i, f"{rnd.choice(days[5:30])} {rnd.choice(['00:00:00', '12:30:00', '23:59:59', '23:59:59.9'])}", 1.0, None)
            for i in range(300)]
    r = make_readings(spark, rows)
    req = [(k % 50 if k % 7 else None, str(rnd.choice(days)), str(rnd.choice(days[:6] if k % 3 else days)))
           for k in range(400)] + [(1, None, "2023-02-01"), (2, "x", None)]
    times = [dt.datetime.fromisoformat(x[1]) for x in rows]

    def one(q):
        if q[1] is None or q[2] is None:
            return (*q, "bad_format", None)
        s, e = dt.datetime.fromisoformat(q[1]), dt.datetime.fromisoformat(q[2] + " 23:59:59")
        n = sum(s <= t <= e for t in times)
        return (*q, "start_after_end", None) if s.date() > e.date() else (*q, *(("ok", n) if n else ("no_data", None)))
    df = spark.createDataFrame(req, "request_id long, start string, end string")
    got = rg.range_requests(df, r, "2023-01-01", "2024-01-01")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(one(q)) for q in req)
    assert rg.range_requests(df.limit(0), r).count() == 0
    assert {x.status for x in rg.range_requests(df, r.limit(0), "2023-01-01", "2024-01-01").collect()} == {
        "bad_format", "start_after_end", "no_data"}
