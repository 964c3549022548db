"""The ordered change log against a dict that is changed row by row."""
import random

from tremolo.operators import chat_log, ordered
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string"
LOG = "seq long, conv_id long, action string, text string, reply string, new_id long"


def _fold(turns, sessions, log):
    state = {c: [] for c in sessions}
    for c, turn, role, text in sorted(turns, key=lambda x: (x[0] is None, x[0] or 0, x[1])):
        state.setdefault(c, []).append((turn, role, text))
    for seq, c, action, text, reply, new in sorted(log, key=lambda x: x[0] or 0):
        if seq is None or c is None:
            continue
        if action in ("new", "append"):
            had = state.setdefault(c, [])
            if action == "append":
                k = max((t for t, _, _ in had), default=-1) + 1
                had += [(k, "user", text), (k + 1, "assistant", reply)]
        elif action == "clear" and c in state:
            state[c] = []
        elif action == "delete":
            state.pop(c, None)
        elif action == "rename" and c in state and new is not None and new != c:
            state[new] = state.pop(c)
    return sorted(state, key=str), sorted(((c, *t) for c, had in state.items() for t in had), key=str)


def _both(spark, turns, sessions, log):
    s, t = chat_log.apply_log(spark.createDataFrame(turns, TURNS),
                              spark.createDataFrame([(c,) for c in sessions], "conv_id long"),
                              spark.createDataFrame(log, LOG))
    return sorted([x.conv_id for x in s.collect()], key=str), sorted([tuple(x) for x in t.collect()], key=str)


def test_random_logs_equal_the_fold(spark):
    for seed, names, n in ((1, 3, 40), (2, 6, 60), (3, 30, 60), (4, 4, 0)):
        r = random.Random(seed)
        turns = [(c, k * r.choice([1, 1, 3]), r.choice(["user", "assistant"]), f"{c}.{k}")
                 for c in range(0, names, 2) for k in range(r.randrange(4))]
        turns = list({x[:2]: x for x in turns}.values())
        log = [(10 * k, r.randrange(names), r.choice(["append", "append", "new", "clear", "delete", "rename",
                                                      "rename", "rename"]), f"m{k}", r.choice([f"r{k}", None]),
                r.randrange(names)) for k in range(n)]
        r.shuffle(log)
        assert _both(spark, turns, [0, 1], log) == _fold(turns, [0, 1], log), seed


def test_long_rename_chains(spark):
    """A chain of 40 renames, forwards and onto names in use, resolved in a few rounds."""
    log = [(k, k, "rename", None, None, k + 1) for k in range(40)]
    log += [(100 + k, 60 - k, "rename", None, None, 59 - k) for k in range(15)]
    turns = [(0, 0, "user", "first"), (50, 0, "user", "lost"), (60, 0, "user", "moves back")]
    assert _both(spark, turns, [], log) == _fold(turns, [], log)
    backwards = [(40 - k, k, "rename", None, None, k + 1) for k in range(40)]
    assert _both(spark, turns, [], backwards) == _fold(turns, [], backwards)


def test_rows_that_do_nothing_and_null_ids(spark):
    turns = [(None, 0, "user", "kept"), (1, 0, "user", "a")]
    log = [(None, 1, "delete", None, None, None), (1, None, "delete", None, None, None),
           (2, 1, "explode", None, None, None), (3, 1, "rename", None, None, None),
           (4, 1, "rename", None, None, 1), (5, 9, "clear", None, None, None), (6, 9, "rename", None, None, 1),
           (7, 8, "append", None, None, None)]
    s, t = _both(spark, turns, [2, None], log)
    assert s == ["1", "2", "8", "None"] or s == [1, 2, 8, None]
    assert t == sorted([(None, 0, "user", "kept"), (1, 0, "user", "a"), (8, 0, "user", None),
                        (8, 1, "assistant", None)], key=str)


def test_ranks_and_last_known_in_range_partitions(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 11).alias("k"), "id")
    df = df.unionByName(spark.range(50).select(F.lit(None).cast("long").alias("k"), (F.col("id") + 9000).alias("id")))
    rows = df.collect()
    want, last = {}, {}
    for k in {x.k for x in rows}:
        for place, i in enumerate(sorted(x.id for x in rows if x.k == k)):
            want[i] = place
    got = ordered.ranks(df, "k", ("id",), "place", partitions=17).collect()
    assert {x.id: x.place for x in got} == want
    value = F.when(F.col("id") % 10 == 0, F.col("id"))
    for before in (False, True):
        for k in {x.k for x in rows}:
            seen = None
            for i in sorted(x.id for x in rows if x.k == k):
                now = i if i % 10 == 0 else seen
                last[i], seen = (seen if before else now), now
        got = ordered.last_known(df, "k", ("id",), value, "v", before, partitions=17).collect()
        assert {x.id: x.v for x in got} == last
