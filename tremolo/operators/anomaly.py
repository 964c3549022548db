"""Anomaly detection on one feature (the value) with an isolation forest, in Spark.

The reference fits ``IsolationForest(contamination=0.01, random_state=42)`` on the
values of a date range and labels the 1 % most isolated readings. Its random stream
cannot be reproduced, so the same method (Liu, Ting and Zhou, 2008) is rebuilt to be
deterministic and independent of partitioning:

* sampling: a candidate pool is drawn by a hash of ``reading_id`` (no shuffle, no
  global sort); tree ``t`` takes the 256 pool rows with the smallest hash of
  (reading_id, t, seed);
* fitting: one ``applyInPandas`` group per tree (256 values each) grows a 1-D
  isolation tree with a numpy generator seeded by (seed, t); with one feature a tree
  is a set of value intervals, each with its path length ``depth + c(leaf size)``;
* scoring: the leaves of all trees are merged into one step function of the value (trees x leaves
  steps at most), with s = 2 ** (-mean path / c(256)) per step; a value's score is one binary search;
* cut: a reading is anomalous when its score is strictly above the nearest-rank
  (1 - contamination) quantile of the scores, so at most ``contamination`` of the rows
  are flagged. The quantile is exact, from the readings counted per score.

Once the forest is grown the readings are read twice: for those counts, and for the result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

N_TREES = 100
SAMPLE = 256
SEED = 42
CONTAMINATION = 0.01
CANDIDATES = 1.5  # expected candidates of a tree, in samples
EULER = 0.5772156649015329


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful search in a binary search tree of n."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _unit_hash(*cols) -> F.Column:
    """Deterministic value in [0, 1) from a hash of the columns."""
    h = F.xxhash64(*cols)
    return F.pmod(h, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def sample_trees(values: DataFrame, n_rows: int, n_trees: int = N_TREES,
                 sample: int = SAMPLE, seed: int = SEED,
                 candidates: float = CANDIDATES) -> DataFrame:
    """(tree, value) with min(sample, n_rows) rows per tree.

    Every reading is a candidate of every tree with the same chance p, independently and at any
    table size; of a tree's candidates the ``sample`` with the smallest hash are taken. The
    first tree that a reading is a candidate of is drawn by one hash (a geometric step over
    the tree numbers), and only readings that have one are tested for the trees after it:
    the cost is a hash per reading plus the hits. p makes ``candidates`` x sample candidates
    per tree on average; a tree may fall short by chance, which :func:`fit_forest` reports."""
    p = 1.0 if n_rows == 0 else min(1.0, candidates * sample / n_rows)
    u = _unit_hash(F.col("reading_id"), F.lit(seed))
    first = F.lit(0) if p >= 1 else F.floor(F.log1p(-u) / F.lit(math.log1p(-p)))
    hit = values.select("reading_id", "value", first.cast("long").alias("first")).where(
        F.col("first") < n_trees).withColumn("first", F.col("first").cast("int"))
    cand = hit.select("reading_id", "value", "first", F.explode(
        F.sequence("first", F.lit(n_trees - 1))).alias("tree")).where(
        (F.col("tree") == F.col("first"))
        | (_unit_hash(F.col("reading_id"), F.col("tree"), F.lit(seed)) < p))
    rank = Window.partitionBy("tree").orderBy(
        F.xxhash64("reading_id", "tree", F.lit(seed + 1)), "reading_id")
    return (cand.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= sample)
            .select("tree", "value"))


def _grow(values: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Leaves of a 1-D isolation tree as (lower, upper, path_length) over the real line."""
    leaves = []
    stack = [(values, -np.inf, np.inf, 0)]
    while stack:
        v, lo, hi, d = stack.pop()
        vmin, vmax = (v.min(), v.max()) if len(v) else (0.0, 0.0)
        if d >= max_depth or len(v) <= 1 or vmin == vmax:
            leaves.append((lo, hi, d + float(c_factor([len(v)])[0])))
            continue
        split = rng.uniform(vmin, vmax)
        stack.append((v[v < split], lo, split, d + 1))
        stack.append((v[v >= split], split, hi, d + 1))
    return leaves


FOREST_SCHEMA = "tree int, lower double, upper double, path double, n_rows int"


def fit_forest(samples: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """One grouped-map task per tree -> leaf intervals (tree, lower, upper, path), each with the
    number of rows that its tree was grown from."""
    max_depth = int(math.ceil(math.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        vals = np.sort(pdf["value"].to_numpy(np.float64))
        rng = np.random.default_rng([seed, t])
        leaves = _grow(vals, rng, max_depth)
        return pd.DataFrame({"tree": t, "lower": [x[0] for x in leaves],
                             "upper": [x[1] for x in leaves], "path": [x[2] for x in leaves],
                             "n_rows": np.int32(len(vals))})

    return samples.groupBy("tree").applyInPandas(grow, FOREST_SCHEMA)


def step_function(forest_rows, sample_size: int) -> tuple[np.ndarray, np.ndarray]:
    """(breaks, scores): the whole forest as one step function of the value.

    The leaves of all trees are merged: between two neighbouring breaks a value falls into the same leaf of
    every tree, so it has one score. ``scores[i]`` holds for values from ``breaks[i - 1]`` to below
    ``breaks[i]``. At most trees x leaves steps, whatever the readings."""
    trees: dict[int, list] = {}
    for r in forest_rows:
        trees.setdefault(r.tree, []).append((r.lower, r.path))
    breaks = np.unique([r.lower for r in forest_rows if np.isfinite(r.lower)])
    total = np.zeros(len(breaks) + 1)
    starts = np.concatenate(([-np.inf], breaks))
    for t in sorted(trees):
        lower, path = np.array(sorted(trees[t])).T
        total += path[np.searchsorted(lower, starts, side="right") - 1]
    norm = float(c_factor([sample_size])[0]) or 1.0
    return breaks, np.power(2.0, -(total / max(len(trees), 1)) / norm)


def score_column(breaks: np.ndarray, scores: np.ndarray, spark):
    """A pandas UDF value -> anomaly score: one binary search among the steps, which every
    task carries (at most trees x leaves of them)."""
    bc = spark.sparkContext.broadcast((breaks, scores))

    @pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        at, value = bc.value
        return pd.Series(value[np.searchsorted(at, v.to_numpy(np.float64), side="right")])

    return score


def nearest_rank_quantile(scores: DataFrame, q: float, col: str = "score") -> float | None:
    """Exact nearest-rank quantile of a column with few distinct values (a score per step): one
    aggregation, whose rows are those values."""
    counts = sorted((r[col], r["count"]) for r in scores.groupBy(col).count().collect())
    rank = max(1, math.ceil(q * sum(n for _, n in counts)))
    seen = 0
    for value, n in counts:
        seen += n
        if seen >= rank:
            return float(value)
    return None


def anomaly_points(readings: DataFrame, start: str | None = None, end: str | None = None, *,
                   contamination: float = CONTAMINATION, n_trees: int = N_TREES,
                   sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """AN1 / AN2 / PF12: readings of the range with score, label (-1 anomaly, 1 normal)
    and chart colour. The range is [start 00:00, end 23:59:59] as in the reference."""
    r = readings
    if start is not None:
        r = r.where(F.col("ts") >= F.to_timestamp_ntz(F.lit(start)))
    if end is not None:
        r = r.where(F.col("ts") <= F.to_timestamp_ntz(F.lit(end)) + F.expr(
            "INTERVAL 1 DAY") - F.expr("INTERVAL 1 SECOND"))
    r = r.where(F.col("value").isNotNull())
    n = r.count()
    spark = readings.sparkSession
    psi = min(sample, n)
    candidates = CANDIDATES
    while True:  # once, unless a tree got too few candidates by chance
        samples = sample_trees(r.select("reading_id", "value"), n, n_trees, sample, seed, candidates)
        forest = fit_forest(samples, psi, seed).collect()  # at most trees x sample rows
        if {x.tree for x in forest if x.n_rows == psi} == set(range(n_trees)) or n == 0:
            break
        candidates *= 2
    scored = r.withColumn("score", score_column(*step_function(forest, psi), spark)(F.col("value")))
    threshold = nearest_rank_quantile(scored.select("score"), 1.0 - contamination)
    cut = F.lit(threshold if threshold is not None else 2.0)
    label = F.when(F.col("score") > cut, F.lit(-1)).otherwise(F.lit(1))
    return (scored.withColumn("anomaly", label)
            .withColumn("color", F.when(F.col("anomaly") == -1, F.lit("red"))
                        .otherwise(F.lit("blue"))))


def anomaly_daily(points: DataFrame) -> DataFrame:
    """AN3: per date, readings and anomalies."""
    return points.groupBy("date").agg(F.count(F.lit(1)).alias("n"),
                                      F.count_if(F.col("anomaly") == -1).alias("anomalies"))
