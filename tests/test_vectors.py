import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from tremolo.functions import vectors as fv
from tremolo.operators import vector_cells as cells
from tremolo.operators import vectors as vec


def _brute(ids, mat, k, exclude_self):
    out = {}
    s = mat @ mat.T
    for a, qi in enumerate(ids):
        cand = [(-s[a, b], ids[b]) for b in range(len(ids)) if not (exclude_self and a == b)]
        out[qi] = [c for _, c in sorted(cand)[:k]]
    return out


def test_knn_paths_equal_brute_force(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet").orderBy("vec_id").limit(300)
    rows = e.collect()
    ids = [r.vec_id for r in rows]
    mat = np.array([r.embedding for r in rows], dtype=np.float64)
    want = _brute(ids, mat, 4, True)
    for kwargs in ({}, {"max_broadcast_bytes": 0, "block_rows": 70}):
        h = vec.knn(e, e, 4, exclude_self=True, **kwargs).collect()
        got = {}
        for r in sorted(h, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append(r.corpus_id)
        assert got == want, kwargs


def test_knn_ties_and_zero_vector(spark):
    df = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])],
        "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(10, [1.0, 0.0])], "vec_id long, embedding array<double>")
    for kwargs in ({}, {"max_broadcast_bytes": 0, "block_rows": 1}):
        got = [(r.rank, r.corpus_id) for r in
               vec.knn(q, df, 3, **kwargs).orderBy("rank").collect()]
        assert got == [(1, 1), (2, 2), (3, 3)]  # tie on 1.0 -> smaller id; 0.0 tie -> 3 before 4
    z = df.select(fv.l2_normalize("embedding").alias("n")).collect()
    assert z[3].n == [0.0, 0.0]


def test_catalogue_topk_matches_numpy(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    cen = vec.centroids(e)
    c_rows = cen.orderBy("label").collect()
    cmat = np.array([r.centroid for r in c_rows])
    t = vec.catalogue_topk(e.select("vec_id", "embedding"), cen, 3).collect()
    emb = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in e.collect()}
    for r in t[:200]:
        scores = cmat @ emb[r.vec_id]
        order = sorted(range(len(scores)), key=lambda i: (-scores[i], c_rows[i].label))
        assert c_rows[order[r.rank - 1]].label == r.label
        assert abs(scores[order[r.rank - 1]] - r.score) < 1e-9


def test_catalogue_topk_cases(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cat = rng.integers(-2, 3, (300, 4)).astype(float)
    qs = rng.integers(-2, 3, (40, 4)).astype(float)
    catalogue = spark.createDataFrame([(f"c{i:03}", v.tolist()) for i, v in enumerate(cat)],
                                      "label string, centroid array<double>")
    rows = [(i, v.tolist(), "own") for i, v in enumerate(qs)] + [(99, None, "own")]
    q = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    monkeypatch.setattr(vec, "SCORE_CELLS", 700)
    got = {(r.vec_id, r.rank): (r.label, r.score) for r in vec.catalogue_topk(q, catalogue).collect()}
    want = {}
    for i, v in enumerate(qs):
        order = sorted(range(300), key=lambda j: (-(cat[j] @ v), j))[:3]
        want.update({(i, n + 1): (f"c{j:03}", cat[j] @ v) for n, j in enumerate(order)})
    assert got == want  # ties by id; the null vector has no rows; a clashing column is replaced
    assert vec.catalogue_topk(q, catalogue.limit(0)).count() == 0
    assert vec.catalogue_topk(q.limit(0), catalogue).count() == 0
    assert {r.rank for r in vec.catalogue_topk(q, catalogue.limit(2)).collect()} == {1, 2}


def _unusable():
    nan, inf = float("nan"), float("inf")
    return [(901, None), (902, [1.0, None]), (903, [nan, 1.0]), (904, [inf, 1.0]), (905, [1.0]),
            (906, [1.0, 2.0, 3.0]), (907, [])]


def test_unusable_vectors_are_left_out(spark):
    good = [(k, [float(k % 5), float(k % 7)]) for k in range(60)]
    df = spark.createDataFrame(good + _unusable(), "vec_id long, embedding array<double>")
    want = {(r.query_id, r.rank): (r.corpus_id, r.score) for r in vec.knn(
        *[spark.createDataFrame(good, df.schema)] * 2, 3).collect()}
    assert len(want) == 180
    for kwargs in ({}, {"max_broadcast_bytes": 0, "block_rows": 9}):
        got = {(r.query_id, r.rank): (r.corpus_id, r.score) for r in vec.knn(df, df, 3, **kwargs).collect()}
        assert got == want
    cat = df.withColumnRenamed("vec_id", "label").withColumnRenamed("embedding", "centroid")
    got = {(r.vec_id, r.rank): (r.label, r.score) for r in vec.catalogue_topk(df, cat, 3).collect()}
    assert got == want
    empty = df.where("vec_id > 900")
    assert vec.knn(df, empty.where("vec_id < 905"), 3).count() == 0
    assert cells.knn_cells(df, df.limit(0)).count() == 0 and cells.knn_cells(df.limit(0), df).count() == 0


def _clustered(n, seed, dims=32, groups=40):
    g = np.random.default_rng(seed)
    centre = g.normal(size=(groups, dims))
    x = centre[g.integers(0, groups, n)] + 0.05 * g.normal(size=(n, dims))
    x[: n // 3] = centre[0] + 0.05 * g.normal(size=(n // 3, dims))  # a hot cell
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_cells_are_exact_and_skip_most_pairs(spark):
    x = _clustered(3000, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    got = cells.knn_cells(df, df, 5, exclude_self=True, cells=60, block_rows=300, report=report).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    best = np.sort(s, axis=1)[:, ::-1][:, :5]
    found = {(r.query_id, r.rank): r.score for r in got}
    assert len(found) == 15_000
    assert all(abs(found[i, k + 1] - best[i, k]) < 1e-9 for i in range(3000) for k in range(5))
    assert all(abs(s[r.query_id, r.corpus_id] - r.score) < 1e-9 for r in got)
    assert report["pairs"] == 9_000_000 and report["scored"] < 0.3 * report["pairs"]


def test_cells_of_any_vectors_equal_brute_force(spark):
    """Small integers: exact scores, many ties, zero vectors, negative and long ones."""
    g = np.random.default_rng(7)
    x = g.integers(-3, 4, (400, 3)).astype(float) * g.choice([0, 1, 1, 20], 400)[:, None]
    q = g.integers(-3, 4, (70, 3)).astype(float)
    schema = "vec_id long, embedding array<double>"
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], schema)
    xs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], schema)
    for k, n in ((1, 5), (6, 30), (500, 4)):
        want = {}
        for i, v in enumerate(q):
            order = sorted(range(400), key=lambda j: (-(x[j] @ v), j))[:k]
            want.update({(i, r + 1): (j, x[j] @ v) for r, j in enumerate(order)})
        got = cells.knn_cells(qs, xs, k, cells=n, block_rows=50).collect()
        assert {(r.query_id, r.rank): (r.corpus_id, r.score) for r in got} == want


def test_a_catalogue_of_any_size(spark):
    """Above the bound the entries are searched in cells: ties, text ids, clashes and cosine as below it."""
    g = np.random.default_rng(5)
    cat = spark.createDataFrame([(f"c{i:03}", v.astype(float).tolist()) for i, v in enumerate(
        g.integers(-3, 4, (200, 3)))] + [("c999", None)], "label string, centroid array<double>")
    q = spark.createDataFrame([(i, v.astype(float).tolist(), "own") for i, v in enumerate(
        g.integers(-3, 4, (50, 3)))] + [(77, None, "own")], "vec_id long, embedding array<double>, score string")
    for cosine in (False, True):
        found = [{(x.vec_id, x.rank): (None if cosine else x.label, round(x.score, 9)) for x in vec.catalogue_topk(
            q, cat, 4, max_rows=most, cosine=cosine).collect()} for most in (10_000, 20)]
        assert found[0] == found[1] and len(found[0]) >= 190


def test_a_query_is_sent_once_to_a_block(spark, monkeypatch):
    """Where no cell can be skipped a query goes to each block of cells, not to each cell."""
    g = np.random.default_rng(11)
    x = g.normal(size=(900, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    sent = []
    deal = cells._deal
    monkeypatch.setattr(cells, "_deal", lambda q, *rest: (sent.append(q.count()), deal(q, *rest))[1])
    report = {}
    got = cells.knn_cells(df, df, 3, exclude_self=True, cells=30, block_rows=300, report=report).collect()
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    want = np.argsort(-s, axis=1, kind="stable")[:, :3]
    assert {(r.query_id, r.rank): r.corpus_id for r in got} == {
        (i, n + 1): want[i, n] for i in range(900) for n in range(3)}
    assert report["scored"] > 0.5 * report["pairs"]  # hardly a cell is skipped
    assert len(sent) == 2 and max(sent) <= 5 * 900  # blocks, not 30 cells


def test_best_of_chunks_of_any_scale():
    """Lengths far apart, equal vectors, repeated ids, a floor: as scored one by one."""
    g = np.random.default_rng(13)
    c = np.round(g.normal(size=(5000, 6)), 1) * 10.0 ** g.integers(-12, 13, 5000)[:, None]
    c[4000:4500] = c[:500]
    q = np.round(g.normal(size=(300, 6)), 1) * 10.0 ** g.integers(-12, 13, 300)[:, None]
    q[7] = 0
    c_ids, q_ids = g.permutation(5000) // 2, np.arange(300) // 2
    exact = np.einsum("ij,kj->ik", q, c)
    floor = np.where(np.arange(300) % 3 == 0, np.quantile(exact, 0.999, axis=1), -np.inf)
    best = vec.Best(q_ids, q, 4, True, floor.copy())
    for lo in range(0, 5000, 1700):
        best.see(c_ids[lo:lo + 1700], c[lo:lo + 1700])
    rows = np.concatenate([h[0] for h in best.held])
    _, ids, scores = best.found()
    for i in range(300):
        one = np.array([np.einsum("ij,ij->i", q[i:i + 1], c[j:j + 1])[0] for j in range(5000)]) if i < 12 else exact[i]
        fit = np.flatnonzero((c_ids != q_ids[i]) & (one >= floor[i]))
        order = fit[np.lexsort((c_ids[fit], -one[fit]))][:4]
        assert np.allclose(scores[rows == i], one[order], rtol=1e-9)
        if i < 12:
            assert ids[rows == i].tolist() == c_ids[order].tolist()
