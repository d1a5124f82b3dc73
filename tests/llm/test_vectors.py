import numpy as np
from pyspark.sql import functions as F

from foliant.llm import ann, kdtree

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def rows(x, ids, bad=True):
    out = [(int(i), [float(c) for c in v], "r", "s") for i, v in zip(ids, x)]
    if bad:
        out += [(100, [1.0], "", "")][: x.shape[1] > 1]  # the only vector of its length
        out += [(20, None, "", ""), (40, [float("nan")] * x.shape[1], "", ""), (60, [float("inf")] * x.shape[1], "", ""), (80, [None] * x.shape[1], "", ""), (None, [1.0] * x.shape[1], "", "")]
    return out


def data(n, d, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n // 2 : n // 2 + n // 4] = x[0]  # a quarter of all vectors are one
    return x, np.arange(1000, 1000 + n)


def brute(x, ids, chosen, k):
    e = x @ x.T
    for i in np.flatnonzero(chosen):
        s = e[i].copy()
        s[ids == ids[i]] = -np.inf
        order = [j for j in np.lexsort((ids, -s)) if s[j] > -np.inf][:k]
        yield int(ids[i]), [(r + 1, int(ids[j]), s[j]) for r, j in enumerate(order)]


def answers(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return found


def test_ann_recall_and_ties(spark):
    x, ids = data(1500, 16)
    got = answers(ann.search(spark.createDataFrame(rows(x, ids), SCHEMA), F.col("vec_id") % 20 == 0, 20, shard=400, group=30, depth=60))
    hits = total = 0
    for q, want in brute(x.astype(float), ids, ids % 20 == 0, 20):
        assert [r for r, _, _ in got[q]] == list(range(1, 21))
        hits += len({v for _, v, _ in want} & {v for _, v, _ in got[q]})
        total += 20
        for r, v, s in got[q]:
            assert abs(s - x[q - 1000].astype(float) @ x[v - 1000].astype(float)) < 1e-12
    assert hits / total >= 0.9


def test_ann_small_and_empty(spark):
    x, ids = data(3, 3)
    got = answers(ann.search(spark.createDataFrame(rows(x, ids), SCHEMA), F.col("vec_id") == 1000, 20))
    assert [v for _, v, _ in got[1000]] and len(got[1000]) == 2
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0
    zero = spark.createDataFrame([(20, [0.0, 0.0], "", ""), (21, [1.0, 0.0], "", "")], SCHEMA)
    assert ann.search(zero).count() == 0


def test_kd_tree_is_exact(spark):
    x, ids = data(1200, 8, 1)
    v = np.floor(256 * x.astype(float))
    got = answers(kdtree.search(spark.createDataFrame(rows(x, ids), SCHEMA), F.col("vec_id") % 50 == 0, 5, shard=200, group=10))
    want = {q: [(r, i, int(s)) for r, i, s in a] for q, a in brute(v, ids, ids % 50 == 0, 5)}
    assert got == want


def test_kd_tree_prunes_and_handles_large(spark):
    r = np.random.default_rng(2)
    x, ids = np.floor(256 * r.normal(size=(20000, 3))), np.arange(20000)
    tree, seen = kdtree.grown(x / 256, ids, ids), []
    trees = [tree | {"v": tree["x"] * 256}]
    q = x[7]
    top = kdtree.nearest(q, 7, trees, [256 * (np.maximum(q, 0) @ t["high"].T + np.minimum(q, 0) @ t["low"].T) for t in trees], 5, seen)
    s = x @ q
    s[7] = -1e18
    assert [-i for _, i, _ in top] == np.lexsort((ids, -s))[:5].tolist() and sum(seen) < 10000
    big = spark.createDataFrame([(0, [1e12, 1.0], "", ""), (1, [1e12, 2.0], "", ""), (2, [-1e12, 0.0], "", "")], SCHEMA)
    got = answers(kdtree.search(big, F.col("vec_id") == 0, 5))
    assert [v for _, v, _ in got[0]] == [1, 2] and got[0][0][2] == 2**63 - 1
    assert kdtree.search(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_and_lengths(spark):
    """Every row with a repeated vec_id is answered by itself and is a candidate for its twin; lengths are searched apart."""
    r = np.random.default_rng(4)
    x = r.normal(size=(40, 4)).astype(np.float32)
    ids = [0, 0, 0, 20, 20, *range(101, 136)]
    table = spark.createDataFrame(rows(x, ids, False) + [(50, [1.0, 2.0], "", ""), (60, [3.0, 1.0], "", ""), (0, [1.0, 1.0], "", "")], SCHEMA)
    for search, k, measure in ((ann.search, 6, lambda v: v.astype(float)), (kdtree.search, 5, lambda v: np.floor(256 * v.astype(float)))):
        got = sorted((q.query_id, q["rank"], q.vec_id, round(float(q.score), 6)) for q in search(table, F.col("vec_id").isin(0, 20, 50), k).collect())
        want = []
        for group, own in ((x, ids), (np.array([[1, 2], [3, 1], [1, 1]], np.float32), [50, 60, 0])):
            e = measure(group) @ measure(group).T
            for i, q in enumerate(own):
                if q in (0, 20, 50):
                    order = [j for j in sorted(range(len(own)), key=lambda j: (-e[i, j], own[j])) if j != i][:k]
                    want += [(q, n + 1, own[j], round(float(e[i, j]), 6)) for n, j in enumerate(order)]
        assert got == sorted(want)


def test_ann_recall_at_the_defaults(spark):
    """A full default shard, a third of it one vector: the copies may not fill the depth."""
    x, _ = data(ann.SHARD, 32, 9)
    x[: ann.SHARD // 3] = x[ann.SHARD // 2] * 0.9
    ids = np.arange(len(x))
    got = answers(ann.search(spark.createDataFrame(rows(x, ids, False), SCHEMA), F.col("vec_id") % 400 == 0, 20))
    hits = total = 0
    e = x.astype(float)
    for q in np.flatnonzero(ids % 400 == 0):
        s = e @ e[q]
        s[q] = -np.inf
        want = np.lexsort((ids, -s))[:20]
        hits += len(set(want.tolist()) & {v for _, v, _ in got[q]})
        total += 20
    assert hits / total >= 0.95


def test_plans_move_candidates_once(spark):
    x, ids = data(300, 4)
    table = spark.createDataFrame(rows(x, ids, False), SCHEMA)
    for search in (ann.search, kdtree.search):
        plan = search(table, F.col("vec_id") % 20 == 0, 5)._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" not in plan and "Generate" not in plan
