"""Tables of many rows on one page: results as of all pairs, without forming them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import matching, spatial


def points(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    return [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 200, (n, 2)) / 200)]


def test_nearest_landmarks_are_found_without_all_pairs_of_a_circle(spark):
    """1,200 points, 40 of them in one place and two alone; brute force agrees, and pairs stay near k a point."""
    p = points(spark, 1160) + [(1, 1160 + i, 0.5, 0.5) for i in range(40)] + [(1, 2000, 5.0, 5.0), (1, 2001, 5.1, 5.0)]
    df = spark.createDataFrame(p, "page int, id int, x double, y double")
    got = {}
    for r in matching.context(df, df, ["page"], 0.4, 5).collect():
        got.setdefault(r.field_id, []).append((r.distance, r.id))
    xy, ids = np.array([q[2:] for q in p]), np.array([q[1] for q in p])
    for i, (x, y) in zip(ids, xy):
        d = np.sqrt((xy[:, 0] - x) ** 2 + (xy[:, 1] - y) ** 2)
        assert sorted(got[i]) == sorted(zip(d[d <= 0.4].tolist(), ids[d <= 0.4].tolist()))[:5], i
    at = df.withColumns({"__px": F.col("x"), "__py": F.col("y")})
    assert spatial.nearest_pairs(at, at, ["page"], 5, 0.4).count() < 20 * len(p)


def test_profiles_count_edges_as_a_list_would(spark):
    """loops, equal ends, an id with three ends, a null id, a node without edges, against sets."""
    rng = np.random.default_rng(3)
    nodes = sorted({(1 + int(c) % 2, int(c), int(n)) for c, n in rng.integers(0, 9, (60, 2))} | {(1, 50, 99)})
    edges = [(1 + int(k) % 2, int(i), int(a), int(b), "uv"[int(k) % 2]) for i, (a, b, k) in enumerate(rng.integers(0, 9, (80, 3)))] + [(1, 3, 1, 2, "u"), (1, 3, 7, 8, "u"), (1, None, 1, 4, "u"), (1, None, 4, 5, "u")]
    from foliant.operators import layout

    p = layout.graph_profiles(spark.createDataFrame(nodes + nodes[:5], "page int, candidate int, node int"), spark.createDataFrame(edges, "page int, edge_id int, source_id int, target_id int, edge_type string"), ["page"])
    got = {(r.page, r.candidate): (r.node_count, r.edge_count, r.edge_types or {}) for r in p.collect()}
    for key in {n[:2] for n in nodes}:
        mine = {n[2] for n in nodes if n[:2] == key}
        hit = {(e[1], e[4]) for e in edges if e[0] == key[0] and mine & {e[2], e[3]}}
        shares = {t: sum(h[1] == t for h in hit) / len(hit) for t in {h[1] for h in hit}}
        assert got.pop(key) == (len(mine), len(hit), pytest.approx(shares)), key
    assert not got


def test_siblings_are_no_more_than_are_looked_at(spark):
    """300 lines in one group; tendencies as of all siblings."""
    from foliant.operators import layout

    rng = np.random.default_rng(4)
    lines = spark.createDataFrame([(1, i, float(x), float(y), 30.0, 12.0, i % 2) for i, (x, y) in enumerate(rng.integers(0, 60, (300, 2)))], "page int, id int, x double, y double, w double, h double, b int")
    few = layout.first_siblings(lines, ["page"], "b")
    every = lines.join(lines.select("page", F.col("id").alias("line_id"), "b"), ["page", "b"])
    assert few.count() <= 11 * 300 < every.count()
    assert sorted(layout.tendencies(lines, few, ["page"]).collect()) == sorted(layout.tendencies(lines, every, ["page"]).collect())


def test_equal_landmarks_and_tokens_are_compared_once(spark):
    """F8: 300 equal landmarks and 300 equal tokens; each landmark has one row a document, the nearest of the closest texts."""
    marks = spark.createDataFrame([(i, "total", 0.5, 0.5) for i in range(300)] + [(900, "total", 0.0, 0.0)], "landmark_id int, text string, x double, y double")
    tokens = spark.createDataFrame([(1, "total", 0.4, 0.5)] * 300 + [(1, "total", 0.1, 0.0), (1, "totol", 0.5, 0.5), (2, "totol", 0.9, 0.9), (2, "tatol", 0.8, 0.8), (2, "tatel", 0.5, 0.5)], "doc_id int, text string, x double, y double")
    got = {(r.landmark_id, r.doc_id): (r.text, r.x) for r in matching.landmark_matches(marks, tokens).collect()}
    assert len(got) == 602 and got[7, 1] == ("total", 0.4) and got[900, 1] == ("total", 0.1) and got[7, 2] == ("totol", 0.9)


def grid_boxes(spark, n, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(p), i, float(x), float(y), 0.02 + i % 3 / 100, 0.02 + i % 5 / 100) for i, (p, x, y) in enumerate(zip(rng.integers(0, 2, n), rng.integers(0, 100, n) / 100, rng.integers(0, 100, n) / 100))]
    return rows, spark.createDataFrame(rows, "page int, id int, x double, y double, w double, h double")


def shared(p, q):
    return max(0.0, min(p[2] + p[4], q[2] + q[4]) - max(p[2], q[2])) * max(0.0, min(p[3] + p[5], q[3] + q[5]) - max(p[3], q[3]))


@pytest.mark.parametrize("n", [60, 500])
def test_overlapping_boxes_are_joined_without_all_pairs(spark, n):
    """sparse and dense pages against a plain union of all overlapping pairs."""
    from foliant.operators import components

    rows, df = grid_boxes(spark, n, 5)
    root = {r[1]: r[1] for r in rows}
    for p in rows:
        for q in rows:
            if p[1] < q[1] and p[0] == q[0] and shared(p, q) > 0 and root[p[1]] != root[q[1]]:
                low, high = sorted((root[p[1]], root[q[1]]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {r.id: r.component for r in components.overlapping(df, ["page"], 0.1, 0.02).collect()} == root


def test_boxes_are_assigned_in_rounds_as_one_fold_does(spark):
    """no group of more than 50 pairs is folded; many equal scores."""
    from foliant.operators import folds

    rows, df = grid_boxes(spark, 160, 6)
    moved = df.withColumn("x", F.col("x") + 0.01)
    other = [(*r[:2], r[2] + 0.01, *r[3:]) for r in rows]
    pairs = sorted((-np.floor(shared(p, q) * 1e9 + 0.5) / 1e9, p[1], q[1], p[0]) for p in rows for q in other if p[0] == q[0] and np.floor(shared(p, q) * 1e9 + 0.5) > 0)
    want, a, b = set(), set(), set()
    for s, i, j, page in pairs:
        if i not in a and j not in b:
            a.add(i), b.add(j), want.add((page, i, j, -s))
    assert {tuple(r) for r in folds.assign_boxes(df, moved, ["page"], 0.1, 50).collect()} == want
