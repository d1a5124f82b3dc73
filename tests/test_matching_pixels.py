import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import matching, pixels, runs, search


def test_components_and_distance():
    r = np.random.default_rng(0)
    m = r.random((17, 23)) < 0.55
    seen, label = np.zeros(m.shape, int), 0
    for y, x in np.argwhere(m):
        if not seen[y, x]:
            label += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 17 and 0 <= b < 23 and m[a, b] and not seen[a, b]:
                    seen[a, b] = label
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert (pixels.labelled(m) == seen).all()
    d = pixels.distances(m)
    off = np.argwhere(~np.pad(m, 1)) - 1
    for y, x in np.argwhere(m)[:40]:
        assert d[y, x] == np.abs(off - (y, x)).max(1).min()


def test_kernels():
    a = np.zeros((20, 20))
    a[:, 10:] = 200
    e = pixels.edges(pixels.blurred(a, 1), 50, 100)
    assert e[:, 8:12].any(1).all() and not e[:, :7].any() and pixels.correlation(a, a) == pytest.approx(1)
    assert pixels.resized(a, 10).shape == (10, 10) and pixels.bilateral(a, 2, 20, 2)[5, 9] < 20
    white = pixels.lab(np.array([[[255.0, 255.0, 255.0]]]))[0, 0]
    assert white == pytest.approx([100, 0, 0], abs=0.01)
    assert pixels.eroded(pixels.dilated(a > 0, 1), 1).sum() == (a > 0).sum()


def test_page_segments(spark):
    a = np.full((8, 8), 255, np.uint8)
    a[1:3, 1:4], a[5:7, 6] = 0, 0
    df = spark.createDataFrame([(1, 8, 8, a.tobytes())], "id long, width int, height int, pixels binary")
    assert sorted((r.x, r.y, r.w, r.h, r.area) for r in pixels.segments(df).collect()) == [(1, 1, 3, 2, 6), (6, 5, 1, 2, 2)]
    assert pixels.page_features(df).first().mean_luminance == pytest.approx(255 * 56 / 64)


def test_landmarks(spark):
    lm = spark.createDataFrame([("a", "Total", 0.5, 0.5), ("b", "Balance", 0.1, 0.1)], "landmark_id string, text string, x double, y double")
    tk = spark.createDataFrame([("d", "TOTAL", 0.9, 0.9), ("d", "total:", 0.5, 0.6), ("d", "Balence", 0.1, 0.2), ("d", "x", 0.1, 0.1)], "doc_id string, text string, x double, y double")
    assert {(r.landmark_id, r.text) for r in matching.landmark_matches(lm, tk).collect()} == {("a", "total:"), ("b", "Balence")}


def test_static_choice(spark):
    rows = [(1, i, s, c, True, 0.5, 0) for i, s, c in ((1, 0.9, False), (2, 0.8, True), (3, 0.7, False))]
    df = spark.createDataFrame(rows, "f int, id int, total_score double, is_current boolean, fp_ok boolean, distance_score double, line_diff int")
    r = matching.pick_static(df, ["f"], 1, 0.5).first()
    assert (r.best_id, r.current_id, r.prefer_best) == (1, 2, True)
    s, c = matching.field_bias(F.lit("customer_name"), F.lit("12 MAIN STREET"))
    assert spark.range(1).select(s, c).first()[:] == (0.6, 0.65)


def test_migration_runs_once(spark, tmp_path):
    a, b = (spark.createDataFrame([(k, v)], "k int, v string") for k, v in ((1, "x"), (2, "y")))
    assert runs.migrate(spark, a, b, ["k"], str(tmp_path)) and not runs.migrate(spark, b, a, ["k"], str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/data").count() == 2


def test_sessions(spark):
    added = spark.createDataFrame([("s", "d1", "a", 1), ("s", "d2", "b", 2), ("s", "d1", "c", 4)], "session_id string, document_id string, summary string, seq int")
    removed = spark.createDataFrame([("s", "d1", 3), ("s", "d2", 5)], "session_id string, document_id string, seq int")
    assert [(r.document_id, r.summary) for r in runs.session_documents(added, removed).collect()] == [("d1", "c")]


def test_fuzzy_matches_equal_brute_force(spark):
    """Pairs within the edit ratio, edits at both ends included."""
    import random

    r = random.Random(3)
    base = ["abcdefghij", "invoice", "total", "ninewordsab", "ab", "a", "wxyz"]
    edited = lambda t: "".join(r.choice("abcxyz") if r.random() < 0.2 else c for c in t if r.random() > 0.1) + r.choice(["", "x"])
    left = ["xbcdefghix", "xinewordsax", *(edited(r.choice(base)) for _ in range(200)), "", *base]
    right = [*base, *(edited(r.choice(base)) for _ in range(60))]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, before = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[j] + 1, before[j + 1] + 1, before[j] + (x != y)))
        return row[-1]

    for most in (0.0, 0.3, 0.45):
        got = search.within_edits(spark.createDataFrame([(x,) for x in left], "a string"), spark.createDataFrame([(x,) for x in right], "b string"), most)
        want = {(a, b) for a in set(left) for b in set(right) if a and b and distance(a, b) <= most * max(len(a), len(b)) + 1e-12}
        assert {(x.a, x.b) for x in got.collect()} == want and len(want) > 5
    assert {("xbcdefghix", "abcdefghij"), ("xinewordsax", "ninewordsab")} <= {(a, b) for a in left for b in right if a and b and distance(a, b) <= 0.3 * max(len(a), len(b))}


def test_phrases_of_any_length(spark):
    words = [f"w{i}ord" for i in range(14)]
    t = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate(words)] + [(1, 1, 0, "ab"), (1, 1, 1, "xabcx")], "doc_id int, line int, place int, text string")
    q = spark.createDataFrame([("nine", " ".join(words[2:11])), ("all", " ".join(words)), ("more", " ".join(words) + " x"), ("two", "ab c"), ("none", "--")], "query_id string, query string")
    got = {(r.query_id, r.line, r.place, r.n_tokens) for r in search.phrase_candidates(t, q, ["doc_id"]).collect()}
    squash = lambda s: s.replace(" ", "")
    singles = {(q, 0, i, 1) for q, p in (("nine", words[2:11]), ("all", words), ("more", [*words, "x"])) for i, w in enumerate(words) if w in squash(" ".join(p))}
    assert got == {("nine", 0, 2, 9), ("all", 0, 0, 14), ("two", 1, 0, 1), ("two", 1, 0, 2), ("two", 1, 1, 1)} | singles
    assert "NestedLoop" not in search.phrase_candidates(t, q, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
