import pytest
from pyspark.sql import functions as F

from foliant.operators import components, folds, learn, search, spatial

TOK = "page int, id int, text string, x double, y double, w double, h double"


def test_box_text(spark):
    rows = [("176", 10, 10, 24, 8), ("RAYMOND", 38, 10, 60, 8), ("L", 102, 10, 5, 8), ("ARNPRIOR", 10, 24, 70, 8), ("ONTARIO", 84, 24, 60, 8), ("K7S", 10, 38, 20, 8), ("3G8", 34, 38, 20, 8)]
    t = spark.createDataFrame([(1, i, n, *map(float, b)) for i, (n, *b) in enumerate(rows)], TOK)
    box = spark.createDataFrame([(1, 0, "", 5.0, 5.0, 160.0, 45.0), (1, 1, "", 500.0, 500.0, 10.0, 10.0)], TOK)
    got = spatial.box_text(spatial.tokens_in_boxes(t, box, ["page"], "vertical"), ["page"]).collect()
    assert [(r.box_id, r.text, r.hits) for r in got] == [(0, "176 RAYMOND L ARNPRIOR ONTARIO K7S 3G8", 7)]
    lines = folds.group_lines(t, ["page"]).groupBy("line").agg(F.count("*").alias("n")).orderBy("line").collect()
    assert [r.n for r in lines] == [3, 2, 2]


def test_annotations(spark):
    s = "record int, id int, x double, y double, w double, h double"
    humans = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5, 0.5), (1, 1, 0.6, 0.6, 0.3, 0.3)], s)
    autos = spark.createDataFrame([(1, 0, 0.02, 0.02, 0.48, 0.48), (1, 1, 0.3, 0.3, 0.1, 0.1)], s)
    m = spatial.iou_best(humans, autos, ["record"])
    assert {r.id: r.auto_id for r in m.collect()} == {0: 0, 1: None}
    assert [r.id for r in spatial.extras(autos, m, ["record"]).collect()] == [1]


def test_constellation(spark):
    rows = [("Total", 80, 100), ("Subtotal", 60, 120), ("HST", 100, 80), ("Balance", 20, 150), ("Account", 5, 175)]
    t = spark.createDataFrame([(1, i, n, float(x), float(y), 10.0, 10.0) for i, (n, x, y) in enumerate(rows)], TOK)
    p = spark.createDataFrame([("p", "anchor", 0, "total", 0.0, 0.0), ("p", "support", 1, "subtotal", -20.0, 20.0), ("p", "support", 2, "hst", 20.0, -20.0), ("p", "support", 3, "balance", -60.0, 50.0), ("p", "support", 4, "account", 0.0, 0.0)], "pattern_id string, role string, idx int, norm_text string, dx double, dy double")
    (r,) = spatial.constellation(t, p, ["page"], 5.0).collect()
    assert (r.matched, r.supports, r.anchor_id, r.total_error) == (3, 4, 0, 0.0)


def test_greedy_and_suppression(spark):
    p = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.8), (1, 2, 1, 0.7), (1, 2, 2, 0.1)], "g int, a int, b int, s double")
    assert {(r.a, r.b) for r in folds.assign_greedy(p, ["g"], "a", "b", "s").collect()} == {(1, 1), (2, 2)}
    b = spark.createDataFrame([(1, 0, 0.0, 0.0, 2.0, 2.0, 0.9), (1, 1, 0.1, 0.0, 2.0, 2.0, 0.8), (1, 2, 5.0, 5.0, 1.0, 1.0, 0.1)], "page int, id int, x double, y double, w double, h double, score double")
    assert {r.id for r in folds.suppress(b, ["page"]).collect()} == {0, 2}


def test_affine(spark):
    pts = [(float(x), float(y)) for x in range(4) for y in range(3)]
    rows = [(1, x, y, 2 * x - y + 3, x + 4 * y - 1, 1.0) for x, y in pts]
    df = spark.createDataFrame(rows, "k int, x double, y double, u double, v double, weight double")
    r = learn.affine(df, ["k"]).first()
    assert [r[c] for c in ("a", "b", "tx", "c", "d", "ty")] == pytest.approx([2, -1, 3, 1, 4, -1])
    bad = df.unionByName(spark.createDataFrame([(1, 1.0, 1.0, 100.0, -100.0, 1.0)], df.schema))
    q = folds.robust_affine(bad, ["k"]).first()
    assert [q[c] for c in ("a", "b", "tx")] == pytest.approx([2, -1, 3]) and q.dropped == 1


def test_components(spark):
    n = spark.range(8).withColumnRenamed("id", "node")
    e = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (6, 7), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in components.components(n, e).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}


def test_layout_learning(spark):
    e = spark.createDataFrame([("k", i, "A2B3C4") for i in range(5)], "key string, seq int, slots string")
    r = learn.layouts(learn.slot_scores(e, ["key"]), ["key"]).first()
    assert (r.layout, r.violation) == ("LNLNLN", True)
    fixed = e.limit(1).select(learn.apply_layout(F.lit("I212I2"), F.lit("LNLNLN"))).first()[0]
    assert fixed == "I2I2I2"


def test_phrases(spark):
    t = spark.createDataFrame([(1, 0, i, w) for i, w in enumerate("Invoice No: 123 invoice".split())], "doc_id int, line int, place int, text string")
    q = spark.createDataFrame([("q", "invoice no")], "query_id string, query string")
    got = search.phrase_candidates(t, q, ["doc_id"]).collect()
    assert {(r.place, r.n_tokens, r.candidate, r.score) for r in got} == {(0, 2, "Invoice No:", 6.0), (0, 1, "Invoice", 3.5), (1, 1, "No:", 0.5), (3, 1, "invoice", 3.5)}


def test_newest_line_is_the_first_fit(spark):
    import random

    from foliant.operators import folds

    random.seed(11)
    rows = [(p, i, random.random(), round(random.random() * 60, 1), 1.0, 2.0) for p in (1, 2) for i in range(150)]
    df = spark.createDataFrame(rows, "page int, id int, x double, y double, w double, h double")
    for update in folds.UPDATES:
        got = {(r.page, r.id): r.line for r in folds.group_lines(df, ["page"], 1.5, update).collect()}
        for page in (1, 2):
            centres, counts = [], []
            for _, i, _, y, _, h in sorted((r for r in rows if r[0] == page), key=lambda r: (r[3] + r[5] / 2, r[2], r[1])):
                c = y + h / 2
                k = next((k for k, m in enumerate(centres) if abs(m - c) <= 1.5), len(centres))
                if k == len(centres):
                    centres.append(c)
                    counts.append(1)
                else:
                    counts[k] += 1
                    n, m = counts[k], centres[k]
                    centres[k] = {"biased": (m * n + c) / (n + 1), "midpoint": (m + c) / 2, "mean": m + (c - m) / n}[update]
                assert got[page, i] == k


def test_hull_against_every_pair_of_points(spark):
    import random

    from foliant.operators import folds

    random.seed(7)
    groups = {1: [(random.randint(0, 9), random.randint(0, 9)) for _ in range(40)], 2: [(0, 0), (1, 1), (2, 2), (1, 1)], 3: [(4, 5), (4, 5)]}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, ps in groups.items() for x, y in ps], "page int, x double, y double")
    got = {}
    for r in folds.hulls(df, ["page"]).collect():
        got.setdefault(r.page, []).append((r.x, r.y))
    pts = set(groups[1])
    cross = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    between = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])
    edge = lambda p, q: p != q and all(cross(p, q, r) > 0 or (cross(p, q, r) == 0 and between(p, q, r)) for r in pts)
    assert set(got[1]) == {e for p in pts for q in pts if edge(p, q) for e in (p, q)} and len(got[1]) == len(set(got[1]))
    assert set(got[2]) >= {(0, 0), (2, 2)} and got[3] == [(4, 5)]


def test_capture_ranks_equal_distances_from_the_box(spark):
    """tokens a thousandth to each side; taken from the box's centre, the right one is nearer by rounding, as in SQL."""
    d = spark.createDataFrame([(1, i, x, 0.0, 0.02, 0.02) for i, x in ((1, 0.5), (2, 0.499), (3, 0.501))], "page int, id int, x double, y double, w double, h double")
    got = [(r.b_id, r.dx > 0) for r in spatial.capture(d, d, ["page"], 0.2).where("a_id = 1").orderBy("rank").collect()]
    away = lambda b: abs(0.5 + 0.01 - b - 0.01)
    assert away(0.501) < away(0.499) and got == [(1, False), (3, True), (2, False)]
