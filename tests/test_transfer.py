import math
import random

import numpy as np
import pytest

from foliant.operators import alignment, transfer

FIELDS = "batch long, id long, x double, y double, w double, h double"
PAIRS = "batch long, doc long, anchor_id long, x double, y double, u double, v double, weight double"
TARGETS = "batch long, doc long, id long, x double, y double, w double, h double, kind string, depth int, adjacency double"


def clamp(v, lo, hi):
    return min(max(v, lo), hi)


def pairs_of(r, doc, n, move, noise=0.0, weight=0.8):
    rows = []
    for k in range(n):
        x, y = r.random(), r.random()
        u, v = move(x, y)
        rows.append((1, doc, k, x, y, u + r.gauss(0, noise) if noise else u, v + r.gauss(0, noise) if noise else v, weight))
    return rows


def test_transforms_drop_outliers_and_fall_back(spark):
    r = random.Random(3)
    shear = lambda x, y: (1.1 * x + 0.05 * y + 0.02, -0.04 * x + 0.95 * y + 0.03)
    rows = pairs_of(r, 1, 12, shear)
    rows += [(1, 1, 50, 0.2, 0.2, 0.9, 0.1, 0.8), (1, 1, 51, 0.7, 0.3, 0.1, 0.9, 0.8)]
    rows += pairs_of(r, 2, 6, lambda x, y: (2.9 * x, 0.2 * y))  # beyond what is trusted
    rows += [(1, 3, 0, 0.1, 0.2, 0.15, 0.3, 0.5), (1, 4, 0, 0.1, 0.1, 0.2, 0.2, 1.0), (1, 4, 1, 0.5, 0.1, 0.64, 0.2, 1.0)]
    rows += [(1, 5, k, 0.1 * k, 0.1 * k, 0.1 * k + 0.05, 0.1 * k, 1.0) for k in range(1, 5)]  # on one line
    got = {x.doc: x for x in transfer.transforms(spark.createDataFrame(rows, PAIRS), ["batch"]).collect()}
    a = got[1]
    assert (a.status, sorted(a.used)) == ("estimated", list(range(12)))
    assert np.allclose([a.a, a.b, a.c, a.d, a.tx, a.ty], [1.1, 0.05, -0.04, 0.95, 0.02, 0.03], atol=1e-6)
    assert got[2].status == "simplified" and got[2].b == got[2].c == 0 and got[2].a == got[2].d <= 1.5
    assert (got[3].a, got[3].d, round(got[3].tx, 9), round(got[3].ty, 9)) == (1, 1, 0.05, 0.1)
    assert round(got[4].a, 9) == 1.1 and got[4].a == got[4].d and round(got[4].tx, 9) == round(0.42 - 1.1 * 0.3, 9)
    assert np.allclose([got[5].a, got[5].b, got[5].d, got[5].tx], [1, 0, 1, 0.05])


def plain_local(field, pairs, fit):
    """The local fit by numpy on one field's own pairs."""
    cx, cy = field[2] + field[4] / 2, field[3] + field[5] / 2
    near = [(p, math.exp(-((math.hypot(cx - p[3], cy - p[4]) / 0.2) ** 2)) * p[7]) for p in pairs]
    near = [(p, w) for p, w in near if w > 0.01]
    if len(near) < 2:
        return fit, len(near) if len(near) > 1 else 0
    x, y, u, v = (np.array([p[k] for p, _ in near]) for k in (3, 4, 5, 6))
    w = np.array([w for _, w in near])
    m = np.column_stack([x, y, np.ones(len(x))])
    if len(x) >= 3 and abs(np.linalg.det((m * w[:, None]).T @ m)) >= 1e-12:
        s = np.sqrt(w)[:, None]
        sol = np.linalg.lstsq(m * s, np.column_stack([u, v]) * s, rcond=None)[0]
        own = [sol[0, 0], sol[1, 0], sol[0, 1], sol[1, 1], sol[2, 0], sol[2, 1]]
    else:
        mx, my, mu, mv = (np.average(z, weights=w) for z in (x, y, u, v))
        src, dst = (w * np.hypot(x - mx, y - my)).sum(), (w * np.hypot(u - mu, v - mv)).sum()
        k = clamp(dst / src if src > 1e-8 else 1, 0.7, 1.5)
        own = [k, 0, 0, k, mu - k * mx, mv - k * my]
    part = 0.7 * min(1, len(near) / 5)
    return [part * o + (1 - part) * g for o, g in zip(own, fit)], len(near)


def test_local_transforms_equal_a_plain_loop(spark):
    r = random.Random(5)
    bend = lambda x, y: (x + 0.1 * x * y, y + 0.05 * x * x)
    rows = pairs_of(r, 1, 40, bend, 0.002) + pairs_of(r, 2, 3, bend) + [(1, 3, 0, 0.05, 0.05, 0.06, 0.05, 0.9), (1, 3, 1, 0.05, 0.05, 0.06, 0.05, 0.9)]
    fields = [(1, k, r.random() * 0.8, r.random() * 0.8, 0.1, 0.05) for k in range(25)] + [(1, 99, 0.0, 0.0, 0.1, 0.1)]
    df = spark.createDataFrame(rows, PAIRS)
    fits = transfer.transforms(df, ["batch"])
    known = {x.doc: x for x in fits.collect()}
    got = transfer.local_transforms(spark.createDataFrame(fields, FIELDS), df, fits, ["batch"]).collect()
    assert len(got) == 3 * len(fields)
    for g in got:
        fit = known[g.doc]
        used = [p for p in rows if p[1] == g.doc and p[2] in fit.used]
        want, n = plain_local(next(f for f in fields if f[1] == g.field_id), used, [fit[c] for c in transfer.COEFFICIENTS])
        assert g.local_pairs == n
        assert np.allclose([g[c] for c in transfer.COEFFICIENTS], want, atol=1e-5)
    assert {g.is_local for g in got} == {True, False}


def plain_transfer(field, local, fit, regions, print_):
    """One box through its transform and to the most alike region; regions by id."""
    a, b, c, d, tx, ty = local
    x, y, w, h = field[2:]
    corners = [(a * p + b * q + tx, c * p + d * q + ty) for p, q in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))]
    lo, hi = [min(z[k] for z in corners) for k in (0, 1)], [max(z[k] for z in corners) for k in (0, 1)]
    x, y, w, h = clamp(lo[0], 0, 1), clamp(lo[1], 0, 1), clamp(hi[0] - lo[0], 0.001, 1), clamp(hi[1] - lo[1], 0.001, 1)
    reach, best = math.hypot(w, h), None
    for _, _, i, rx, ry, rw, rh, kind, depth, adjacency in sorted(regions, key=lambda z: z[2]):
        cx, cy = rx + rw / 2, ry + rh / 2
        away = math.hypot(x + w / 2 - cx, y + h / 2 - cy)
        if away > reach:
            continue
        shared = max(0, min(x + w, rx + rw) - max(x, rx)) * max(0, min(y + h, ry + rh) - max(y, ry))
        iou, near = shared / (w * h + rw * rh - shared), 1 - away / reach
        like = lambda u, v, least: 1 - abs(u - v) / max(u, v, least)
        if print_:
            inside = print_["container"] is not None
            shape = clamp(like(min(rw / rh, 10), min(print_["container_aspect"], 10), 0.1) * 0.5 + like(rw * rh, print_["container_area"], 0.001) * 0.5, 0, 1) if inside else 0
            topology = clamp((1 - abs(depth - inside) / 3) * 0.6 + adjacency * 0.4, 0, 1)
            score, least, share = (iou * 0.3 + near * 0.2) * 0.35 + shape * 0.25 + topology * 0.25 + 0.15 * (kind in print_["kinds"]), 0.12, 0.35
        else:
            score, least, share = iou * 0.5 + near * 0.3 + clamp(like(rw * rh, w * h, 0.001), 0, 1) * 0.2, 0.15, 0.25
        if score > least and (best is None or score > best[0] + 1e-12):
            best = (score, cx, cy, clamp(score * share, 0, share))
    if best:
        x, y = x + (best[1] - x - w / 2) * best[3], y + (best[2] - y - h / 2) * best[3]
    return max(0, min(x, 1 - w)), max(0, min(y, 1 - h)), w, h


def plain_text(box, tokens):
    x, y, w, h = box
    inside = []
    for _, _, i, text, tx, ty, tw, th, sure in tokens:
        ox, oy = min(tx + tw, x + w) - max(tx, x), min(ty + th, y + h) - max(ty, y)
        if ox > 0 and oy > 0 and ((x <= tx + tw / 2 <= x + w and y <= ty + th / 2 <= y + h) or ox * oy >= 0.5 * tw * th):
            inside.append((ty + th / 2, tx, i, th, text))
    lines, last = [], None
    for cy, tx, i, th, text in sorted(inside):
        if last is None or cy - last > th * 0.5:
            lines.append([])
        lines[-1].append((tx, i, text))
        last = cy
    return "\n".join(" ".join(t[2] for t in sorted(line)) for line in lines).strip(), len(inside)


@pytest.fixture(scope="module")
def batch(spark):
    r = random.Random(8)
    reference = [(1, k, r.random() * 0.8, r.random() * 0.8, r.choice([0.05, 0.1, 0.5]), r.choice([0.04, 0.3]), f"k{k % 3}") for k in range(40)]
    fields = [(1, k, r.random() * 0.7, r.random() * 0.7, 0.1, 0.06) for k in range(12)] + [(1, 77, 0.3, 0.3, 0.1, 0.05)]
    fields += [(2, 5, 0.4, 0.4, 0.1, 0.1)]  # a batch without regions or anchors
    anchors = [(1, k, k, *reference[k][2:6], 0.5 + k / 100) for k in range(0, 40, 2)]
    targets, links = [], []
    for doc, (s, t) in {10: (1.05, 0.02), 11: (0.95, 0.01)}.items():
        for b, k, x, y, w, h, kind in reference:
            shift = 0.3 if k == 6 else 0.0  # out of place
            targets.append((1, doc, k, x * s + t + shift, y * s + t, w * s, h * s, kind, k % 3, k % 5 / 4))
            links += [(1, doc, k, k, 0.6 + k / 100), (1, doc, k, k + 1000, 0.9)][: 1 + (k == 8)]
    tokens = [(1, doc, n, f"t{n}", r.random() * 0.9, round(r.random() * 0.9, 2), 0.04, 0.01, None if n % 4 else 0.8) for doc in (10, 11, 12) for n in range(300)]
    make = spark.createDataFrame
    return {
        "raw": (reference, fields, targets, tokens),
        "reference": make(reference, FIELDS + ", kind string"),
        "fields": make(fields, FIELDS),
        "anchors": make(anchors, "batch long, id long, region_id long, x double, y double, w double, h double, confidence double"),
        "targets": make(targets, TARGETS),
        "links": make(links, "batch long, doc long, region_id long, target_id long, similarity double"),
        "tokens": make(tokens, "batch long, doc long, id long, text string, x double, y double, w double, h double, confidence double"),
        "docs": make([(1, 10), (1, 11), (1, 12), (2, 13)], "batch long, doc long"),
    }


def test_the_whole_chain_equals_plain_loops(spark, batch):
    _, fields, targets, tokens = batch["raw"]
    near = transfer.neighbours(batch["fields"], batch["reference"], ["batch"])
    prints = {x.field_id: x.asDict() for x in transfer.fingerprints(near, ["batch"]).collect()}
    assert all([s.angle for s in p["circle"]] == sorted(s.angle for s in p["circle"]) and len(p["circle"]) <= 8 for p in prints.values())
    chosen = transfer.refined(transfer.relevance(batch["anchors"], batch["fields"], near, ["batch"]))
    pairs = transfer.anchor_pairs(chosen, batch["links"], batch["targets"], ["batch"])
    fits = {x.doc: x for x in transfer.transforms(pairs, ["batch"]).collect()}
    assert set(fits) == {10, 11} and all(6 not in f.used for f in fits.values())
    local = {(x.doc, x.field_id): [x[c] for c in transfer.COEFFICIENTS] for x in transfer.local_transforms(batch["fields"], pairs, transfer.transforms(pairs, ["batch"]), ["batch"]).collect()}
    got = transfer.extracted(batch["fields"], batch["docs"], batch["anchors"], batch["links"], batch["targets"], batch["reference"], batch["tokens"], ["batch"]).collect()
    assert len(got) == 13 * 3 + 1
    for g in got:
        field = next(f for f in fields if f[0] == g.batch and f[1] == g.field_id)
        if g.doc in (12, 13):
            assert (g.method, g.confidence, g.x, g.y, g.w, g.h) == ("identity_fallback", 0.3, *field[2:])
        else:
            want = plain_transfer(field, local[g.doc, g.field_id], fits[g.doc], [t for t in targets if t[1] == g.doc], prints.get(g.field_id))
            assert g.method == "spatial_transform" and np.allclose([g.x, g.y, g.w, g.h], want, atol=2e-6), (g, want)
        assert (g.text, g.tokens) == plain_text((g.x, g.y, g.w, g.h), [t for t in tokens if t[1] == g.doc])
    assert any("\n" in g.text for g in got)


def test_landmarks_supplement_unsure_fields(spark, batch):
    fields = batch["fields"].where("batch = 1 and id in (0, 1)")
    f = {x.id: x for x in fields.collect()}
    context = spark.createDataFrame([(1, 0, n, 0.1 * n, 0.05, 0.1 * n) for n in (1, 2)], "batch long, field_id long, landmark_id long, dx double, dy double, distance double")
    cx, cy = f[0].x + 0.05, f[0].y + 0.03
    matches = spark.createDataFrame([(1, 10, n, cx - 0.1 * n + 0.02, cy - 0.05, 1.0 / n) for n in (1, 2, 3)], "batch long, doc long, landmark_id long, x double, y double, score double")
    fits = spark.createDataFrame([(1, 10, "estimated", 1.0, 0.0, 0.0, 1.0, 0.04, 0.0, 1.0, [1, 2, 3])], "batch long, doc long, status string, a double, b double, c double, d double, tx double, ty double, coherence double, used array<long>")
    got = {x.field_id: x for x in transfer.by_landmarks(context, matches, fields, fits, ["batch"]).collect()}
    part = 0.7 * 2 / 3
    assert abs(got[0].x - (cx + 0.02 * part + 0.04 * (1 - part) - 0.05)) < 2e-6 and got[0].method == "landmark_blended"
    assert abs(got[1].x - (f[1].x + 0.04)) < 2e-6 and got[1].method == "landmark_global"
    assert (got[0].confidence, got[1].confidence) == (round(0.6 * 0.3 + 2 / 3 * 0.4 + 0.3, 4), 0.48)
    mine = spark.createDataFrame([(1, 10, 0, 0.0, 0.0, 0.1, 0.1, 0.4, "spatial_transform"), (1, 10, 1, 0.0, 0.0, 0.1, 0.1, 0.75, "spatial_transform")], "batch long, doc long, field_id long, x double, y double, w double, h double, confidence double, method string")
    mixed = {x.field_id: x for x in transfer.supplemented(mine, transfer.by_landmarks(context, matches, fields, fits, ["batch"]), ["batch"]).collect()}
    c = got[0].confidence
    assert mixed[0].method == "structure_landmark_blend" and abs(mixed[0].x - got[0].x * c / (0.4 + c)) < 2e-6 and mixed[0].confidence == c
    assert (mixed[1].method, mixed[1].confidence, mixed[1].x) == ("spatial_transform", 0.75, 0.0)


def test_pages_without_structure(spark):
    none = spark.createDataFrame([], "p long, id long, x double, y double, w double, h double")
    bands = spark.createDataFrame([(1, 1, 0.2, 0.1, 0.2, False), (1, 2, 0.6, 0.1, 0.2, True)], "p long, id long, y double, x1 double, x2 double, separator boolean")
    ref = alignment.page_reference(none, bands, ["p"]).first()
    assert (ref.surface, ref.cx, ref.cy, ref.xs, ref.ys) == (None, 0.5, 0.5, [], [0.6])
    one = alignment.page_reference(none, bands, ["p"])
    lock = alignment.structural_lock(one, one.withColumnRenamed("p", "q").selectExpr("q", "1L p", "surface", "cx", "cy", "xs", "ys"), ["p"], ["q"]).first()
    assert (lock.source, lock.sx, lock.sy, lock.agreement) == ("region_graph", 1.0, 1.0, 1.0) and abs(lock.tx) < 1e-9 and abs(lock.ty) < 1e-9
    assert alignment.page_reference(none, bands.where("false"), ["p"]).collect() == []


def test_relevance_rounds_halves_of_the_product(spark):
    """an anchor that is third of five neighbours, with a confidence of 0.59: 0.20425 in decimals, just below it in binary."""
    box = "s int, id int, x double, y double, w double, h double"
    anchors = spark.createDataFrame([(1, 1, 0.9, 0.9, 0.01, 0.01, 1, 0.59)], box + ", region_id int, confidence double")
    fields = spark.createDataFrame([(1, 5, 0.0, 0.0, 0.01, 0.01)], box)
    near = spark.createDataFrame([(1, 5, 1, 3, 5)], "s int, field_id int, region_id int, rank int, n int")
    r = transfer.relevance(anchors, fields, near, ["s"]).first()
    assert (r.field_id, r.relevance) == (5, 0.2042)
