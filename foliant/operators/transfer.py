"""Transfer of fields from a reference document to the other documents of its batch, and what they read there.

Boxes are normalised to the page. `keys` names a batch: its reference document's regions and fields, the anchors found in it, and
for other documents (column doc) their regions and which reference region corresponds to which of theirs. Everything joins on
keys, keys and doc, or grid cells (keys must not be named like the columns here); the global fit alone is a fold, over the anchor pairs of one document, which are at most the
batch's anchors.

Defined results: ties go to the smaller id; a field without neighbours has no fingerprint and no container; a document without
pairs keeps the fields' boxes (identity_fallback, confidence 0.3); a null relevance or similarity counts 0.5; a field that holds no token reads ''.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G
from ..functions.numeric import clamp, half_up
from .dedupe import first_by
from .spatial import near_pairs

COEFFICIENTS = ("a", "b", "c", "d", "tx", "ty")
#: Fixed values of the scores.
NEAR, FAR, RELEVANT, RADIUS, LEAST_WEIGHT, BLEND, SINGULAR = 0.5, 0.4, 0.15, 0.2, 0.01, 0.3, 1e-12


def _box(p: str) -> Column:
    return F.struct(*(F.col(f"{p}_{c}").alias(c) for c in "xywh"))


def _apart(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _between(a: Column, b: Column) -> Column:
    """Distance of the centres of two boxes, the second's place and half size taken from the first's centre one by one."""
    (ax, ay) = G.center(a)
    dx, dy = ax - b["x"] - b["w"] / 2, ay - b["y"] - b["h"] / 2
    return F.sqrt(dx * dx + dy * dy)


def neighbours(fields: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field_id, region_id, rank (by proximity, from 1), n (neighbours of the field), proximity, distance, overlap, dx, dy, angle, contains, and the
    region's area and kind: regions (id, x, y, w, h, kind) near fields (id, x, y, w, h) of the same reference document.

    Proximity is 1 - distance / 0.5 or, for regions that overlap, 0.5 and half their overlap, and must exceed 0.05."""
    p = near_pairs(fields, regions.select(*keys, "id", "x", "y", "w", "h", "kind"), keys, 0.25, 0.95 * NEAR)
    a, b = _box("a"), _box("b")
    (ax, ay), (bx, by) = G.center(a), G.center(b)
    p = p.withColumns({"away": _between(a, b), "iou": G.iou(a, b)})
    near = F.greatest(clamp(1 - F.col("away") / NEAR, 0.0, 1.0), F.when(F.col("iou") > 0, 0.5 + F.col("iou") * 0.5).otherwise(0.0))
    p = p.withColumn("near", near).where(F.col("near") > 0.05)
    four = lambda c, n=4: half_up(c, n)
    p = p.select(*(F.col(f"a_{k}").alias(k) for k in keys), F.col("a_id").alias("field_id"), F.col("b_id").alias("region_id"), four(F.col("near")).alias("proximity"), four(F.col("away")).alias("distance"), four(F.col("iou")).alias("overlap"),
                 four(bx - ax).alias("dx"), four(by - ay).alias("dy"), four(F.atan2(by - ay, bx - ax), 3).alias("angle"), G.contains(b, a).alias("contains"), (F.col("b_w") * F.col("b_h")).alias("area"), F.col("b_kind").alias("kind"), F.try_divide(F.col("b_w"), F.col("b_h")).alias("aspect"))
    field = Window.partitionBy(*keys, "field_id")
    return p.withColumn("rank", F.row_number().over(field.orderBy(F.desc("proximity"), "region_id"))).withColumn("n", F.count("*").over(field))


def fingerprints(near: DataFrame, keys: list[str], k: int = 8) -> DataFrame:
    """keys, field_id, circle (the k nearest neighbours in order of their angle: angle, rank, region_id, dx, dy, distance, kind, contains), container (the
    smallest region around the field), container_area, container_aspect, kinds (of the five nearest) from neighbours()."""
    step = F.struct("angle", "rank", "region_id", "dx", "dy", "distance", "kind", "contains")
    inside = F.when(F.col("contains"), F.struct("area", "region_id", "aspect"))
    g = near.groupBy(*keys, "field_id").agg(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, step))).alias("circle"), F.min(inside).alias("around"), F.collect_set(F.when(F.col("rank") <= 5, F.col("kind"))).alias("kinds"))
    return g.select(*keys, "field_id", "circle", F.col("around.region_id").alias("container"), F.col("around.area").alias("container_area"), F.col("around.aspect").alias("container_aspect"), "kinds")


def relevance(anchors: DataFrame, fields: DataFrame, near: DataFrame, keys: list[str]) -> DataFrame:
    """anchors (id, region_id, x, y, w, h, confidence) with relevance, the best over all fields, and field_id, the field of it.

    Of each field: nearness within 0.4, overlap, rank among the field's neighbours and confidence, less for large anchors. An anchor
    that is near no field keeps what its confidence gives, without a field."""
    box = ["id", "x", "y", "w", "h"]
    close = near_pairs(fields.select(*keys, *box), anchors.select(*keys, *box), keys, FAR / 2, FAR).select(*(F.col(f"a_{k}").alias(k) for k in keys), F.col("a_id").alias("field_id"), F.col("b_id").alias("id"))
    member = near.select(*keys, "field_id", "region_id", "rank", "n").join(anchors.select(*keys, "id", "region_id"), [*keys, "region_id"]).select(*keys, "field_id", "id", "rank", "n")
    pairs = close.union(member.select(*close.columns)).distinct().join(member, [*keys, "field_id", "id"], "left")
    pairs = pairs.join(anchors.select(*keys, *(F.col(c).alias(c if c == "id" else f"b_{c}") for c in (*box, "confidence"))), [*keys, "id"])
    pairs = pairs.join(fields.select(*keys, *(F.col(c).alias("field_id" if c == "id" else f"a_{c}") for c in box)), [*keys, "field_id"])
    a, b = _box("a"), _box("b")
    overlap = G.iou(a, b)
    penalty = lambda area: F.when(area > 0.15, clamp(1 - (area - 0.15) / 0.35, 0.2, 1.0)).otherwise(1.0)
    belongs = F.when(F.col("rank").isNotNull(), 0.4 + 0.4 * (1 - (F.col("rank") - 1) / F.col("n"))).otherwise(0.0)
    local = clamp(1 - _between(a, b) / FAR, 0.0, 1.0) * 0.3 + F.when(overlap > 0, 0.3 + overlap * 0.7).otherwise(0.0) * 0.2 + belongs * 0.25 + F.col("b_confidence") * 0.075
    best = first_by(pairs.withColumn("local", local * penalty(G.area(b))), [*keys, "id"], [F.desc("local"), "field_id"]).select(*keys, "id", "field_id", "local")
    alone = F.col("confidence") * 0.075 * penalty(F.col("w") * F.col("h"))
    return anchors.join(best, [*keys, "id"], "left").withColumn("relevance", half_up(F.coalesce("local", alone), 4)).drop("local")


def refined(anchors: DataFrame, least: float = RELEVANT) -> DataFrame:
    """Anchors with a relevance of at least 0.15, from relevance()."""
    return anchors.where(F.col("relevance") >= least)


def anchor_pairs(anchors: DataFrame, correspondences: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, doc, anchor_id, x, y (in the reference), u, v (in the document), weight: refined anchors in every document that has their region.

    correspondences: doc, region_id, target_id, similarity, the first of equal region_id counting; regions: doc, id, x, y, w, h."""
    first = first_by(correspondences, [*keys, "doc", "region_id"], ["target_id"])
    near = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, 0.5).otherwise(F.col(c))
    mine = anchors.select(*keys, F.col("id").alias("anchor_id"), "region_id", (F.col("x") + F.col("w") / 2).alias("ax"), (F.col("y") + F.col("h") / 2).alias("ay"), near("relevance").alias("relevance"))
    theirs = regions.select(*keys, "doc", F.col("id").alias("target_id"), (F.col("x") + F.col("w") / 2).alias("u"), (F.col("y") + F.col("h") / 2).alias("v"))
    p = mine.join(first, [*keys, "region_id"]).join(theirs, [*keys, "doc", "target_id"])
    return p.select(*keys, "doc", "anchor_id", F.col("ax").alias("x"), F.col("ay").alias("y"), "u", "v", (F.col("relevance") * near("similarity")).alias("weight"))


# the global fit of one document


def _similarity(x, y, u, v, w) -> np.ndarray:
    if len(x) == 1:
        return np.array([1, 0, 0, 1, u[0] - x[0], v[0] - y[0]], float)
    cx, cy, cu, cv = (np.average(z, weights=w) for z in (x, y, u, v))
    src, dst = (w * np.hypot(x - cx, y - cy)).sum(), (w * np.hypot(u - cu, v - cv)).sum()
    s = min(max(dst / src if src > 1e-8 else 1.0, 0.7), 1.5)
    return np.array([s, 0, 0, s, cu - s * cx, cv - s * cy])


def _affine(x, y, u, v, w) -> np.ndarray:
    if len(x) < 3:
        return _similarity(x, y, u, v, w)
    m = np.column_stack([x, y, np.ones(len(x))])
    normal = (m * w[:, None]).T @ m
    if abs(np.linalg.det(normal)) < SINGULAR:
        return _similarity(x, y, u, v, w)
    a, b = np.linalg.solve(normal, (m * w[:, None]).T @ np.column_stack([u, v])).T
    return np.array([a[0], a[1], b[0], b[1], a[2], b[2]])


def _coherence(t, x, y, u, v, mad: float = 3.0) -> tuple[float, np.ndarray]:
    """Score of a transform, and which pairs are no outliers: residuals up to the median and three scaled deviations."""
    r = np.hypot(t[0] * x + t[1] * y + t[4] - u, t[2] * x + t[3] * y + t[5] - v)
    middle = np.median(r)
    scaled = np.median(np.abs(r - middle)) * 1.4826
    keep = ~((scaled > 1e-6) & (r > middle + mad * scaled))
    score = min(max(1 - middle / 0.05, 0), 1) * 0.6 + min(max(1 - 2 * (1 - keep.mean()), 0), 1) * 0.4
    return round(float(score), 4), keep


def _sane(t, score: float, n: int) -> bool:
    """Whether scales, rotation and shift are within what so many pairs of this coherence are trusted with."""
    trust = min(max(n / 6, 0.5), 1.2) * (0.7 + score * 0.6)
    scales = abs(np.hypot(t[0], t[2]) - 1), abs(np.hypot(t[1], t[3]) - 1)
    return max(scales) <= 0.5 * trust and abs(np.degrees(np.arctan2(t[2], t[0]))) <= 15 * trust and max(abs(t[4]), abs(t[5])) <= 0.3 * trust


def transforms(pairs: DataFrame, keys: list[str], rounds: int = 5) -> DataFrame:
    """keys, doc, status (estimated or simplified), a, b, c, d, tx, ty, coherence, used (anchor ids of the pairs that were kept).

    Weighted least squares, up to five rounds without the outliers of the round before; where the result is too extreme for its
    support, shift and one scale only."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("anchor_id")
        x, y, u, v, w = (group[c].to_numpy(float) for c in ("x", "y", "u", "v", "weight"))
        on = np.arange(len(x))
        for _ in range(rounds):
            t = _affine(x[on], y[on], u[on], v[on], w[on])
            score, keep = _coherence(t, x[on], y[on], u[on], v[on])
            if keep.all() or score > 0.9 or not keep.any():
                break
            on = on[keep]
        status = "estimated"
        if not _sane(t, score, len(on)):
            status, t = "simplified", _similarity(x[on], y[on], u[on], v[on], w[on])
            score = _coherence(t, x[on], y[on], u[on], v[on])[0]
        head = {k: [group[k].iloc[0]] for k in (*keys, "doc")}
        return pd.DataFrame(head | {"status": [status]} | dict(zip(COEFFICIENTS, ([float(z)] for z in t))) | {"coherence": [score], "used": [group["anchor_id"].to_numpy()[on]]})

    one = lambda n, kind: T.StructField(n, kind)
    fields = [pairs.schema[k] for k in (*keys, "doc")] + [one("status", T.StringType())] + [one(c, T.DoubleType()) for c in (*COEFFICIENTS, "coherence")] + [one("used", T.ArrayType(pairs.schema["anchor_id"].dataType))]
    return pairs.groupBy(*keys, "doc").applyInPandas(fit, T.StructType(fields))


# the fit around one field: sums only


def _solved(s: dict[str, Column], target: str, det: Column) -> list[Column]:
    """Cramer's rule for (x, y, one) -> target from weighted sums."""
    x, y, one, r = ("xx", "xy", "x"), ("xy", "yy", "y"), ("x", "y", "w"), (f"x{target}", f"y{target}", target)
    return [F.try_divide(_det(s, *c), det) for c in ((r, y, one), (x, r, one), (x, y, r))]


def _det(s: dict[str, Column], p: tuple, q: tuple, r: tuple) -> Column:
    c = lambda n: s[n]
    return c(p[0]) * (c(q[1]) * c(r[2]) - c(q[2]) * c(r[1])) - c(q[0]) * (c(p[1]) * c(r[2]) - c(p[2]) * c(r[1])) + c(r[0]) * (c(p[1]) * c(q[2]) - c(p[2]) * c(q[1]))


def local_transforms(fields: DataFrame, pairs: DataFrame, fits: DataFrame, keys: list[str], radius: float = RADIUS, blend: float = BLEND) -> DataFrame:
    """keys, doc, field_id, a, b, c, d, tx, ty, local_pairs, is_local: the document's transform, blended with one fitted around the field.

    A pair weighs exp(-(distance / radius)^2) times its own weight, and counts above 0.01. Two pairs give shift and scale, more the
    affine fit (shift and scale where that is singular), in grouped sums; with five pairs or more the local fit has its full part, 0.7.
    pairs are those that the fits have used."""
    used = fits.select(*keys, "doc", F.explode("used").alias("anchor_id"))
    p = pairs.join(used, [*keys, "doc", "anchor_id"])
    # weight <= 1 and exp(-(d / r)^2) > 0.01 give d < r sqrt(ln 100)
    reach = radius * float(np.sqrt(np.log(1 / LEAST_WEIGHT)))
    centers = fields.select(*keys, "id", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    points = p.select(*keys, F.struct("doc", "anchor_id").alias("id"), "x", "y", F.lit(0.0).alias("w"), F.lit(0.0).alias("h"), "u", "v", "weight")
    near = near_pairs(centers, points, keys, reach / 2, reach)
    away = _apart(F.col("a_x"), F.col("a_y"), F.col("b_x"), F.col("b_y"))
    w = F.exp(-F.pow(away / radius, F.lit(2.0))) * F.col("b_weight")
    near = near.select(*(F.col(f"a_{k}").alias(k) for k in keys), F.col("b_id.doc").alias("doc"), F.col("a_id").alias("field_id"), F.col("b_x").alias("x"), F.col("b_y").alias("y"), F.col("b_u").alias("u"), F.col("b_v").alias("v"), w.alias("w")).where(F.col("w") > LEAST_WEIGHT)
    group = [*keys, "doc", "field_id"]
    all_of = Window.partitionBy(*group)
    mean = {c: F.sum(F.col(c) * F.col("w")).over(all_of) / F.sum("w").over(all_of) for c in "xyuv"}
    near = near.withColumns({f"m{c}": e for c, e in mean.items()})
    apart = lambda a, b: F.sum(F.col("w") * _apart(F.col(a), F.col(b), F.col(f"m{a}"), F.col(f"m{b}")))
    products = {"w": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "u": F.col("u"), "v": F.col("v")} | {a + b: F.col(a) * F.col(b) for a, b in ("xx", "xy", "yy", "xu", "yu", "xv", "yv")}
    g = near.groupBy(*group).agg(*(F.sum(F.col("w") * e).alias(f"s_{n}") for n, e in products.items()), F.count("*").alias("local_pairs"), apart("x", "y").alias("src"), apart("u", "v").alias("dst"), *(F.first(f"m{c}").alias(f"m{c}") for c in "xyuv"))
    s = {n: F.col(f"s_{n}") for n in products}
    g = g.withColumn("det", _det(s, ("xx", "xy", "x"), ("xy", "yy", "y"), ("x", "y", "w")))
    scale = clamp(F.when(F.col("src") > 1e-8, F.col("dst") / F.col("src")).otherwise(1.0), 0.7, 1.5)
    g = g.withColumn("scale", scale).withColumn("full", (F.col("local_pairs") >= 3) & (F.abs("det") >= SINGULAR))
    (a, b, tx), (c, d, ty) = (_solved(s, t, F.col("det")) for t in "uv")
    k, zero = F.col("scale"), F.lit(0.0)
    simple = (k, zero, zero, k, F.col("mu") - k * F.col("mx"), F.col("mv") - k * F.col("my"))
    g = g.where("local_pairs >= 2").select(*group, "local_pairs", *(F.when(F.col("full"), e).otherwise(q).alias(f"l_{n}") for n, e, q in zip(COEFFICIENTS, (a, b, c, d, tx, ty), simple)))
    grid = fields.select(*keys, F.col("id").alias("field_id")).join(fits.select(*keys, "doc", *COEFFICIENTS), keys)
    found = grid.join(g, group, "left")
    part = (1 - blend) * F.least(F.lit(1.0), F.col("local_pairs") / 5)
    return found.select(*group, *(F.coalesce(F.col(f"l_{n}") * part + F.col(n) * (1 - part), F.col(n)).alias(n) for n in COEFFICIENTS), F.coalesce("local_pairs", F.lit(0)).alias("local_pairs"), F.col("local_pairs").isNotNull().alias("is_local"))


# boxes in the other documents


def transferred(fields: DataFrame, docs: DataFrame, fits: DataFrame, local: DataFrame, regions: DataFrame, prints: DataFrame, keys: list[str]) -> DataFrame:
    """keys, doc, field_id, x, y, w, h, confidence, method of every field in every document of docs (keys, doc).

    The box goes through the field's transform, then up to 35 percent of the way to the region (doc, id, x, y, w, h, kind, depth,
    adjacency) around it that is most like what surrounds the field in the reference: by overlap, distance, the shape of the
    container, depth and kind. prints are fingerprints(); a field without one is drawn by overlap, distance and size, up to 25 percent."""
    group = [*keys, "doc", "field_id"]
    grid = fields.select(*keys, F.col("id").alias("field_id"), *(F.col(c).alias(f"o_{c}") for c in "xywh")).join(docs, keys)
    t = grid.join(local, group).withColumn("m", G.transformed(F.struct(*COEFFICIENTS), _box("o")))
    at = lambda c: F.col(f"m.{c}")
    t = t.select(*group, "is_local", clamp(at("x"), 0.0, 1.0).alias("x"), clamp(at("y"), 0.0, 1.0).alias("y"), clamp(at("w"), 0.001, 1.0).alias("w"), clamp(at("h"), 0.001, 1.0).alias("h"))
    boxes = t.select(*keys, "doc", F.col("field_id").alias("id"), "x", "y", "w", "h")
    # a centre within one diagonal of the box's is in the box grown by that much; a diagonal is at most w + h
    boxes = boxes.withColumn("reach", F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h")))
    grown = boxes.select(*keys, "doc", "id", (F.col("x") - F.col("reach")).alias("x"), (F.col("y") - F.col("reach")).alias("y"), (F.col("w") + 2 * F.col("reach")).alias("w"), (F.col("h") + 2 * F.col("reach")).alias("h"), "reach", *(F.col(c).alias(f"b{c}") for c in "xywh"))
    p = near_pairs(grown, regions.select(*keys, "doc", "id", "x", "y", "w", "h", "kind", "depth", "adjacency"), [*keys, "doc"], 0.25)
    a, b = F.struct(*(F.col(f"a_b{c}").alias(c) for c in "xywh")), _box("b")
    p = p.withColumns({"away": G.distance(a, b), "iou": G.iou(a, b)}).where(F.col("away") <= F.col("a_reach"))
    p = p.select(*(F.col(f"a_{k}").alias(k) for k in (*keys, "doc")), F.col("a_id").alias("field_id"), F.col("b_id").alias("region_id"), G.center(b)[0].alias("cx"), G.center(b)[1].alias("cy"), "iou", (1 - F.try_divide(F.col("away"), F.col("a_reach"))).alias("near"), G.area(b).alias("area"), G.area(a).alias("own_area"), F.try_divide(F.col("b_w"), F.col("b_h")).alias("aspect"), F.col("b_kind").alias("kind"), F.col("b_depth").alias("depth"), F.col("b_adjacency").alias("adjacency"))
    p = p.join(prints, [*keys, "field_id"], "left")
    like = lambda u, v, least: 1 - F.abs(u - v) / F.greatest(u, v, F.lit(least))
    ten = lambda c: F.least(F.col(c), F.lit(10.0))
    shape = F.when(F.col("container").isNull(), 0.0).otherwise(clamp(like(ten("aspect"), ten("container_aspect"), 0.1) * 0.5 + like(F.col("area"), F.col("container_area"), 0.001) * 0.5, 0.0, 1.0))
    deep = 1 - F.abs(F.coalesce("depth", F.lit(0)) - F.col("container").isNotNull().cast("int")) / 3
    topology = clamp(deep * 0.6 + F.coalesce("adjacency", F.lit(0.5)) * 0.4, 0.0, 1.0)
    known = F.col("circle").isNotNull()
    by_print = (F.col("iou") * 0.3 + F.col("near") * 0.2) * 0.35 + shape * 0.25 + topology * 0.25 + F.when(F.array_contains("kinds", F.col("kind")), 0.15).otherwise(0.0)
    plain = F.col("iou") * 0.5 + F.col("near") * 0.3 + clamp(like(F.col("area"), F.col("own_area"), 0.001), 0.0, 1.0) * 0.2
    p = p.withColumn("score", F.when(known, by_print).otherwise(plain)).where(F.col("score") > F.when(known, 0.12).otherwise(0.15)).withColumn("pull", F.when(known, clamp(F.col("score") * 0.35, 0.0, 0.35)).otherwise(clamp(F.col("score") * 0.25, 0.0, 0.25)))
    best = first_by(p, group, [F.desc("score"), "region_id"]).select(*group, "cx", "cy", "pull")
    t = t.join(best, group, "left").join(fits.select(*keys, "doc", "coherence", F.size("used").alias("pairs")), [*keys, "doc"])
    move = lambda c, s: F.col(c) + F.coalesce((F.col(f"c{c}") - F.col(c) - F.col(s) / 2) * F.col("pull"), F.lit(0.0))
    held = lambda c, s: F.greatest(F.lit(0.0), F.least(move(c, s), 1 - F.col(s)))
    score = F.when(F.col("coherence") == 0, 0.5).otherwise(F.col("coherence"))
    confidence = clamp(score * clamp(F.col("pairs") / 5, 0.3, 1.0) * F.when(F.col("is_local"), 1.1).otherwise(1.0), 0.0, 1.0)
    six = lambda c: F.round(c, 6)
    t = t.select(*group, six(held("x", "w")).alias("x"), six(held("y", "h")).alias("y"), six(F.col("w")).alias("w"), six(F.col("h")).alias("h"), F.round(confidence, 4).alias("confidence"), F.lit("spatial_transform").alias("method"))
    rest = grid.join(fits.select(*keys, "doc"), [*keys, "doc"], "left_anti").select(*group, *(F.col(f"o_{c}").alias(c) for c in "xywh"), F.lit(0.3).alias("confidence"), F.lit("identity_fallback").alias("method"))
    return t.unionByName(rest)


def by_landmarks(context: DataFrame, matches: DataFrame, fields: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, doc, field_id, x, y, w, h, confidence, method of fields by the landmarks near them.

    context: field_id, landmark_id, dx, dy (from the landmark to the field's centre), distance; matches: doc, landmark_id, x, y (where
    it is in the document), score; fits: transforms() of all matched landmarks. The centre is the mean of what the landmarks say,
    weighted by score and nearness, blended with the global fit, which gives the size; three landmarks have their full part, 0.7."""
    group = [*keys, "doc", "field_id"]
    said = context.join(matches, [*keys, "landmark_id"]).withColumn("w", F.col("score") / (F.col("distance") + 0.05))
    mean = lambda c, d: F.sum((F.col(c) + F.col(d)) * F.col("w")) / F.sum("w")
    said = said.groupBy(*group).agg(mean("x", "dx").alias("px"), mean("y", "dy").alias("py"), F.count("*").alias("said"))
    count = matches.groupBy(*keys, "doc").agg(F.count("*").alias("matched"))
    t = fields.select(*keys, F.col("id").alias("field_id"), *(F.col(c).alias(f"o_{c}") for c in "xywh")).join(fits.select(*keys, "doc", *COEFFICIENTS, "coherence"), keys).join(count, [*keys, "doc"]).join(said, group, "left")
    t = t.withColumn("m", G.transformed(F.struct(*COEFFICIENTS), _box("o")))
    cx, cy = F.col("o_x") + F.col("o_w") / 2, F.col("o_y") + F.col("o_h") / 2
    gx, gy = F.col("a") * cx + F.col("b") * cy + F.col("tx"), F.col("c") * cx + F.col("d") * cy + F.col("ty")
    n = F.coalesce("said", F.lit(0))
    part = F.when(n > 0, 0.7 * clamp(n / 3, 0.3, 1.0)).otherwise(0.0)
    low = lambda c: clamp(F.col(f"m.{c}"), 0.0, 1.0)
    t = t.withColumns({"gw": clamp(F.col("m.w"), 0.001, 1.0), "gh": clamp(F.col("m.h"), 0.001, 1.0)})
    x = F.when(n > 0, F.col("px") * part + gx * (1 - part)).otherwise(low("x") + F.col("gw") / 2)
    y = F.when(n > 0, F.col("py") * part + gy * (1 - part)).otherwise(low("y") + F.col("gh") / 2)
    held = lambda c, s: F.round(F.greatest(F.lit(0.0), F.least(c - F.col(s) / 2, 1 - F.col(s))), 6)
    confidence = clamp(F.col("matched") / 5, 0.2, 1.0) * 0.3 + clamp(n / 3, 0.0, 1.0) * 0.4 + F.col("coherence") * 0.3
    return t.select(*group, held(x, "gw").alias("x"), held(y, "gh").alias("y"), F.round("gw", 6).alias("w"), F.round("gh", 6).alias("h"), F.round(clamp(confidence, 0.0, 1.0), 4).alias("confidence"), F.when(n > 0, "landmark_blended").otherwise("landmark_global").alias("method"))


def supplemented(structure: DataFrame, landmark: DataFrame, keys: list[str], sure: float = 0.7) -> DataFrame:
    """structure, where its confidence is below 0.7 and the landmarks' is higher blended with theirs by confidence."""
    group = [*keys, "doc", "field_id"]
    other = landmark.select(*group, *(F.col(c).alias(f"l_{c}") for c in ("x", "y", "w", "h", "confidence")))
    j = structure.join(other, group, "left")
    use = F.coalesce((F.col("confidence") < sure) & (F.col("l_confidence") > F.col("confidence")), F.lit(False))
    mix = lambda c: F.when(use, F.round((F.col(c) * F.col("confidence") + F.col(f"l_{c}") * F.col("l_confidence")) / (F.col("confidence") + F.col("l_confidence")), 6)).otherwise(F.col(c)).alias(c)
    return j.select(*group, *map(mix, "xywh"), F.when(use, F.col("l_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(use, "structure_landmark_blend").otherwise(F.col("method")).alias("method"))


def read(boxes: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """boxes (keys, doc, field_id, x, y, w, h, ...) with text, tokens and text_confidence: what tokens (keys, doc, id, text, x, y, w, h, confidence) say in them.

    A token counts with its centre or half its area in the box. A new line begins where the next centre lies lower by more than half
    the token's height; lines read from left to right."""
    group = [*keys, "doc", "field_id"]
    b = boxes.select(*keys, "doc", F.col("field_id").alias("id"), "x", "y", "w", "h")
    p = near_pairs(b, tokens.select(*keys, "doc", "id", "x", "y", "w", "h", "text", "confidence"), [*keys, "doc"], 0.25)
    a, t = _box("a"), _box("b")
    p = p.where((G.overlap_area(a, t) > 0) & (G.center_inside(t, a) | (G.overlap_area(a, t) >= 0.5 * G.area(t))))
    p = p.select(*(F.col(f"a_{k}").alias(k) for k in (*keys, "doc")), F.col("a_id").alias("field_id"), F.col("b_id").alias("token"), F.col("b_x").alias("tx"), (F.col("b_y") + F.col("b_h") / 2).alias("cy"), F.col("b_h").alias("th"), F.col("b_text").alias("text"), F.coalesce("b_confidence", F.lit(0.5)).alias("sure"))
    down = Window.partitionBy(*group).orderBy("cy", "tx", "token")
    p = p.withColumn("new", F.coalesce((F.col("cy") - F.lag("cy").over(down) > F.col("th") * 0.5).cast("int"), F.lit(0)))
    p = p.withColumn("line", F.sum("new").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    lines = p.groupBy(*group, "line").agg(F.array_sort(F.collect_list(F.struct("tx", "token", "text"))).alias("row"), F.sum("sure").alias("sure"), F.count("*").alias("n"))
    lines = lines.select(*group, "sure", "n", F.struct("line", F.array_join(F.transform("row", lambda r: r["text"]), " ").alias("text")).alias("said"))
    found = lines.groupBy(*group).agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list("said")), lambda r: r["text"]), "\n")).alias("text"), F.sum("n").alias("tokens"), F.round(F.sum("sure") / F.sum("n"), 4).alias("text_confidence"))
    return boxes.join(found, group, "left").withColumns({"text": F.coalesce("text", F.lit("")), "tokens": F.coalesce("tokens", F.lit(0)), "text_confidence": F.coalesce("text_confidence", F.lit(0.0))})


def extracted(fields: DataFrame, docs: DataFrame, anchors: DataFrame, correspondences: DataFrame, regions: DataFrame, reference: DataFrame, tokens: DataFrame, keys: list[str], landmark: DataFrame | None = None) -> DataFrame:
    """Every field in every document of the batch, with its box, method, confidence and text: the whole chain of this module.

    reference: the reference document's regions; landmark: by_landmarks(), to supplement unsure fields."""
    near = neighbours(fields, reference, keys)
    chosen = refined(relevance(anchors, fields, near, keys))
    pairs = anchor_pairs(chosen, correspondences, regions, keys)
    fits = transforms(pairs, keys)
    boxes = transferred(fields, docs, fits, local_transforms(fields, pairs, fits, keys), regions, fingerprints(near, keys), keys)
    return read(boxes if landmark is None else supplemented(boxes, landmark, keys), tokens, keys)
