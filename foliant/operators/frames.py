"""Local frames of fields, their signatures, and the search for a field's best box.

Everything is grouped by keys and field. Defined results: null angles count nothing; a field without any angle has the page's
axes; opposite directions that cancel leave the smallest angle; ties go to the smaller id, and of boxes that score alike to the
first in the list of variants.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import clamp
from .dedupe import first_by
from .spatial import near_pairs


def turned(angle: Column) -> Column:
    """An angle in [0, 360)."""
    return F.pmod(angle.cast("double"), F.lit(360.0))


def mean_angle(angles: Column) -> Column:
    """Aggregate: the mean direction in [0, 360); the smallest angle where directions cancel."""
    a = F.radians(turned(angles))
    s, c = F.avg(F.sin(a)), F.avg(F.cos(a))
    return F.when((F.abs(s) < 1e-9) & (F.abs(c) < 1e-9), F.min(turned(angles))).otherwise(turned(F.degrees(F.atan2(s, c))))


def local_frames(seeds: DataFrame, lines: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, angle, source, ox, oy (origin), px, py (primary axis), confidence of seeds (id, x, y, w, h, block_angle).

    lines and regions: id (of the seed they were kept for), angle. The lines' mean direction counts, else the containing block's, else
    the regions'."""
    part = lambda df, n: df.where("angle IS NOT NULL").groupBy(*keys, "id").agg(mean_angle(F.col("angle")).alias(n))
    s = seeds.join(part(lines, "line"), [*keys, "id"], "left").join(part(regions, "region"), [*keys, "id"], "left")
    block = F.col("block_angle").cast("double")
    angle = F.coalesce("line", block, "region", F.lit(0.0))
    source = F.when(F.col("line").isNotNull(), "text-line-orientation").when(block.isNotNull(), "containing-block-orientation").when(F.col("region").isNotNull(), "region-orientation").otherwise("fallback-seed-axis")
    have = lambda c, v: F.when(c.isNotNull(), v).otherwise(0.0)
    confidence = clamp(have(F.col("line"), 0.62) + have(block, 0.2) + have(F.col("region"), 0.1) + 0.08, 0.2, 0.98)
    return s.select(*keys, "id", angle.alias("angle"), source.alias("source"), (F.col("x") + F.col("w") / 2).alias("ox"), (F.col("y") + F.col("h") / 2).alias("oy"), F.cos(F.radians(angle)).alias("px"), F.sin(F.radians(angle)).alias("py"), confidence.alias("confidence"))


def to_local(x: Column, y: Column) -> Column:
    """Struct x, y of a page point in the frame of local_frames()."""
    dx, dy = x - F.col("ox"), y - F.col("oy")
    return F.struct((dx * F.col("px") + dy * F.col("py")).alias("x"), (dy * F.col("px") - dx * F.col("py")).alias("y"))


def to_page(x: Column, y: Column) -> Column:
    """The way back from to_local()."""
    return F.struct((F.col("ox") + x * F.col("px") - y * F.col("py")).alias("x"), (F.col("oy") + x * F.col("py") + y * F.col("px")).alias("y"))


def signatures(frames: DataFrame, anchors: DataFrame, labels: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, anchors (the six best tokens, in the field's frame), labels (the four best lines), edges (their number, 80 at most), confidence.

    frames: local_frames() with structure (confidence of the local structure); anchors: id, node_id, text, x, y, score; labels: id, node_id, text,
    score; edges: id."""
    a = anchors.join(frames.select(*keys, "id", "ox", "oy", "px", "py"), [*keys, "id"]).withColumn("at", to_local(F.col("x"), F.col("y")))
    top = lambda df, n, *more: first_by(df, [*keys, "id"], [F.desc("score"), "node_id"], n).groupBy(*keys, "id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "node_id", "text", *more))).alias("list"))
    near = top(a, 6, "at").withColumnRenamed("list", "anchors")
    said = top(labels, 4).withColumnRenamed("list", "labels")
    linked = edges.groupBy(*keys, "id").agg(F.least(F.count("*"), F.lit(80)).alias("edges"))
    f = frames
    for part in (near, said, linked):
        f = f.join(part, [*keys, "id"], "left")
    clean = lambda c, *more: F.transform(F.col(c), lambda r: F.struct(r["node_id"].alias("node_id"), r["text"].alias("text"), (-r["minus"]).alias("score"), *(r[m].alias(m) for m in more)))
    have = lambda c, v: F.when(F.col(c).isNotNull(), v).otherwise(0.0)
    confidence = clamp(F.coalesce("structure", F.lit(0.0)) * 0.45 + F.col("confidence") * 0.25 + have("anchors", 0.15) + have("labels", 0.1) + have("edges", 0.05), 0.15, 0.99)
    return f.select(*keys, "id", "angle", "source", clean("anchors", "at").alias("anchors"), clean("labels").alias("labels"), F.coalesce("edges", F.lit(0)).alias("edges"), confidence.alias("confidence"))


# the search for a field's best box

SHIFT, GROW, MOST, HUGE, SMALLEST = 0.3, 0.25, 2.0, 0.4, 0.005


def variants(fields: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, n (place in the list), family, x, y, w, h, o_x, o_y, o_w, o_h: up to 21 boxes to try for each field (id, x, y, w, h).

    The box itself; grown to the region that fits it best (by overlap and whether the centre is inside, none above twice its area or
    0.4 of the page), and halfway; shifted by 0.3 of its size in eight directions; a quarter wider, higher or both, or less; shifted and
    grown. None has over twice the area."""
    p = near_pairs(fields, regions.select(*keys, "id", "x", "y", "w", "h"), keys, 0.25)
    a, b = (F.struct(*(F.col(f"{s}_{c}").alias(c) for c in "xywh")) for s in "ab")
    p = p.withColumn("fit", G.iou(a, b) + F.when(G.center_inside(a, b), 0.5).otherwise(0.0)).where((G.area(b) <= HUGE) & (G.area(b) <= MOST * G.area(a)) & (F.col("fit") > 0))
    at = lambda c: F.col(f"b_{c}")
    best = first_by(p, [*(f"a_{k}" for k in keys), "a_id"], [F.desc("fit"), "b_id"]).select(*(F.col(f"a_{k}").alias(k) for k in keys), F.col("a_id").alias("id"), at("x").alias("rx"), at("y").alias("ry"), (at("x") + at("w")).alias("rx1"), (at("y") + at("h")).alias("ry1"))
    f = fields.select(*keys, "id", "x", "y", "w", "h").join(best, [*keys, "id"], "left")
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    six = lambda c: F.round(c, 6)
    row = lambda n, family, bx, by, bw, bh, ok=None: F.when(F.lit(True) if ok is None else ok, F.struct(F.lit(n).alias("n"), F.lit(family).alias("family"), bx.alias("x"), by.alias("y"), bw.alias("w"), bh.alias("h")))
    ex, ey, ex1, ey1 = F.least(x, "rx"), F.least(y, "ry"), F.greatest(x + w, "rx1"), F.greatest(y + h, "ry1")
    fits = lambda bw, bh: bw * bh <= MOST * w * h
    half = lambda a, b: a + (b - a) * 0.5
    hx, hy, hx1, hy1 = half(x, ex), half(y, ey), half(x + w, ex1), half(y + h, ey1)
    known = F.col("rx").isNotNull()
    rows = [row(0, "original", x, y, w, h)]
    rows += [row(1 + k, "structural_expansion", six(bx), six(by), six(bx1 - bx), six(by1 - by), known & fits(bx1 - bx, by1 - by)) for k, (bx, by, bx1, by1) in enumerate(((ex, ey, ex1, ey1), (hx, hy, hx1, hy1)))]
    held = lambda c, size: F.greatest(F.lit(0.0), F.least(c, 1 - size))
    for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (1, -1), (-1, 1), (1, 1)):
        rows.append(row(len(rows), "local_search", six(held(x + w * SHIFT * dx, w)), six(held(y + h * SHIFT * dy, h)), w, h))
    resized = [(0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 1, 1), (0, 0, -1, 0), (0, 0, 0, -1), (0, 0, -1, -1), (-1, 0, 1, 0), (1, 0, 1, 0), (0, -1, 0, 1), (0, 1, 0, 1)]
    for k, (dx, dy, dw, dh) in enumerate(resized):
        bw, bh = w * (1 + GROW * dw), h * (1 + GROW * dh)
        big = (bw >= SMALLEST) & (bh >= SMALLEST) if k < 6 else F.lit(True)
        rows.append(row(len(rows), "local_search", six(held(x + w * SHIFT * dx - (bw - w) / 2, F.least(bw, F.lit(1.0)))), six(held(y + h * SHIFT * dy - (bh - h) / 2, F.least(bh, F.lit(1.0)))), six(bw), six(bh), big & fits(bw, bh)))
    listed = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return f.select(*keys, "id", *(c.alias(f"o_{n}") for n, c in zip("xywh", (x, y, w, h))), F.explode(listed).alias("v")).select(*keys, "id", "v.*", "o_x", "o_y", "o_w", "o_h")


def text_similarity(said: Column, wanted: Column) -> Column:
    """0.6 of the edit likeness and 0.4 of the share of wanted words found; 1 or 0 where one of both is empty."""
    s, w = F.trim(F.coalesce(said, F.lit(""))), F.trim(F.coalesce(wanted, F.lit("")))
    words = F.filter(F.split(F.lower(w), r"\s+"), lambda t: t != "")
    found = F.size(F.filter(words, lambda t: F.contains(F.lower(s), t))) / F.size(words)
    edits = 1 - F.levenshtein(s, w) / F.greatest(F.length(s), F.length(w))
    return F.when(w == "", F.when(s == "", 1.0).otherwise(0.0)).when(s == "", 0.0).otherwise(edits * 0.6 + found * 0.4)


def scored_variants(read: DataFrame) -> DataFrame:
    """Variants as read (text, tokens, text_confidence) with wanted: total, from 0.4 of alignment, 0.3 of confidence, 0.3 of likeness to what is wanted."""
    o, v = F.struct(*(F.col(f"o_{c}").alias(c) for c in "xywh")), F.struct(*(F.col(c) for c in "xywh"))
    alignment = G.iou(o, v) * 0.6 + clamp(1 - G.distance(o, v) / 0.15, 0.0, 1.0) * 0.4
    sure = F.when(F.col("tokens") > 0, clamp(F.col("text_confidence"), 0.0, 1.0) * 0.7 + clamp(F.col("tokens") / 5, 0.0, 1.0) * 0.3).otherwise(0.0)
    alike = text_similarity(F.col("text"), F.col("wanted"))
    four = lambda c: F.round(c, 4)
    return read.withColumns({"alignment": four(alignment), "sure": four(sure), "alike": four(alike), "total": four(alignment * 0.4 + sure * 0.3 + alike * 0.3)})


def best_boxes(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, family, x, y, w, h, text, total, improvement (over the original box), tried of the best variant of each field."""
    field = Window.partitionBy(*keys, "id")
    s = scores.withColumns({"first": F.max(F.when(F.col("n") == 0, F.col("total"))).over(field), "tried": F.count("*").over(field)})
    return first_by(s, [*keys, "id"], [F.desc("total"), "n"]).select(*keys, "id", "family", "x", "y", "w", "h", "text", "total", F.round(F.col("total") - F.col("first"), 4).alias("improvement"), "tried")
