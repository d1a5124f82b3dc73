"""Column builders for boxes (structs of x, y, w, h) and affine transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*(c.cast("double").alias(n) for c, n in zip((x, y, w, h), "xywh")))


def center(b: Column) -> tuple[Column, Column]:
    return b["x"] + b["w"] / 2, b["y"] + b["h"] / 2


def overlap_area(a: Column, b: Column) -> Column:
    dx = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    dy = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(dx, F.lit(0.0)) * F.greatest(dy, F.lit(0.0))


def area(b: Column) -> Column:
    return b["w"] * b["h"]


def intersects(a: Column, b: Column) -> Column:
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def iou(a: Column, b: Column) -> Column:
    shared = overlap_area(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the area of the first."""
    return F.when(area(a) > 0, overlap_area(a, b) / area(a)).otherwise(0.0)


def contains(a: Column, b: Column) -> Column:
    return (a["x"] <= b["x"]) & (a["y"] <= b["y"]) & (a["x"] + a["w"] >= b["x"] + b["w"]) & (a["y"] + a["h"] >= b["y"] + b["h"])


def center_inside(token: Column, b: Column) -> Column:
    cx, cy = center(token)
    return cx.between(b["x"], b["x"] + b["w"]) & cy.between(b["y"], b["y"] + b["h"])


def vertical_hit(token: Column, b: Column, least: float = 0.5) -> Column:
    """Centre within the box across, and at least this share of the height within it."""
    cx, _ = center(token)
    dy = F.least(token["y"] + token["h"], b["y"] + b["h"]) - F.greatest(token["y"], b["y"])
    return cx.between(b["x"], b["x"] + b["w"]) & (dy / F.greatest(token["h"], F.lit(1e-9)) >= least)


def normalized(b: Column, width: Column, height: Column) -> Column:
    return box(b["x"] / width, b["y"] / height, b["w"] / width, b["h"] / height)


def denormalized(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels, halves up, at least one wide and high."""
    whole = lambda c: F.floor(c + 0.5)
    return box(whole(b["x"] * width), whole(b["y"] * height), F.greatest(whole(b["w"] * width), F.lit(1)), F.greatest(whole(b["h"] * height), F.lit(1)))


def expanded(b: Column, pad: Column) -> Column:
    return box(F.greatest(b["x"] - pad, F.lit(0.0)), F.greatest(b["y"] - pad, F.lit(0.0)), b["w"] + 2 * pad, b["h"] + 2 * pad)


def distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = center(a), center(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def scaled_rotated(b: Column, scale: Column, degrees: Column, width: Column, height: Column) -> Column:
    """The box scaled and its centre rotated about the page's centre."""
    cx, cy = center(b)
    dx, dy, r = (cx - width / 2) * scale, (cy - height / 2) * scale, F.radians(degrees)
    x, y = width / 2 + dx * F.cos(r) - dy * F.sin(r), height / 2 + dx * F.sin(r) + dy * F.cos(r)
    w, h = b["w"] * scale, b["h"] * scale
    return box(x - w / 2, y - h / 2, w, h)


def from_anchor(anchor: Column, offset: Column, scale: Column) -> Column:
    """The box at an offset (a box relative to the anchor) from an anchor box."""
    return box(anchor["x"] + offset["x"] * scale, anchor["y"] + offset["y"] * scale, offset["w"] * scale, offset["h"] * scale)


def transformed(t: Column, b: Column) -> Column:
    """Bounding box of the corners under x' = a x + b y + tx, y' = c x + d y + ty."""
    corners = [(b["x"], b["y"]), (b["x"] + b["w"], b["y"]), (b["x"], b["y"] + b["h"]), (b["x"] + b["w"], b["y"] + b["h"])]
    xs = [t["a"] * x + t["b"] * y + t["tx"] for x, y in corners]
    ys = [t["c"] * x + t["d"] * y + t["ty"] for x, y in corners]
    return box(F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys))


def decomposed(t: Column) -> Column:
    """Scales, rotation in degrees and skew of an affine transform."""
    sx = F.sqrt(t["a"] * t["a"] + t["c"] * t["c"])
    det = t["a"] * t["d"] - t["b"] * t["c"]
    return F.struct(sx.alias("scale_x"), F.try_divide(det, sx).alias("scale_y"), F.degrees(F.atan2(t["c"], t["a"])).alias("rotation"), F.try_divide(t["a"] * t["b"] + t["c"] * t["d"], sx * sx).alias("skew"))
