"""Refinement of a page's regions: overlaps resolved, edges snapped to common lines, repeated sizes made equal.

Overlaps are resolved in order of id, and what one step trims the next one sees; so a page's regions are one fold, as are its runs. Snapping is by
gaps and islands over all edges of a page, without a fold.

Defined results: ties of size keep the earlier id; a page of one region stays as it is; regions: id, x, y, w, h, confidence, ocr,
contour, text_density (nulls count nothing).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shares of overlap and likeness, and tolerances in pixels.
NEAR_COPY, SAME, LEAST, MOST, SNAPS, TINY = 0.8, 0.7, 0.3, 0.85, (6.0, 4.0), 2.0
STEP, LIKE, SMALL, MOVED, GAP = 8.0, 0.3, 0.2, 0.5, 8.0


def _trim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Box a without the strip along one of its edges that b covers, the narrowest there is."""
    x0, y0 = max(a[0], b[0]), max(a[1], b[1])
    x1, y1 = min(a[0] + a[2], b[0] + b[2]), min(a[1] + a[3], b[1] + b[3])
    w, h = x1 - x0, y1 - y0
    strips = [(w, 0, x0 == a[0]), (w, 1, x0 + w == a[0] + a[2]), (h, 2, y0 == a[1]), (h, 3, y0 + h == a[1] + a[3])]
    strips = [(n, side) for n, side, on in strips if on and n > 0]
    if not strips:
        return a
    n, side = min(strips, key=lambda s: s[0])
    x, y, w, h = a
    return np.array([(x + n, y, w - n, h), (x, y, w - n, h), (x, y + n, w, h - n), (x, y, w, h - n)][side])


def _containers(box: np.ndarray) -> np.ndarray:
    """The place of the smallest box around each that has more than 1.1 times its area; -1 without one."""
    right, bottom, area = box[:, 0] + box[:, 2], box[:, 1] + box[:, 3], box[:, 2] * box[:, 3]
    found = np.full(len(box), -1)
    for j in range(len(box)):
        around = (box[:, 0] <= box[j, 0]) & (box[:, 1] <= box[j, 1]) & (right >= right[j]) & (bottom >= bottom[j]) & (area > area[j] * 1.1)
        around[j] = False
        if around.any():
            k = np.flatnonzero(around)
            found[j] = k[np.argmin(area[k])]
    return found


def without_overlaps(regions: DataFrame, keys: list[str]) -> DataFrame:
    """regions without near copies (the one that scores less goes), larger peers trimmed to the edge of the smaller they overlap."""

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("id").reset_index(drop=True)
        box = page[["x", "y", "w", "h"]].to_numpy(float)
        parent = _containers(box)
        worth = page["confidence"].fillna(0).to_numpy(float) + 0.3 * page["ocr"].fillna(False).to_numpy(bool) + 0.1 * page["contour"].fillna(False).to_numpy(bool) + 0.2 * (page["text_density"].fillna(0).to_numpy(float) > 0.5)
        gone = np.zeros(len(box), bool)
        for i in range(len(box)):
            if gone[i]:
                continue
            side = lambda k, s: np.minimum(box[i, k] + box[i, s], box[:, k] + box[:, s]) - np.maximum(box[i, k], box[:, k])  # noqa: B023, E731
            meets = np.flatnonzero((side(0, 2) > 0) & (side(1, 3) > 0) & ~gone)
            for j in meets[meets > i]:  # a box that is trimmed only shrinks, so no pair comes up later
                a, b = box[i, 2] * box[i, 3], box[j, 2] * box[j, 3]
                if parent[j] == i or parent[i] == j:
                    inner, outer = (b, a) if parent[j] == i else (a, b)
                    if inner / max(1, outer) < NEAR_COPY:
                        continue
                w = min(box[i, 0] + box[i, 2], box[j, 0] + box[j, 2]) - max(box[i, 0], box[j, 0])
                h = min(box[i, 1] + box[i, 3], box[j, 1] + box[j, 3]) - max(box[i, 1], box[j, 1])
                shared = w * h if w > 0 and h > 0 else 0.0
                part = shared / max(1, min(a, b))
                if part < LEAST:
                    continue
                if shared / (a + b - shared) > SAME:
                    if worth[i] >= worth[j]:
                        gone[j] = True
                        continue
                    gone[i] = True
                    break
                if part < MOST and parent[i] == parent[j]:
                    large, small = (i, j) if a >= b else (j, i)
                    box[large] = _trim(box[large], box[small])
        page[["x", "y", "w", "h"]] = box
        return page[~gone]

    return regions.groupBy(*keys).applyInPandas(fold, regions.schema)


def snapped(regions: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """regions whose edges lie on the middle of the run of edges (at most tolerance apart) they belong to, if that is as near; at least 2 wide and high.

    Runs are more than the tolerance apart, so no other run's middle can be as near."""
    edge = lambda side, value: F.struct(F.lit(side).alias("side"), value.alias("v"))
    lines = F.array(edge("left", F.col("x")), edge("right", F.col("x") + F.col("w")), edge("top", F.col("y")), edge("bottom", F.col("y") + F.col("h")))
    e = regions.select(*keys, "id", F.explode(lines).alias("e")).select(*keys, "id", "e.side", "e.v", F.col("e.side").isin("left", "right").alias("across"))
    w = Window.partitionBy(*keys, "across").orderBy("v")
    e = e.withColumn("new", F.when(F.col("v") - F.lag("v").over(w) > tolerance, 1).otherwise(0))
    e = e.withColumn("run", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    middle = F.avg("v").over(Window.partitionBy(*keys, "across", "run"))
    e = e.withColumn("middle", middle).withColumn("at", F.when(F.abs(F.col("v") - F.col("middle")) <= tolerance, F.round("middle", 2)).otherwise(F.col("v")))
    at = e.groupBy(*keys, "id").agg(*(F.max(F.when(F.col("side") == s, F.col("at"))).alias(f"__{s}") for s in ("left", "right", "top", "bottom")))
    r = regions.join(at, [*keys, "id"])
    new = {"x": F.col("__left"), "y": F.col("__top"), "w": F.greatest(F.lit(TINY), F.col("__right") - F.col("__left")), "h": F.greatest(F.lit(TINY), F.col("__bottom") - F.col("__top"))}
    return r.select(*(new.get(c, F.col(c)).alias(c) for c in regions.columns))


def _runs(box: np.ndarray, ids: np.ndarray, axis: int) -> list[tuple[np.ndarray, int, float]]:
    """(places, side, size) of aligned runs of three or more: side 3 is the height, 2 the width. axis 1: centres at like heights, 0: at like x."""
    size, other = (3, 2) if axis else (2, 3)
    center = box[:, axis] + box[:, size] / 2
    order = np.lexsort((ids, center))
    cuts = np.flatnonzero(np.diff(center[order]) > STEP) + 1
    found = []
    for run in np.split(order, cuts):
        if len(run) < 3:
            continue
        run = run[np.lexsort((ids[run], box[run, 1 - axis]))]
        like = lambda s: (np.abs(box[run, s] - (m := np.median(box[run, s]))) / max(1, m) < LIKE).all()  # noqa: B023, E731
        if like(size):
            found.append((run, size, float(np.median(box[run, size]))))
            if like(other):
                found.append((run, other, float(np.median(box[run, other]))))
    return found


def with_equal_sizes(regions: DataFrame, keys: list[str]) -> DataFrame:
    """regions of aligned runs with the median size where theirs is within a fifth of it, and gaps of less than 8 along the run closed halfway."""

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("id").reset_index(drop=True)
        box, ids = page[["x", "y", "w", "h"]].to_numpy(float), page["id"].to_numpy()
        if len(box) >= 3:
            for axis, (run, side, size) in [(axis, r) for axis in (1, 0) for r in _runs(box.copy(), ids, axis)]:
                for k in run:
                    off = abs(box[k, side] - size)
                    if off / max(1, size) < SMALL and off > MOVED:
                        center = box[k, side - 2] + box[k, side] / 2
                        box[k, side], box[k, side - 2] = size, center - size / 2
                along = 1 - axis
                for p, q in zip(run, run[1:]):
                    gap = box[q, along] - (box[p, along] + box[p, along + 2])
                    if 0 < gap < GAP:
                        middle = box[p, along] + box[p, along + 2] + gap / 2
                        box[p, along + 2] = middle - box[p, along]
                        box[q, along + 2] = box[q, along] + box[q, along + 2] - middle
                        box[q, along] = middle
        page[["x", "y", "w", "h"]] = box
        return page

    return regions.groupBy(*keys).applyInPandas(fold, regions.schema)


def refined(regions: DataFrame, keys: list[str]) -> DataFrame:
    """All steps: overlaps, edges snapped at 6, equal sizes, edges snapped at 4; pages of one region stay as they are."""
    names = [f.name for f in regions.schema.fields]
    regions = regions.withColumns({c: F.col(c).cast(T.DoubleType()) for c in "xywh"}).select(*names)
    n = regions.withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    alone, more = n.where("__n = 1").select(*names), n.where("__n > 1").select(*names)
    done = snapped(with_equal_sizes(snapped(without_overlaps(more, keys), keys, SNAPS[0]), keys), keys, SNAPS[1])
    return alone.unionByName(done.select(*names))
