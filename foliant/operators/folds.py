"""Order-dependent operators: each group is one page or one document pair, folded in Arrow batches by applyInPandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import half_up
from .scratch import dropped, written
from .spatial import near_pairs, overlap

#: How the centre of a line follows its tokens.
UPDATES = ("biased", "midpoint", "mean")
#: Pairs of a group that one task may fold.
MOST_PAIRS = 1_000_000


def _schema(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in more.items())])


def group_lines(tokens: DataFrame, keys: list[str], tolerance: float = 4.0, update: str = "biased") -> DataFrame:
    """tokens with line: in (y, x) order a token joins the first line whose centre is within tolerance.

    Centres never pass the token at hand, so once a line is out of reach it stays so: only the newest line is looked at.

    biased: the running mean with the line's earlier tokens counted once more; midpoint: halfway to the token; mean: the mean of centres."""
    if update not in UPDATES:
        raise ValueError(f"update must be one of {UPDATES}")

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.assign(__c=page.y + page.h / 2).sort_values(["__c", "x", "id"], kind="stable")
        centers: list[float] = []
        count: list[int] = []
        lines = []
        for c in page["__c"]:
            k = len(centers) - 1
            if k < 0 or abs(centers[k] - c) > tolerance:
                k += 1
                centers.append(c)
                count.append(1)
            else:
                count[k] += 1
                n = count[k]
                centers[k] = {"biased": (centers[k] * n + c) / (n + 1), "midpoint": (centers[k] + c) / 2, "mean": centers[k] + (c - centers[k]) / n}[update]
            lines.append(k)
        return page.drop(columns="__c").assign(line=np.array(lines, np.int32))

    return tokens.groupBy(*keys).applyInPandas(fold, _schema(tokens, line=T.IntegerType()))


def stack_blocks(lines: DataFrame, keys: list[str], gap: float = 20.0, least: float = 0.25) -> DataFrame:
    """lines with block: first fit by vertical gap and share of overlap across."""

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x", "id"], kind="stable")
        blocks: list[list[float]] = []
        out = []
        for x, y, w, h in zip(page.x, page.y, page.w, page.h):
            for k, (bx, _, br, bb) in enumerate(blocks):
                over = min(x + w, br) - max(x, bx)
                if y - bb <= gap and over >= least * min(w, br - bx):
                    break
            else:
                k = len(blocks)
                blocks.append([x, y, x + w, y + h])
            b = blocks[k]
            blocks[k] = [min(b[0], x), min(b[1], y), max(b[2], x + w), max(b[3], y + h)]
            out.append(k)
        return page.assign(block=np.array(out, np.int32))

    return lines.groupBy(*keys).applyInPandas(fold, _schema(lines, block=T.IntegerType()))


def suppress(boxes: DataFrame, keys: list[str], most: float = 0.25) -> DataFrame:
    """Non-maximum suppression: by falling score, a box stays unless it shares more than `most` of its area with a kept one."""

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["score", "id"], ascending=[False, True], kind="stable")
        kept: list[tuple] = []
        rows = []
        for i, (x, y, w, h) in enumerate(zip(page.x, page.y, page.w, page.h)):
            share = lambda b: max(0.0, min(x + w, b[0] + b[2]) - max(x, b[0])) * max(0.0, min(y + h, b[1] + b[3]) - max(y, b[1]))  # noqa: B023, E731
            if all(share(b) <= most * w * h for b in kept):
                kept.append((x, y, w, h))
                rows.append(i)
        return page.iloc[rows]

    return boxes.groupBy(*keys).applyInPandas(fold, boxes.schema)


def assign_greedy(pairs: DataFrame, keys: list[str], a: str, b: str, score: str) -> DataFrame:
    """One-to-one pairs by falling score, each side used once; ties by the ids."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([score, a, b], ascending=[False, True, True], kind="stable")
        left, right, rows = set(), set(), []
        for i, (x, y) in enumerate(zip(group[a], group[b])):
            if x not in left and y not in right:
                left.add(x)
                right.add(y)
                rows.append(i)
        return group.iloc[rows]

    return pairs.groupBy(*keys).applyInPandas(fold, pairs.schema)


def assign_boxes(left: DataFrame, right: DataFrame, keys: list[str], size: float, most: int = MOST_PAIRS) -> DataFrame:
    """keys, a, b, score: assign_greedy() of the boxes (id, x, y, w, h) that overlap, by shared area rounded to nine decimals.

    While a group has more than `most` pairs, all pairs that are the best of both their boxes are taken at once: those the greedy order takes
    in any case. Pairs are only summed up for that, never gathered; the rest is folded. Every round is written."""
    box = [*keys, "id", *"xywh"]
    score = half_up(overlap(), 9)
    left, right, found, old = left.select(*box), right.select(*box), None, []

    def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
        return near_pairs(a, b, keys, size).withColumn("score", score).where("score > 0")

    def end(p: str) -> list:
        return [*(F.col(f"{p}_{k}").alias(k) for k in keys), F.col(f"{p}_id").alias("id")]

    def flat(p: DataFrame) -> DataFrame:
        return p.select(*(F.col(f"a_{k}").alias(k) for k in keys), F.col("a_id").alias("a"), F.col("b_id").alias("b"), "score")

    while (pairs(left, right).groupBy(*(f"a_{k}" for k in keys)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > most:
        top = [written(pairs(left, right).groupBy(*end(p)).agg(F.max("score").alias("top")), "top") for p in "ab"]
        l, r = (df.join(t.hint("merge"), [*keys, "id"]) for df, t in zip((left, right), top))
        hit = written(pairs(l, r).where("score = a_top or score = b_top").select("*"), "hit")
        a = hit.where("score = a_top").groupBy(*end("a")).agg(F.min("b_id").alias("b")).withColumnRenamed("id", "a")
        b = hit.where("score = b_top").groupBy(*end("b")).agg(F.min("a_id").alias("a")).withColumnRenamed("id", "b")
        both = flat(hit).join(a.hint("merge"), [*keys, "a", "b"]).join(b.hint("merge"), [*keys, "a", "b"])
        new = written(both.select(*keys, "a", "b", "score"), "pairs")
        found = new if found is None else found.unionByName(new)
        free = lambda df, side: written(df.join(new.select(*keys, F.col(side).alias("id")).hint("merge"), [*keys, "id"], "left_anti"), "free")  # noqa: B023, E731
        left, right = free(left, "a"), free(right, "b")
        dropped(*top, hit, *old)
        old = [left, right]
    rest = assign_greedy(flat(pairs(left, right)), keys, "a", "b", "score")
    return rest if found is None else found.unionByName(rest)


def leader_families(examples: DataFrame, keys: list[str], order: str, vector: str = "features", least: float = 0.70) -> DataFrame:
    """examples with family and its moving centroid's similarity: in order, an example joins the most similar family of at
    least `least`, else founds one; centroids move by 1 / min(n, 10)."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        centers: list[np.ndarray] = []
        size: list[int] = []
        family, alike = [], []
        for v in group[vector]:
            v = np.asarray(v, float)
            s = [float(np.exp(-np.abs(c - v).mean())) for c in centers]
            k = int(np.argmax(s)) if s else -1
            if k >= 0 and s[k] >= least:
                size[k] += 1
                centers[k] = centers[k] + (v - centers[k]) / min(size[k], 10)
                alike.append(s[k])
            else:
                k = len(centers)
                centers.append(v)
                size.append(1)
                alike.append(1.0)
            family.append(k)
        return group.assign(family=np.array(family, np.int32), similarity=np.array(alike))

    return examples.groupBy(*keys).applyInPandas(fold, _schema(examples, family=T.IntegerType(), similarity=T.DoubleType()))


def hulls(points: DataFrame, keys: list[str]) -> DataFrame:
    """Convex hull (monotone chain) of each group's points: keys, place, x, y."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        p = sorted(set(zip(group.x.astype(float), group.y.astype(float))))

        def half(points):
            out: list[tuple] = []
            for q in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out

        ring = p if len(p) < 3 else half(p)[:-1] + half(p[::-1])[:-1]
        head = {k: [group[k].iloc[0]] * len(ring) for k in keys}
        return pd.DataFrame(head | {"place": np.arange(len(ring), dtype=np.int32), "x": [q[0] for q in ring], "y": [q[1] for q in ring]})

    fields = [points.schema[k] for k in keys] + [T.StructField("place", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]
    return points.groupBy(*keys).applyInPandas(fold, T.StructType(fields))


def robust_affine(pairs: DataFrame, keys: list[str], rounds: int = 5, mad: float = 3.0) -> DataFrame:
    """Weighted least-squares affine transform (x, y) -> (u, v) per group, dropping residuals beyond the median + mad * 1.4826 MAD."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        x, y, u, v, w = (group[c].to_numpy(float) for c in ("x", "y", "u", "v", "weight"))
        keep = np.ones(len(x), bool)
        t = np.array([1, 0, 0, 1, 0, 0], float)
        for _ in range(rounds):
            m = np.column_stack([x, y, np.ones(len(x))])
            root = np.sqrt(w[keep])[:, None]
            if keep.sum() < 3:
                break
            a, _, rank, _ = np.linalg.lstsq(m[keep] * root, np.column_stack([u, v])[keep] * root, rcond=None)
            if rank < 3:
                break
            t = np.array([a[0, 0], a[1, 0], a[0, 1], a[1, 1], a[2, 0], a[2, 1]])
            r = np.hypot(*(m @ a - np.column_stack([u, v])).T)
            middle = np.median(r[keep])
            new = r <= middle + mad * 1.4826 * max(np.median(np.abs(r[keep] - middle)), 1e-9)
            if (new == keep).all() or new.sum() < 3:
                break
            keep = new
        return pd.DataFrame({k: [group[k].iloc[0]] for k in keys} | dict(zip(("a", "b", "c", "d", "tx", "ty"), ([z] for z in t))) | {"used": [int(keep.sum())], "dropped": [int((~keep).sum())]})

    fields = [pairs.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in ("a", "b", "c", "d", "tx", "ty")] + [T.StructField(c, T.LongType()) for c in ("used", "dropped")]
    return pairs.groupBy(*keys).applyInPandas(fold, T.StructType(fields))
