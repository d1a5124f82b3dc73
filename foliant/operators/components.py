"""Connected components of an edge table, by alternating star contraction; every step is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import dropped, written
from .spatial import cells, near_pairs, overlap


def components(nodes: DataFrame, edges: DataFrame, a: str = "a", b: str = "b", node: str = "node") -> DataFrame:
    """node, component (the smallest node of the component) of every node; edges are undirected.

    It ends when a step leaves count and sum of 64-bit hashes of the edges as they were."""
    edge = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = None
    while (sums := edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != mark and sums[0]:
        mark = sums
        low = edge.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        large = written(edge.join(low, edge.v == low.k, "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "edges")
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        up = large.join(low, large.u == low.k).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edge = edge, written(low.select(F.col("k").alias("u"), F.col("m").alias("v")).union(up).distinct(), "edges")
        dropped(before, large)
    roots = edge.select(F.col("u").alias("__u"), F.col("v").alias("__v"))
    return nodes.select(node).join(roots, F.col(node) == F.col("__u"), "left").select(node, F.coalesce("__v", node).alias("component"))


def overlapping(boxes: DataFrame, keys: list[str], size: float, step: float) -> DataFrame:
    """id, component (the smallest id) of boxes (id, x, y, w, h; ids unique over all keys) that share an area within keys.

    Boxes round the same point of a grid of the given step overlap, so each is tied to the first of its points. Pairs are formed only of
    boxes in cells (of the given size) that hold more than one of the components found so."""
    span = lambda c, side: F.explode(F.sequence(F.floor(F.col(c) / step), F.ceil((F.col(c) + F.col(side)) / step)))
    inside = lambda p, c, side: (F.col(c) < F.col(p) * step) & (F.col(p) * step < F.col(c) + F.col(side))
    points = boxes.withColumn("i", span("x", "w")).where(inside("i", "x", "w")).withColumn("j", span("y", "h")).where(inside("j", "y", "h")).select(*keys, "i", "j", "id")
    first = points.groupBy(*keys, "i", "j").agg(F.min("id").alias("b"))
    near = written(components(boxes, points.join(first.hint("merge"), [*keys, "i", "j"]).select(F.col("id").alias("a"), "b"), node="id"), "near")
    b = boxes.select(*keys, "id", *"xywh").join(near.hint("merge"), "id")
    at = b.select(*keys, "id", "component", cells(F.col("x"), F.col("y"), F.col("w"), F.col("h"), size).alias("cell"))
    mixed = at.groupBy(*keys, "cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(*keys, "cell")
    some = written(b.join(at.join(mixed.hint("merge"), [*keys, "cell"]).select("id").distinct().hint("merge"), "id", "left_semi"), "mixed")
    pairs = near_pairs(some, some, keys, size).where((F.col("a_id") < F.col("b_id")) & (F.col("a_component") != F.col("b_component")) & (overlap() > 0))
    ends = lambda f: f("a_component", "b_component")
    edges = pairs.select(ends(F.greatest).alias("a"), ends(F.least).alias("b")).distinct()
    whole = components(near.select("component").distinct(), edges, node="component").toDF("component", "whole")
    return near.join(whole.hint("merge"), "component").select("id", F.col("whole").alias("component"))
