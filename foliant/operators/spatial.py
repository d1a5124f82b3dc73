"""Joins over positioned tokens and regions. Every join is an equi-join on document, page and grid cells with the exact
predicate behind it, so no pair beyond neighbouring cells is formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .dedupe import first_by


def cells(x: Column, y: Column, w: Column, h: Column, size: float, reach: Column | float = 0.0) -> Column:
    """Grid cells that a box, grown by reach, touches."""
    span = lambda a, b: F.sequence(F.floor((a - reach) / size), F.floor((b + reach) / size))
    return F.explode(F.flatten(F.transform(span(x, x + w), lambda i: F.transform(span(y, y + h), lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def _tagged(df: DataFrame, p: str, keys: list[str], size: float, reach: Column) -> DataFrame:
    c = df.select(*(F.col(k).alias(f"{p}_{k}") for k in df.columns))
    g = lambda k: F.col(f"{p}_{k}")
    return c.withColumn(f"{p}_cell", cells(g("x"), g("y"), g("w"), g("h"), size, reach))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df by hash of columns in as many partitions as shuffles have; small tables whose joins grow are not put together into few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def near_pairs(a: DataFrame, b: DataFrame, keys: list[str], size: float, reach: float | Column = 0.0) -> DataFrame:
    """Pairs (columns a_*, b_*) within keys whose boxes, a grown by reach (a number or a column of a), share a cell; each once. Columns id, x, y, w, h are needed.

    Both sides are spread over all partitions by cell and merged, so that no side is broadcast by the size of its files, however many
    pairs there are of a small table."""
    at = reach if isinstance(reach, Column) else F.lit(float(reach))
    a = a.withColumn("__reach", at)
    x, y = _tagged(a, "a", keys, size, F.col("a___reach")), _tagged(b, "b", keys, size, F.lit(0.0))
    low = lambda p, c, r: F.floor((F.col(f"{p}_{c}") - r) / size)
    x = x.withColumns({f"__a{c}": low("a", c, F.col("a___reach")) for c in "xy"}).drop("a___reach")
    y = y.withColumns({f"__b{c}": low("b", c, F.lit(0.0)) for c in "xy"})
    cond = [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys] + [F.col("a_cell") == F.col("b_cell")]
    x = spread(x, *(f"a_{k}" for k in keys), "a_cell")
    y = spread(y, *(f"b_{k}" for k in keys), "b_cell").hint("merge")
    first = (F.col("a_cell.i") == F.greatest("__ax", "__bx")) & (F.col("a_cell.j") == F.greatest("__ay", "__by"))
    return x.join(y, cond).where(first).drop("a_cell", "b_cell", "__ax", "__ay", "__bx", "__by")


#: How often the widest cells are halved, and into how many rings of equal area a circle is counted.
LEVELS, RINGS, SLACK = 8, 8, 1 + 1e-9


def _at_levels(points: DataFrame, widest: float) -> DataFrame:
    """points (__px, __py) with their cell __i, __j at every level __l, whose cells are widest / 2^l wide."""
    q = F.pow(F.lit(2.0), F.col("__l")) / widest
    return points.withColumn("__l", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumns({"__i": F.floor(F.col("__px") * q), "__j": F.floor(F.col("__py") * q)})


def close_pairs(a: DataFrame, b: DataFrame, keys: list[str], widest: float, coarser: int = 0) -> DataFrame:
    """Pairs (columns a_*, b_*) within keys of points (__px, __py) of which b's lies in the square of __reach around a's, or a little beyond; each once.

    Every row of a meets b in the cells of the level whose width fits its own __reach, or so many levels above: fewer copies, more pairs."""
    level = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(F.log2(F.lit(float(widest)) / F.greatest("__reach", F.lit(1e-300)))) - coarser)).cast("int")
    q = F.pow(F.lit(2.0), F.col("__l")) / widest
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("__reach")) * q), F.floor((F.col(c) + F.col("__reach")) * q)))
    x = a.withColumn("__l", level).withColumn("__i", span("__px")).withColumn("__j", span("__py"))
    x, y = (df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns)) for p, df in (("a", x), ("b", _at_levels(b, widest))))
    on = [*keys, "__l", "__i", "__j"]
    x, y = spread(x, *(f"a_{c}" for c in on)), spread(y, *(f"b_{c}" for c in on)).hint("merge")
    return x.join(y, [F.col(f"a_{c}") == F.col(f"b_{c}") for c in on]).drop(*(f"{p}_{c}" for p in "ab" for c in on[-3:]))


def _apart() -> Column:
    dx, dy = F.col("a___px") - F.col("b___px"), F.col("a___py") - F.col("b___py")
    return dx * dx + dy * dy


def enough(a: DataFrame, b: DataFrame, keys: list[str], k: int, widest: float) -> DataFrame:
    """Points a (id, __px, __py) with __reach, at most widest, within which at least k points of b lie; widest if fewer do.

    The smallest cell around a point that holds k gives a first circle, and counts of its rings a smaller one. Points are counted
    by cell, pairs are only summed up: no pair is sorted or shuffled."""
    mine = a.select(*keys, "id", "__px", "__py")
    cell = [*keys, "__l", "__i", "__j"]
    full = _at_levels(b.select(*keys, "__px", "__py"), widest).groupBy(*cell).agg(F.count("*").alias("__n")).where(F.col("__n") >= k).drop("__n")
    best = _at_levels(mine, widest).join(full, cell).groupBy(*keys, "id", "__px", "__py").agg(F.max("__l").alias("__l"))
    point = [*keys, "id", "__px", "__py"]
    circle = F.least(F.lit(float(widest)), F.lit(2**0.5 * SLACK * widest) / F.pow(F.lit(2.0), F.col("__l")))
    first = mine.join(best.hint("merge"), point, "left").select(*point, F.coalesce(circle, F.lit(float(widest))).alias("__reach"))
    p = close_pairs(first, b.select(*keys, "__px", "__py"), keys, widest)
    square = F.col("a___reach") * F.col("a___reach")
    near = p.groupBy(*(F.col(f"a_{c}").alias(c) for c in point), F.col("a___reach").alias("__reach")).agg(*(F.count_if(_apart() <= square * (m / RINGS)).alias(f"__r{m}") for m in range(1, RINGS)))
    ring = F.coalesce(*(F.when(F.col(f"__r{m}") >= k, F.col("__reach") * ((m / RINGS) ** 0.5 * SLACK)) for m in range(1, RINGS)), F.col("__reach"))
    return a.join(near.select(*point, F.least(F.lit(float(widest)), ring).alias("__reach")).hint("merge"), point, "left").withColumn("__reach", F.coalesce("__reach", F.lit(float(widest))))


def nearest_pairs(a: DataFrame, b: DataFrame, keys: list[str], k: int, widest: float, place: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Pairs (columns a_*, b_*) of points (id, __px, __py) among which are the k nearest of b, ties by id, to every one of a within widest.

    Some are farther; of rows of b with equal place those beyond the first k by id are not among them."""
    b = first_by(b, [*keys, *place], ["id"], k)
    p = close_pairs(enough(a, b, keys, k, widest), b, keys, widest)
    return p.where(_apart() <= F.col("a___reach") * F.col("a___reach") * SLACK).drop(*(f"{p}_{c}" for p in "ab" for c in ("__px", "__py")), "a___reach")


def centred(df: DataFrame) -> DataFrame:
    return df.withColumns({"__px": F.col("x") + F.col("w") / 2, "__py": F.col("y") + F.col("h") / 2})


def overlap(a: str = "a", b: str = "b") -> Column:
    g = lambda p, c: F.col(f"{p}_{c}")
    side = lambda c, s: F.greatest(F.lit(0.0), F.least(g(a, c) + g(a, s), g(b, c) + g(b, s)) - F.greatest(g(a, c), g(b, c)))
    return side("x", "w") * side("y", "h")


def iou_best(humans: DataFrame, autos: DataFrame, keys: list[str], least: float = 0.3, size: float = 0.25) -> DataFrame:
    """Each human box's best auto box by IoU of at least `least`; auto_id null where missed. One auto may serve several."""
    p = near_pairs(humans, autos, keys, size)
    shared = overlap()
    union = F.col("a_w") * F.col("a_h") + F.col("b_w") * F.col("b_h") - shared
    p = p.withColumn("iou", F.try_divide(shared, union)).where(F.col("iou") >= least)
    best = first_by(p, [*(f"a_{k}" for k in keys), "a_id"], [F.desc("iou"), "b_id"]).select(*(F.col(f"a_{k}").alias(k) for k in keys), F.col("a_id").alias("id"), F.col("b_id").alias("auto_id"), "iou")
    return humans.select(*keys, "id").join(best, [*keys, "id"], "left")


def extras(autos: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Auto boxes that no human box chose."""
    used = matched.where("auto_id is not null").select(*keys, F.col("auto_id").alias("id")).distinct()
    return autos.select(*keys, "id").join(used, [*keys, "id"], "left_anti")


def tokens_in_boxes(tokens: DataFrame, boxes: DataFrame, keys: list[str], rule: str = "center", least: float = 0.5, size: float = 50.0) -> DataFrame:
    """Token-box pairs: center inside; vertical (centre across, share of height); area (share of the token's area)."""
    p = near_pairs(tokens, boxes, keys, size)
    g = F.col
    cx, cy = g("a_x") + g("a_w") / 2, g("a_y") + g("a_h") / 2
    across = cx.between(g("b_x"), g("b_x") + g("b_w"))
    dy = F.least(g("a_y") + g("a_h"), g("b_y") + g("b_h")) - F.greatest(g("a_y"), g("b_y"))
    test = {"center": across & cy.between(g("b_y"), g("b_y") + g("b_h")), "vertical": across & (dy >= least * g("a_h")), "area": overlap() >= least * g("a_w") * g("a_h")}
    return p.where(test[rule])


def box_text(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Text of every box: tokens by vertical centre, then x, joined by spaces. The list is that of one box."""
    t = F.struct((F.col("a_y") + F.col("a_h") / 2).alias("cy"), F.col("a_x").alias("x"), F.col("a_id").alias("id"), F.col("a_text").alias("text"))
    return hits.groupBy(*(F.col(f"a_{k}").alias(k) for k in keys), F.col("b_id").alias("box_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(t)), lambda r: r["text"]), " ").alias("text"), F.count("*").alias("hits"))


def lookahead_edges(tokens: DataFrame, keys: list[str], ahead: int = 17) -> DataFrame:
    """Edges to the next tokens in (centre y, centre x) order: same_line, vertical_near or near; boxes are normalised to the page."""
    w = Window.partitionBy(*keys).orderBy(F.col("y") + F.col("h") / 2, F.col("x") + F.col("w") / 2, "id")
    t = tokens.withColumn("rn", F.row_number().over(w)).withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2)
    here = t.select(*keys, F.col("id").alias("a_id"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.explode(F.sequence(F.col("rn") + 1, F.col("rn") + ahead)).alias("rn"))
    p = here.join(t.select(*keys, "rn", F.col("id").alias("b_id"), F.col("cx").alias("bx"), F.col("cy").alias("by")), [*keys, "rn"])
    dx, dy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
    kind = F.when((dy <= 0.015) & (dx <= 0.35), "same_line").when((dx <= 0.06) & (dy <= 0.2), "vertical_near").when((dx <= 0.25) & (dy <= 0.12), "near")
    return p.withColumn("edge_type", kind).where("edge_type is not null").select(*keys, "a_id", "b_id", "edge_type")


def region_edges(regions: DataFrame, keys: list[str], reach: float = 800.0, tolerance: float = 8.0) -> DataFrame:
    """Edges between regions (id, x, y, w, h, confidence, source, depth) whose centres are within 0.9 of reach, or which touch.

    spatial_proximity: (1 - distance / reach) times likeness of confidence and source, above 0.08; contains, container
    first: 0.95 for direct children, less by depth; spatial_adjacency: by the shared part of the shorter side, above 0.15."""
    p = near_pairs(regions, regions, keys, reach / 2, reach).where("a_id < b_id")
    g = F.col
    inside = lambda a, b: (g(f"{a}_x") <= g(f"{b}_x")) & (g(f"{a}_y") <= g(f"{b}_y")) & (g(f"{a}_x") + g(f"{a}_w") >= g(f"{b}_x") + g(f"{b}_w")) & (g(f"{a}_y") + g(f"{a}_h") >= g(f"{b}_y") + g(f"{b}_h"))
    dx = g("a_x") + g("a_w") / 2 - g("b_x") - g("b_w") / 2
    dy = g("a_y") + g("a_h") / 2 - g("b_y") - g("b_h") / 2
    near = F.greatest(F.lit(0.0), 1 - F.sqrt(dx * dx + dy * dy) / reach)
    alike = F.when(g("a_source").eqNullSafe(g("b_source")), 1.0).otherwise(0.85) * F.greatest(F.lit(0.0), 1 - 2 * F.abs(g("a_confidence") - g("b_confidence")))
    steps = F.abs(g("a_depth") - g("b_depth"))
    depth = F.when(steps <= 1, 0.95).otherwise(F.greatest(F.lit(0.5), 0.95 - (steps - 1) * 0.15))
    lap = lambda c, s: F.least(g(f"a_{c}") + g(f"a_{s}"), g(f"b_{c}") + g(f"b_{s}")) - F.greatest(g(f"a_{c}"), g(f"b_{c}"))
    side = lambda c, s, t: F.when((lap(c, s) > tolerance) & (-lap(*t) >= -tolerance) & (-lap(*t) <= tolerance), lap(c, s) / F.greatest(F.lit(1.0), F.least(g(f"a_{s}"), g(f"b_{s}"))))
    shared = F.coalesce(side("y", "h", ("x", "w")), side("x", "w", ("y", "h")))
    p = p.where((near > 0.1) | inside("a", "b") | inside("b", "a") | (shared > 0.15))  # before any edge is built
    edge = lambda cond, a, b, kind, weight: F.when(cond, F.struct(g(f"{a}_id").alias("source_id"), g(f"{b}_id").alias("target_id"), F.lit(kind).alias("edge_type"), weight.alias("weight")))
    edges = F.array(edge((near > 0.1) & (near * alike > 0.08), "a", "b", "spatial_proximity", near * alike), edge(inside("a", "b"), "a", "b", "contains", depth), edge(inside("b", "a") & ~inside("a", "b"), "b", "a", "contains", depth), edge(shared > 0.15, "a", "b", "spatial_adjacency", F.least(F.lit(0.9), 0.4 + shared * 0.5)))
    return p.select(*(g(f"a_{k}").alias(k) for k in keys), F.explode(F.filter(edges, lambda e: e.isNotNull())).alias("e")).select(*keys, "e.*")


def parents(regions: DataFrame, keys: list[str], size: float, ratio: float = 1.1) -> DataFrame:
    """id, parent_id (smallest container of more than ratio times the area), depth (number of containers)."""
    p = near_pairs(regions, regions, keys, size).where("a_id <> b_id")
    g = F.col
    c = (g("b_x") <= g("a_x")) & (g("b_y") <= g("a_y")) & (g("b_x") + g("b_w") >= g("a_x") + g("a_w")) & (g("b_y") + g("b_h") >= g("a_y") + g("a_h"))
    p = p.where(c & (g("b_w") * g("b_h") > ratio * g("a_w") * g("a_h")))
    per = p.groupBy(*(g(f"a_{k}").alias(k) for k in keys), g("a_id").alias("id")).agg(F.min_by("b_id", F.struct(g("b_w") * g("b_h"), g("b_id"))).alias("parent_id"), F.count("*").alias("depth"))
    return regions.select(*keys, "id").join(per, [*keys, "id"], "left").na.fill(0, ["depth"])


def constellation(tokens: DataFrame, pattern: DataFrame, keys: list[str], tolerance: float, least: int = 1) -> DataFrame:
    """Anchors (pattern rows of role anchor) with the supports found within tolerance of their expected offset.

    pattern: pattern_id, role, idx, norm_text, dx, dy. Per anchor token and support the nearest token counts."""
    t = tokens.withColumn("norm", T.keyword_norm(F.col("text"))).withColumn("cx", F.col("x") + F.col("w") / 2).withColumn("cy", F.col("y") + F.col("h") / 2)
    a = pattern.where("role = 'anchor'").select("pattern_id", F.col("norm_text").alias("norm"))
    anchors = t.join(a, "norm").select(*keys, "pattern_id", F.col("id").alias("anchor_id"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    wanted = anchors.join(pattern.where("role = 'support'").select("pattern_id", "idx", F.col("norm_text").alias("norm"), "dx", "dy"), "pattern_id")
    p = wanted.join(t.select(*keys, "norm", F.col("id").alias("token_id"), "cx", "cy"), [*keys, "norm"])
    ex, ey = F.abs(F.col("cx") - F.col("ax") - F.col("dx")), F.abs(F.col("cy") - F.col("ay") - F.col("dy"))
    hit = p.where((ex <= tolerance) & (ey <= tolerance) & (F.col("token_id") != F.col("anchor_id"))).withColumn("error", F.sqrt(ex * ex + ey * ey))
    best = first_by(hit, [*keys, "pattern_id", "anchor_id", "idx"], ["error", "token_id"])
    n = pattern.where("role = 'support'").groupBy("pattern_id").agg(F.count("*").alias("supports"))
    m = best.groupBy(*keys, "pattern_id", "anchor_id").agg(F.count("*").alias("matched"), F.sum("error").alias("total_error"))
    return m.join(n, "pattern_id").where(F.col("matched") >= least)


def capture(tokens: DataFrame, boxes: DataFrame, keys: list[str], reach: float, k: int = 5) -> DataFrame:
    """The k nearest tokens of each box within reach: rank 1 is the anchor, the others its supports."""
    p = nearest_pairs(centred(boxes), centred(tokens), keys, k, reach * SLACK, tuple("xywh"))
    g = F.col
    dx, dy = -(g("a_x") + g("a_w") / 2 - g("b_x") - g("b_w") / 2), -(g("a_y") + g("a_h") / 2 - g("b_y") - g("b_h") / 2)  # subtracted from the box's side: equal distances stay equal
    p = p.withColumn("dx", dx).withColumn("dy", dy).withColumn("distance", F.sqrt(dx * dx + dy * dy)).where(F.col("distance") <= reach)
    w = Window.partitionBy(*(f"a_{c}" for c in keys), "a_id").orderBy("distance", "b_id")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def area_capture(tokens: DataFrame, areas: DataFrame, keys: list[str], k: int = 7, most: int = 12, size: float = 0.1) -> DataFrame:
    """keys, area_id, token_id, rank, dx, dy of the tokens whose centre is in an area, nearest to its centre first: rank 1 is the anchor, dx and
    dy lead from it to the others. At most k supports, `most` if asked for."""
    p = tokens_in_boxes(tokens, areas, keys, "center", size=size)
    g = F.col
    cx, cy = g("a_x") + g("a_w") / 2, g("a_y") + g("a_h") / 2
    away = F.hypot(cx - g("b_x") - g("b_w") / 2, cy - g("b_y") - g("b_h") / 2)
    p = p.select(*(g(f"a_{c}").alias(c) for c in keys), g("b_id").alias("area_id"), g("a_id").alias("token_id"), cx.alias("cx"), cy.alias("cy"), away.alias("distance"))
    area = Window.partitionBy(*keys, "area_id")
    p = p.withColumn("rank", F.row_number().over(area.orderBy("distance", "token_id"))).where(g("rank") <= 1 + min(k, most))
    first = lambda c: F.max(F.when(g("rank") == 1, g(c))).over(area)
    return p.select(*keys, "area_id", "token_id", "rank", (g("cx") - first("cx")).alias("dx"), (g("cy") - first("cy")).alias("dy"))


def row_bands(tokens: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """Tokens with a band number: a new band where the centre lies more than gap below the one before."""
    w = Window.partitionBy(*keys).orderBy("cy", "id")
    t = tokens.withColumn("cy", F.col("y") + F.col("h") / 2)
    t = t.withColumn("new", F.when(F.col("cy") - F.lag("cy").over(w) > gap, 1).otherwise(0))
    return t.withColumn("band", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def clusters(values: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Values with cluster number and center: gaps above tolerance part clusters."""
    w = Window.partitionBy(*keys).orderBy(value)
    c = values.withColumn("__new", F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0))
    c = c.withColumn("cluster", F.sum("__new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("__new")
    return c.withColumn("center", F.avg(value).over(Window.partitionBy(*keys, "cluster")))


def gaps(intervals: DataFrame, keys: list[str], start: str, end: str, least: float) -> DataFrame:
    """Uncovered stretches of at least `least` between intervals."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    g = intervals.withColumn("gap_start", F.max(end).over(w))
    return g.where(F.col(start) - F.col("gap_start") >= least).select(*keys, "gap_start", F.col(start).alias("gap_end"))


def bounds(boxes: DataFrame, keys: list[str]) -> DataFrame:
    return boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"))
