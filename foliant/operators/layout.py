"""Areas, layouts, grids and text graphs over positioned tokens, lines and regions.

Every join is an equi-join on the document keys with a text, a category, a band or a grid cell, unless a docstring says
otherwise. Tables need the columns named beside the keys; null keys never match, and empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .components import components
from .dedupe import first_by
from .spatial import SLACK, close_pairs, enough, near_pairs, nearest_pairs, overlap, spread

#: Parts of an area's confidence, of a layout's penalty, of a keyword's score and of a geometry's likeness.
AREA = {"edges": 0.65, "supports": 0.25, "closeness": 0.1}
LAYOUT = {"position": 0.6, "edge": 0.4, "tolerance": 0.08}
KEYWORD = {"near": 0.7, "text": 0.25, "size": 0.05, "radius": 0.35}
GEOMETRY = {"width": 0.25, "height": 0.25, "ratio": 0.2, "position": 0.3}
#: How far apart the centres of neighbouring lines may lie, and the shares of a page a cell may have.
LINE_DX, LINE_DY = 400.0, 20.0
FARTHER = 16
WIDEST = 0.25  # the widest circle, in page sizes, in which a support is looked for before the whole tolerance
CELL = 1000.0  # the widest cells in which keywords are looked for
THIN, LEAST_CELL, LEAST_MERGED, MOST_MERGED = 5.0, 0.005, 0.008, 0.9


def _unit(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))  # greatest and least pass over nulls


def _mid(at: str, side: str) -> Column:
    return F.col(at) + F.col(side) / 2


def _away(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _as(df: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    return df.select(*keys, *(F.col(old).alias(new) for old, new in names.items()))


def scoped(tokens: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, id of the tokens that each field of the document sees.

    fields: field, is_area, subordinate, relative (it has an area-relative box), ax, ay, aw, ah (its area, or null). A
    subordinate field with an area sees the tokens that touch the area's height with their centre in its width; any other
    field sees all tokens, so the result has a row for each field and token of a document."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    bound = ~flag("is_area") & (flag("subordinate") | flag("relative")) & F.col("ax").isNotNull()
    lap = F.least(F.col("y") + F.col("h"), F.col("ay") + F.col("ah")) - F.greatest("y", "ay")
    inside = _mid("x", "w").between(F.col("ax"), F.col("ax") + F.col("aw")) & (lap >= 0) & (F.col("h") != 0)
    seen = tokens.join(fields.withColumn("__bound", bound), keys).where(~F.col("__bound") | inside)
    return seen.select(*keys, "field", "id")


def wanted(norm: Column, words: list[str] | None) -> Column:
    """Keyword filter: membership in the list; everything passes without a list."""
    return F.lit(True) if words is None else norm.isin(words)


def guard_words(words: Column) -> Column:
    """The distinct non-empty words of a list, normalised, in their first order; a null list is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), T.keyword_norm), lambda w: w != ""))


def layout_scores(candidates: DataFrame, keywords: DataFrame, tokens: DataFrame, keys: list[str]) -> DataFrame:
    """match_ratio, position_penalty and matched of candidate boxes against the layout of their area.

    candidates: candidate, layout, x, y, w, h. keywords: layout, kw, norm, cx, cy (centre in box sizes) and left, top, right,
    bottom (edge offsets in box sizes). tokens: norm, x, y, w, h. Of a keyword's equal tokens within 8 % of the longer side
    the one with least distance and edge error counts. A layout without keywords matches wholly."""
    c = _as(candidates, keys, {"candidate": "candidate", "layout": "layout", "x": "bx", "y": "by", "w": "bw", "h": "bh"})
    w, h = F.greatest(F.lit(1.0), "bw"), F.greatest(F.lit(1.0), "bh")
    one = [*keys, "candidate", "layout", "kw"]
    spots = c.join(keywords, "layout").withColumns({"__most": F.greatest(w, h) * LAYOUT["tolerance"], "__px": F.col("bx") + F.col("cx") * w, "__py": F.col("by") + F.col("cy") * h})
    spots = spots.withColumn("__reach", F.col("__most") * SLACK)
    words = tokens.select(*keys, "norm", "x", "y", "w", "h", _mid("x", "w").alias("__px"), _mid("y", "h").alias("__py")).distinct()

    def hits(spots: DataFrame, *more: str) -> DataFrame:
        p = close_pairs(spots, words, [*keys, "norm"], CELL, 1)
        p = p.select(*(F.col(f"a_{k}").alias(k) for k in (*one, "bx", "by", "bw", "bh", "cx", "cy", "left", "top", "right", "bottom", "__most", *more)), *(F.col(f"b_{k}").alias(k) for k in "xywh"))
        away = _away(_mid("x", "w") - F.col("bx") - F.col("cx") * w, _mid("y", "h") - F.col("by") - F.col("cy") * h)
        sides = {
            "left": (F.col("x") - F.col("bx")) / w,
            "top": (F.col("y") - F.col("by")) / h,
            "right": (F.col("bx") + F.col("bw") - F.col("x") - F.col("w")) / w,
            "bottom": (F.col("by") + F.col("bh") - F.col("y") - F.col("h")) / h,
        }
        edge = F.greatest(*(F.abs(F.coalesce(F.col(k), F.lit(0.0)) - v) for k, v in sides.items()))
        return p.withColumns({"__away": away, "__edge": edge}).where("__away <= __most").withColumn("__place", F.col("__away") / _away(w, h))

    # the least sum needs no sort; only pairs that reach it are looked at again
    least = hits(spots).groupBy(*one).agg(F.min(F.col("__place") + F.col("__edge")).alias("__least"))
    hit = hits(spots.join(least.hint("merge"), one), "__least").where(F.col("__place") + F.col("__edge") == F.col("__least"))
    best = hit.groupBy(*one).agg(F.min_by(F.struct("__place", "__edge"), F.col("__place")).alias("b"))
    got = best.groupBy(*keys, "candidate", "layout").agg(
        F.count("*").alias("matched"),
        F.avg(F.least(F.lit(1.0), "b.__place")).alias("__p"),
        F.avg(F.least(F.lit(1.0), "b.__edge")).alias("__e"),
    )
    n = keywords.groupBy("layout").agg(F.count("*").alias("__n"))
    out = c.select(*keys, "candidate", "layout").join(n, "layout", "left").join(got, [*keys, "candidate", "layout"], "left")
    penalty = _unit(F.col("__p") * LAYOUT["position"] + F.col("__e") * LAYOUT["edge"])
    return out.select(
        *keys, "candidate", "layout",
        F.coalesce("matched", F.lit(0)).alias("matched"),
        F.when(F.col("__n").isNull(), 1.0).otherwise(F.coalesce("matched", F.lit(0)) / F.col("__n")).alias("match_ratio"),
        F.coalesce(penalty, F.lit(0.0)).alias("position_penalty"),
    )


def area_matches(tokens: DataFrame, areas: DataFrame, supports: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes predicted for areas from the constellations of their words, with confidence and rank per document and area.

    tokens: id, norm, cx, cy (centres in page sizes). areas: area, norm, dx, dy (anchor less origin), fw, fh, tolerance, least
    (supports needed). supports: area, idx, norm, dx, dy from the anchor. links: area, a, b, dx, dy between supports. Every token
    with the anchor's word is tried; of each support the nearest token within tolerance counts, ties to the smaller id."""
    at = {"id": "id", "norm": "norm", "cx": "tx", "cy": "ty"}
    anchors = areas.join(_as(tokens, keys, {"id": "anchor_id", "norm": "norm", "cx": "ax", "cy": "ay"}), "norm").drop("norm")
    want = anchors.select(*keys, "area", "anchor_id", "ax", "ay", "tolerance").join(supports, "area")
    # the token that lies nearest in a circle is in the square that holds the nearest by sum of both ways
    spots = want.withColumns({"id": F.struct("area", "anchor_id", "idx"), "__px": F.col("ax") + F.col("dx"), "__py": F.col("ay") + F.col("dy")})
    words = first_by(_as(tokens, keys, at), [*keys, "norm", "tx", "ty"], ["id"]).withColumns({"__px": F.col("tx"), "__py": F.col("ty")})
    spots = enough(spots, words, [*keys, "norm"], 1, WIDEST)
    spots = spots.withColumn("__reach", F.when(F.col("__reach") < WIDEST, F.col("__reach") * 2**0.5).otherwise(F.greatest(F.lit(WIDEST * 2**0.5), "tolerance")) * SLACK)
    one = [*keys, "area", "anchor_id"]

    def hits(spots: DataFrame, *more: str) -> DataFrame:
        p = close_pairs(spots, words, [*keys, "norm"], WIDEST)
        p = p.select(*(F.col(f"a_{c}").alias(c) for c in (*one, "ax", "ay", "tolerance", "idx", "dx", "dy", *more)), *(F.col(f"b_{c}").alias(c) for c in ("id", "tx", "ty")))
        ex, ey = F.abs(F.col("tx") - F.col("ax") - F.col("dx")), F.abs(F.col("ty") - F.col("ay") - F.col("dy"))
        return p.withColumn("error", ex + ey).where((ex <= F.col("tolerance")) & (ey <= F.col("tolerance")))

    # the least error needs no sort; only the tokens that reach it are looked at again
    least = hits(spots).groupBy(*one, "idx").agg(F.min("error").alias("__least"))
    hit = hits(spots.join(least.hint("merge"), [*one, "idx"]), "__least").where(F.col("error") == F.col("__least"))
    best = hit.groupBy(*one, "tolerance", "idx").agg(F.min_by(F.struct("tx", "ty", "error"), F.struct("error", "id")).alias("s"))
    per = best.groupBy(*one).agg(F.count("*").alias("matched"), F.sum("s.error").alias("__e"))
    end = lambda k: best.select(*one, "tolerance", F.col("idx").alias(k), F.col("s").alias(f"__{k}"))
    l = end("a").join(links, ["area", "a"]).join(end("b").drop("tolerance"), [*one, "b"])
    lx = F.abs(F.col("__b.tx") - F.col("__a.tx") - F.col("dx"))
    ly = F.abs(F.col("__b.ty") - F.col("__a.ty") - F.col("dy"))
    linked = l.where((lx <= F.col("tolerance")) & (ly <= F.col("tolerance"))).groupBy(*one).agg(F.count("*").alias("__l"), F.sum(lx + ly).alias("__le"))
    count = lambda df, name: df.groupBy("area").agg(F.count("*").alias(name))
    m = anchors.join(count(supports, "__s"), "area", "left").join(count(links, "__k"), "area", "left")
    m = m.join(per, one, "left").join(linked, one, "left").na.fill(0, ["__s", "__k", "matched", "__l"]).na.fill(0.0, ["__e", "__le"])
    m = m.where(F.col("matched") >= F.col("least"))
    edges = 1 + F.col("matched") + F.col("__l")
    error = F.col("__e") + F.col("__le")
    penalty = F.least(F.lit(1.0), error / edges / F.greatest("tolerance", F.lit(1e-6)))
    sure = edges / (1 + F.col("__s") + F.col("__k")) * AREA["edges"] + F.col("matched") / F.greatest("__s", F.lit(1)) * AREA["supports"] + (1 - penalty) * AREA["closeness"]
    m = m.withColumns({"edges": edges, "error": error, "confidence": _unit(sure)})
    w = Window.partitionBy(*keys, "area").orderBy(F.desc("confidence"), F.desc("edges"), "error", "anchor_id")
    return m.select(*one, (F.col("ax") - F.col("dx")).alias("x"), (F.col("ay") - F.col("dy")).alias("y"), F.col("fw").alias("w"), F.col("fh").alias("h"), "matched", "edges", "error", "confidence", F.row_number().over(w).alias("rank"))


def keyword_matches(relations: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Per relation the keyword of its category that predicts the best box, with distance and score.

    relations: field, category, text, dx, dy, dw, dh, rx, ry, rw, rh (reference box or null). index: id, category, keyword, x, y,
    w, h. All boxes are in page sizes. Predictions over 0.35 from the reference are left out; ties go to the smaller id."""
    p = relations.join(index, [*keys, "category"])
    w, h = F.greatest(F.lit(0.0), F.col("w") + F.col("dw")), F.greatest(F.lit(0.0), F.col("h") + F.col("dh"))
    p = p.withColumns({"px": F.col("x") + F.col("dx"), "py": F.col("y") + F.col("dy"), "pw": w, "ph": h})
    away = F.when(F.col("rx").isNull(), 0.0).otherwise(_away(_mid("px", "pw") - _mid("rx", "rw"), _mid("py", "ph") - _mid("ry", "rh")))
    like = _likeness(F.col("text"), F.col("keyword"))
    wide = F.coalesce("rw", "pw")
    size = F.when(wide > 0, F.abs(F.col("pw") - wide) / wide).otherwise(F.abs(F.col("pw") - wide))
    score = (1 - F.least(F.lit(1.0), away / KEYWORD["radius"])) * KEYWORD["near"] + like * KEYWORD["text"] + (1 - F.least(F.lit(1.0), size)) * KEYWORD["size"]
    p = p.withColumns({"distance": away, "score": score}).where(F.col("distance") <= KEYWORD["radius"])
    return first_by(p, [*keys, "field"], [F.desc("score"), "id"]).select(*keys, "field", "id", "px", "py", "pw", "ph", "distance", "score")


def _likeness(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer normalised text; 0 if either is blank."""
    x, y = T.keyword_norm(a), T.keyword_norm(b)
    return F.when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))


def text_edges(tokens: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of a text graph: token_to_line, line_to_block and line_horizontal_neighbor, which is weighted by nearness.

    tokens: id, line_id. lines: id, block_id, x, y, w, h. Ids order the ends of a neighbour edge; parents may be null."""
    up = lambda df, parent, kind: df.where(F.col(parent).isNotNull()).select(*keys, F.col("id").alias("source_id"), F.col(parent).alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"))
    l = lines.select(*keys, "id", _mid("x", "w").alias("cx"), _mid("y", "h").alias("cy"))
    cell = lambda c, s: F.floor(F.col(c) / s)
    a = l.select(*keys, F.col("id").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), cell("cx", LINE_DX).alias("i"), cell("cy", LINE_DY).alias("j"))
    step = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("s")
    b = l.select(*keys, F.col("id").alias("b"), F.col("cx").alias("bx"), F.col("cy").alias("by"), step)
    b = b.select(*keys, "b", "bx", "by", (cell("bx", LINE_DX) + F.col("s.i")).alias("i"), (cell("by", LINE_DY) + F.col("s.j")).alias("j"))
    dx = F.abs(F.col("ax") - F.col("bx"))
    a, b = spread(a, *keys, "i", "j"), spread(b, *keys, "i", "j").hint("merge")  # a small table has many pairs
    near = a.join(b, [*keys, "i", "j"]).where((F.col("a") < F.col("b")) & (dx < LINE_DX) & (F.abs(F.col("ay") - F.col("by")) < LINE_DY))
    side = near.select(*keys, F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.lit("line_horizontal_neighbor").alias("edge_type"), (1 - dx / LINE_DX).alias("weight"))
    return up(tokens, "line_id", "token_to_line").unionByName(up(lines, "block_id", "line_to_block")).unionByName(side)


def nearest_regions(lines: DataFrame, regions: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Per line the region with the nearest centre (ties to the smaller id) and its distance; null on pages without regions.

    Of regions with one centre only that of the smallest id is looked at. A line meets those of the smallest circle that holds one; only
    lines with none within 16 times the reach meet all regions of their page."""
    centre = lambda df: df.select(*keys, "id", _mid("x", "w").alias("x"), _mid("y", "h").alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    at = lambda df: df.withColumns({"__px": F.col("x"), "__py": F.col("y")})
    l, r = centre(lines), first_by(centre(regions), [*keys, "x", "y"], ["id"])
    near = nearest_pairs(at(l), at(r), keys, 1, FARTHER * reach)
    near = near.withColumn("distance", _away(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")))
    near = near.select(*(F.col(f"a_{k}").alias(k) for k in keys), F.col("a_id").alias("id"), F.col("b_id").alias("region_id"), "distance")
    far = l.join(near.select(*keys, "id"), [*keys, "id"], "left_anti").join(_as(r, keys, {"id": "region_id", "x": "rx", "y": "ry"}), keys)
    far = far.select(*keys, "id", "region_id", _away(F.col("x") - F.col("rx"), F.col("y") - F.col("ry")).alias("distance"))
    best = first_by(near.unionByName(far), [*keys, "id"], ["distance", "region_id"])
    return lines.select(*keys, "id").join(best, [*keys, "id"], "left")


def located(boxes: DataFrame, regions: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Per box the smallest region (by share) around its centre, else the nearest by centre in Manhattan distance; the number of
    regions that overlap it, and its place rx, ry in the region.

    regions: id, x, y, w, h, share. Equal regions are met once. Boxes are found by grid cells of the given size; only boxes in no
    region meet all different regions of their page. Ties go to the smaller id."""
    regions = regions.groupBy(*keys, "x", "y", "w", "h", "share").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    cx, cy = F.col("a_x") + F.col("a_w") / 2, F.col("a_y") + F.col("a_h") / 2
    around = cx.between(F.col("b_x"), F.col("b_x") + F.col("b_w")) & cy.between(F.col("b_y"), F.col("b_y") + F.col("b_h"))
    row = lambda p: F.struct(*(F.col(f"{p}{c}").alias(c) for c in ("id", "x", "y", "w", "h")))
    one = [*(F.col(f"a_{k}").alias(k) for k in keys), F.col("a_id").alias("id")]
    # count and least share need no sort; only the regions of that share are looked at again
    near = near_pairs(boxes, regions, keys, size).groupBy(*one).agg(F.sum(F.when(overlap() > 0, F.col("b_n")).otherwise(0)).alias("members"), F.min(F.when(around, F.col("b_share"))).alias("least"))
    again = boxes.join(near.where("least is not null").select(*keys, "id", "least").hint("merge"), [*keys, "id"])
    inner = near_pairs(again.withColumns({"x": _mid("x", "w"), "y": _mid("y", "h"), "w": F.lit(0.0), "h": F.lit(0.0), "__box": F.struct(*"xywh")}), regions, keys, size)
    inner = inner.where(F.col("b_share") == F.col("a_least")).withColumns({f"a_{c}": F.col(f"a___box.{c}") for c in "xywh"}).where(around)
    inner = inner.groupBy(*one).agg(F.min_by(row("b_"), F.col("b_id")).alias("inside"))
    near = near.drop("least").join(inner.hint("merge"), [*keys, "id"], "left")
    mine = boxes.select(*keys, "id", _mid("x", "w").alias("cx"), _mid("y", "h").alias("cy")).join(near, [*keys, "id"], "left").na.fill(0, ["members"])
    r = _as(regions, keys, {"id": "r_id", "x": "r_x", "y": "r_y", "w": "r_w", "h": "r_h"})
    away = F.abs(F.col("cx") - _mid("r_x", "r_w")) + F.abs(F.col("cy") - _mid("r_y", "r_h"))
    far = mine.where("inside is null").join(r, keys).groupBy(*keys, "id").agg(F.min_by(row("r_"), F.struct(away, "r_id")).alias("outside"))
    out = mine.join(far, [*keys, "id"], "left").withColumn("r", F.coalesce("inside", "outside"))
    place = lambda c, at, side: _unit((F.col(c) - F.col(at)) / F.greatest(F.lit(1.0), side)).alias(f"r{at[-1]}")
    return out.select(*keys, "id", F.col("r.id").alias("region_id"), F.col("inside").isNotNull().alias("contained"), "members", place("cx", "r.x", "r.w"), place("cy", "r.y", "r.h"))


def grid_cells(pages: DataFrame, ys: DataFrame, xs: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (row, col, x, y, w, h) between the distinct bounds of each page, its edges included, thin and small ones left out.

    pages: width, height. ys: y of horizontal bounds, xs: x of vertical ones. Rows and columns count from 0 over all bounds."""
    def steps(bounds: DataFrame, at: str, side: str, end: str, n: str) -> DataFrame:
        page = pages.select(*keys, F.explode(F.array(F.lit(0.0), F.col(end).cast("double"))).alias(at))
        w = Window.partitionBy(*keys).orderBy(at)
        b = bounds.select(*keys, F.col(at).cast("double").alias(at)).unionByName(page).distinct()
        return b.select(*keys, at, (F.lead(at).over(w) - F.col(at)).alias(side), (F.row_number().over(w) - 1).alias(n)).where(F.col(side) >= THIN)

    grid = steps(ys, "y", "h", "height", "row").join(steps(xs, "x", "w", "width", "col"), keys).join(pages, keys)
    return grid.where(F.col("w") * F.col("h") >= F.col("width") * F.col("height") * LEAST_CELL).select(*keys, "row", "col", "x", "y", "w", "h")


def merged_cells(cells: DataFrame, h_lines: DataFrame, v_lines: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding boxes of cells joined where no line parts them, between 0.8 % and 90 % of the page.

    cells: as of grid_cells. h_lines: y, x1, x2; v_lines: x, y1, y2. A line parts two cells if it lies within 3 of their common side
    and covers it but for 5 at the ends. Lines meet sides by bands of 4."""
    node = F.concat_ws("/", *(F.col(k).cast("string") for k in keys), "row", "col")
    c = cells.withColumn("node", node)

    def joined(step: str, other: str, at: str, side: str, along: str, length: str, lines: DataFrame, line_at: str, lo: str, hi: str) -> DataFrame:
        nxt = c.select(*keys, (F.col(step) - 1).alias(step), other, F.col("node").alias("b"))
        pair = c.join(nxt, [*keys, step, other]).select(*keys, F.col("node").alias("a"), "b", (F.col(at) + F.col(side)).alias("edge"), F.col(along).alias("s0"), (F.col(along) + F.col(length)).alias("s1"))
        band = pair.withColumn("band", F.floor(F.col("edge") / 4))
        l = lines.select(*keys, F.col(line_at).alias("at"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.explode(F.array(*(F.floor(F.col(line_at) / 4) + d for d in (-1, 0, 1)))).alias("band"))
        parted = band.join(l, [*keys, "band"]).where((F.abs(F.col("at") - F.col("edge")) <= 3) & (F.col("lo") <= F.col("s0") + 5) & (F.col("hi") >= F.col("s1") - 5))
        return pair.join(parted.select("a", "b").distinct(), ["a", "b"], "left_anti").select("a", "b")

    edges = joined("row", "col", "y", "h", "x", "w", h_lines, "y", "x1", "x2").unionByName(joined("col", "row", "x", "w", "y", "h", v_lines, "x", "y1", "y2"))
    grouped = c.join(components(c, edges), "node").groupBy(*keys, "component")
    box = grouped.agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("__r"), F.max(F.col("y") + F.col("h")).alias("__b"), F.count("*").alias("cells"))
    box = box.select(*keys, "x", "y", (F.col("__r") - F.col("x")).alias("w"), (F.col("__b") - F.col("y")).alias("h"), "cells").join(pages, keys)
    share = F.col("w") * F.col("h") / (F.col("width") * F.col("height"))
    return box.where((share >= LEAST_MERGED) & (share <= MOST_MERGED)).select(*keys, "x", "y", "w", "h", "cells")


def graph_profiles(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Per candidate its distinct nodes, the edges that touch any of them, their ratio and the share of each edge type.

    nodes: candidate, node. edges: edge_id, source_id, target_id, edge_type."""
    n = nodes.distinct()
    # equal ends and types are counted, not listed: those that touch a set are those at each of its nodes less those between two of them
    one = edges.groupBy(*keys, "edge_id", "edge_type").agg(F.collect_set("source_id").alias("s"), F.collect_set("target_id").alias("t"))
    one = one.select(*keys, "edge_id", "edge_type", F.array_sort(F.array_union("s", "t")).alias("ends"))
    like = one.where(F.size("ends") <= 2).groupBy(*keys, "ends", "edge_type").agg(F.count("*").alias("k"))
    at = like.select(*keys, "edge_type", "k", F.explode("ends").alias("node")).groupBy(*keys, "node", "edge_type").agg(F.sum("k").alias("k"))
    here = n.join(at, [*keys, "node"]).select(*keys, "candidate", "edge_type", "k")
    # a pair of ends meets the candidates of the end that fewer have
    sets = n.groupBy(*keys, "node").agg(F.count("*").alias("m"))
    end = like.where(F.size("ends") == 2).select(*keys, "ends", "edge_type", "k", F.explode("ends").alias("node")).join(sets, [*keys, "node"])
    end = end.groupBy(*keys, "ends", "edge_type", "k").agg(F.array_sort(F.collect_list(F.struct("m", "node"))).alias("e")).where(F.size("e") == 2)
    two = end.select(*keys, "edge_type", "k", F.col("e")[0]["node"].alias("node"), F.col("e")[1]["node"].alias("other"))
    both = two.join(n, [*keys, "node"]).join(n.withColumnRenamed("node", "other"), [*keys, "other", "candidate"]).select(*keys, "candidate", "edge_type", (-F.col("k")).alias("k"))
    # an id with more than two ends is listed
    many = one.where(F.size("ends") > 2).select(*keys, "edge_id", "edge_type", F.explode("ends").alias("node"))
    rest = n.join(many, [*keys, "node"]).select(*keys, "candidate", "edge_id", "edge_type").distinct().select(*keys, "candidate", "edge_type", F.lit(1).cast("long").alias("k"))
    by = here.unionByName(both).unionByName(rest).groupBy(*keys, "candidate", "edge_type").agg(F.sum("k").alias("c"))
    total = F.aggregate("t", F.lit(0), lambda s, e: s + e["c"].cast("int"))
    kinds = by.groupBy(*keys, "candidate").agg(F.sum("c").alias("edge_count"), F.sort_array(F.collect_list(F.struct("edge_type", "c"))).alias("t"))
    kinds = kinds.withColumn("edge_types", F.map_from_entries(F.transform("t", lambda e: F.struct(e["edge_type"], e["c"] / total)))).drop("t")
    per = n.groupBy(*keys, "candidate").agg(F.count("*").alias("node_count")).join(kinds, [*keys, "candidate"], "left").na.fill(0, ["edge_count"])
    return per.withColumn("edge_density", F.col("edge_count") / F.col("node_count"))


def profile_similarity(a: Column, b: Column) -> Column:
    """Likeness of two profiles (structs with edge_types and edge_density): 0.7 common shares of types, 0.3 like densities."""
    types = lambda p: F.coalesce(p["edge_types"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    ta, tb = types(a), types(b)
    common = F.aggregate(F.map_keys(ta), F.lit(0.0), lambda s, k: s + F.least(ta[k], F.coalesce(F.try_element_at(tb, k), F.lit(0.0))))
    typed = F.when((F.size(ta) == 0) & (F.size(tb) == 0), 0.5).otherwise(_unit(common))
    da, db = a["edge_density"], b["edge_density"]
    dense = F.when((da == 0) & (db == 0), 0.5).otherwise(_unit(1 - F.abs(da - db) / F.greatest(F.lit(1.0), da, db)))
    return _unit(typed * 0.7 + dense * 0.3)


def geometry_similarity(a: Column, b: Column, width: Column, height: Column) -> Column:
    """Likeness of two boxes by width, height, aspect and nearness of centres on a page."""
    like = lambda p, q: _unit(1 - F.abs(p - q) / F.greatest(F.lit(1.0), p, q))
    aspect = lambda t: F.when(t["h"] > 0, t["w"] / t["h"]).otherwise(0.0)
    ra, rb = aspect(a), aspect(b)
    ratio = F.when((ra > 0) & (rb > 0), like(ra, rb)).otherwise(0.0)
    mid = lambda t, c, s: t[c] + t[s] / 2
    near = _unit(1 - _away((mid(a, "x", "w") - mid(b, "x", "w")) / F.greatest(F.lit(1.0), width), (mid(a, "y", "h") - mid(b, "y", "h")) / F.greatest(F.lit(1.0), height)))
    return _unit(like(a["w"], b["w"]) * GEOMETRY["width"] + like(a["h"], b["h"]) * GEOMETRY["height"] + ratio * GEOMETRY["ratio"] + near * GEOMETRY["position"])


def orientation_signal(a: Column, b: Column) -> Column:
    """One less the smaller angle between two directions in degrees over 180; 0.5 if either is unknown."""
    d = F.abs(F.pmod(a, F.lit(360.0)) - F.pmod(b, F.lit(360.0)))
    return F.when(a.isNull() | b.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.least(d, 360 - d) / 180))


def distance_signal(a: Column, b: Column, width: Column, height: Column) -> Column:
    """One less the distance of two boxes' centres over the page's diagonal, 0 at least."""
    mid = lambda t, c, s: t[c] + t[s] / 2
    d = _away(mid(a, "x", "w") - mid(b, "x", "w"), mid(a, "y", "h") - mid(b, "y", "h"))
    return F.greatest(F.lit(0.0), 1 - d / F.greatest(F.lit(1.0), _away(width, height)))


def first_siblings(lines: DataFrame, keys: list[str], group: str, most: int = 10) -> DataFrame:
    """siblings of tendencies(): of each line the first `most` other lines (by id) with its group. They are among the first most + 1 of the group."""
    first = first_by(lines.where(F.col(group).isNotNull()), [*keys, group], ["id"], most + 1)
    return lines.select(*keys, F.col("id").alias("line_id"), group).join(first, [*keys, group])


def tendencies(lines: DataFrame, siblings: DataFrame, keys: list[str], most: int = 10) -> DataFrame:
    """row_tendency and column_tendency of each line: shares of its first `most` siblings (by id) near its centre in y and in x.

    lines and siblings: id, x, y, w, h; siblings also line_id, the line they belong to. A line without siblings has 0."""
    s = first_by(siblings.select(*keys, "line_id", F.col("id").alias("s"), _mid("x", "w").alias("sx"), _mid("y", "h").alias("sy")).where("s <> line_id"), [*keys, "line_id"], ["s"], most)
    p = lines.select(*keys, F.col("id").alias("line_id"), _mid("x", "w").alias("cx"), _mid("y", "h").alias("cy"), "w", "h").join(s, [*keys, "line_id"], "left")
    close = lambda c, d, least: F.abs(F.col(c) - F.col(d)) <= F.greatest(F.lit(least[0]), least[1])
    share = lambda test: F.coalesce(F.try_divide(F.count_if(test), F.count("s")), F.lit(0.0))
    return p.groupBy(*keys, "line_id").agg(share(close("sy", "cy", (8.0, F.col("h")))).alias("row_tendency"), share(close("sx", "cx", (20.0, F.col("w") * 0.25))).alias("column_tendency"))


def line_metrics(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines, and min, max and median of their positive heights (0 without any)."""
    h = F.when(F.col("h") > 0, F.col("h").cast("double"))
    none = F.lit(0.0)
    return lines.groupBy(*keys).agg(F.count("*").alias("lines"), F.coalesce(F.min(h), none).alias("min_height"), F.coalesce(F.max(h), none).alias("max_height"), F.coalesce(F.median(h), none).alias("median_height"))


def candidate_text(candidates: Column, candidate_id: Column) -> Column:
    """Text of the first candidate (structs with id and text) with the id; null if there is none."""
    return F.try_element_at(F.filter(candidates, lambda c: c["id"] == candidate_id), F.lit(1))["text"]


#: How far centres in an aligned group may step, the sizes that count as alike, and a band's gap and separator span.
STEP, ALIKE, LEAST_ALIGNED = 8.0, 0.3, 3
BAND_PIXELS, BAND_SHARE, SEPARATOR = 10.0, 0.02, 0.25


def aligned_groups(boxes: DataFrame, keys: list[str], axis: str = "horizontal") -> DataFrame:
    """Groups of three boxes or more whose centres step by 8 at most, with like sizes across the axis.

    grp, members, first and last id along the axis (ties by id), cross (median size across) and along (median size along, null where
    those sizes differ by 30 % or more). Horizontal groups have centres at like heights."""
    at, side, other = ("y", "h", "w") if axis == "horizontal" else ("x", "w", "h")
    place = "x" if at == "y" else "y"
    w = Window.partitionBy(*keys).orderBy("__c", "id")
    b = boxes.withColumn("__c", _mid(at, side))
    b = b.withColumn("__new", F.when(F.col("__c") - F.lag("__c").over(w) > STEP, 1).otherwise(0))
    b = b.withColumn("grp", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    like = lambda c: F.greatest(F.max(c) - F.median(c), F.median(c) - F.min(c)) / F.greatest(F.lit(1.0), F.median(c)) < ALIKE
    order = F.struct(place, "id")
    g = b.groupBy(*keys, "grp").agg(
        F.count("*").alias("members"), F.min_by("id", order).alias("first"), F.max_by("id", order).alias("last"), F.median(side).alias("cross"),
        like(side).alias("__like"), F.when(like(other), F.median(other)).alias("along"),
    )
    return g.where((F.col("members") >= LEAST_ALIGNED) & F.col("__like")).drop("__like")


def line_bands(lines: DataFrame, pages: DataFrame, keys: list[str], separator: float = SEPARATOR) -> DataFrame:
    """Bands of horizontal lines (y, x1, x2): a gap above the larger of 10 and 2 % of the page's height parts them.

    band, lines, y (mean), y1, y2, x1, x2, span (share of the page's width) and separator (a span of at least the given share)."""
    w = Window.partitionBy(*keys).orderBy("y", "x1", "x2")
    l = lines.select(*keys, "y", "x1", "x2").join(pages, keys)
    gap = F.greatest(F.lit(BAND_PIXELS), F.floor(F.col("height") * BAND_SHARE + 0.5))
    l = l.withColumn("__new", F.when(F.col("y") - F.lag("y").over(w) > gap, 1).otherwise(0))
    l = l.withColumn("band", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = l.groupBy(*keys, "band").agg(F.count("*").alias("lines"), F.avg("y").alias("__y"), F.min("y").alias("y1"), F.max("y").alias("y2"), F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.first("width").alias("__w"))
    span = F.greatest(F.lit(0.0), F.col("x2") - F.col("x1")) / F.col("__w")
    return g.select(*keys, "band", "lines", F.col("__y").alias("y"), "y1", "y2", "x1", "x2", span.alias("span"), (span >= separator).alias("separator"))
