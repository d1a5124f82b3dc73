"""What people drew and what was chosen: snapshots of regions, statistics, ranking weights, page manifests, entries of mixed form, selections.

Defined results: null or missing numbers count 0 where stated, ties go to the smaller id, empty tables give one row of totals or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.numeric import clamp
from .dedupe import first_by
from .spatial import near_pairs

#: The seven weights of ranking, and what close, far and enclosed labels change.
WEIGHTS = {"anchor_text": 0.20, "nearby_label": 0.17, "structural": 0.14, "containing_region": 0.10, "sibling_arrangement": 0.10, "local_geometry": 0.17, "graph_relationship": 0.12}
CLOSE = {"local_geometry": 0.22, "nearby_label": 0.20, "anchor_text": 0.15}
DISTANT = {"anchor_text": 0.25, "nearby_label": 0.22, "local_geometry": 0.12}
ENCLOSED, PAIRS = 0.15, 10


def region_snapshots(regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, box (pixels), norm (held to the page), confidence, text_density, surface of regions with bbox, x..h or nx..nh, the first that is complete.

    regions: id, bbox (struct), x, y, w, h, nx, ny, nw, nh, page_w, page_h, confidence, text_density, surface."""
    page = {s: F.greatest(F.lit(1.0), F.coalesce(F.col(f"page_{s}").cast("double"), F.lit(0.0))) for s in "wh"}
    whole = lambda cols: F.when(sum((c.isNull().cast("int") for c in cols), F.lit(0)) == 0, G.box(*cols))
    own, plain = [F.col(f"bbox.{c}") for c in "xywh"], [F.col(c) for c in "xywh"]
    norm = [F.col(f"n{c}") * page[s] for c, s in zip("xywh", "whwh")]
    zero = F.lit(0.0)
    box = F.coalesce(whole(own), whole(plain), whole(norm), G.box(*(F.coalesce(c.cast("double"), zero) for c in plain)))
    b = regions.withColumn("__b", box)
    at = lambda c: F.col(f"__b.{c}")
    pixels = G.box(at("x"), at("y"), F.greatest(zero, at("w")), F.greatest(zero, at("h")))
    held = G.box(*(clamp(e / page[s], 0.0, 1.0) for e, s in ((at("x"), "w"), (at("y"), "h"), (F.greatest(zero, at("w")), "w"), (F.greatest(zero, at("h")), "h"))))
    return b.select(*keys, "id", pixels.alias("box"), held.alias("norm"), F.coalesce("confidence", zero).alias("confidence"), F.coalesce("text_density", zero).alias("text_density"), F.coalesce("surface", F.lit("unknown")).alias("surface"))


def store_statistics(boxes: DataFrame, records: DataFrame) -> DataFrame:
    """records, boxes, categories (map of counts), oldest, newest of a store: records (record_id, ts), boxes (record_id, category)."""
    own = boxes.join(records.select("record_id").distinct(), "record_id", "left_semi")
    by = own.groupBy("category").agg(F.count("*").alias("n"))
    counts = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("boxes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    return records.agg(F.count("*").alias("records"), F.min("ts").alias("oldest"), F.max("ts").alias("newest")).crossJoin(counts).select("records", "boxes", "categories", "oldest", "newest")


def ranking_weights(boxes: DataFrame, size: float = 0.25) -> DataFrame:
    """weight, suggested, pairs, proximity, enclosure: ranking weights that the labels' distances and the regions around values suggest.

    boxes: record_id, id, category (label, field_value, visual_region, structural_section), x, y, w, h, normalised. Below ten label-value pairs the
    weights stay. A value without a label in its record has proximity 0."""
    kind = lambda *names: boxes.where(F.col("category").isin(*names)).select("record_id", "id", "x", "y", "w", "h")
    labels, values, around = kind("label"), kind("field_value"), kind("visual_region", "structural_section")
    count = lambda df, n: df.groupBy("record_id").agg(F.count("*").alias(n))
    pairs = count(labels, "l").join(count(values, "v"), "record_id").agg(F.coalesce(F.sum(F.least("l", "v")), F.lit(0)).alias("pairs"))
    middle = lambda df: df.select("record_id", "id", (F.col("x") + F.col("w") / 2).alias("x"), (F.col("y") + F.col("h") / 2).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    near = near_pairs(middle(values), middle(labels), ["record_id"], 0.5, 1.0)  # beyond 1 the proximity is 0
    near = near.groupBy(F.col("a_record_id").alias("record_id"), F.col("a_id").alias("id")).agg(F.greatest(F.lit(0.0), 1 - F.min(F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")))).alias("near"))
    a, b = (F.struct(*(F.col(f"{s}_{c}").alias(c) for c in "xywh")) for s in "ab")
    held = near_pairs(values, around, ["record_id"], size).groupBy(F.col("a_record_id").alias("record_id"), F.col("a_id").alias("id")).agg(F.max(G.iou(a, b)).alias("held"))
    v = values.select("record_id", "id").join(near, ["record_id", "id"], "left").join(held, ["record_id", "id"], "left")
    means = v.agg(F.avg(F.coalesce("near", F.lit(0.0))).alias("proximity"), F.avg(F.coalesce("held", F.lit(0.0))).alias("enclosure"))
    p, enough = F.col("proximity"), F.col("pairs") >= PAIRS

    def weight(name: str) -> Column:
        base = F.lit(WEIGHTS[name])
        if name in CLOSE:
            base = F.when(enough & (p > 0.8), CLOSE[name]).when(enough & (p < 0.5), DISTANT[name]).otherwise(base)
        return F.when(enough & (F.col("enclosure") > 0.5), ENCLOSED).otherwise(base) if name == "containing_region" else base

    m = means.crossJoin(pairs).withColumn("w", F.array(*(F.struct(F.lit(n).alias("weight"), weight(n).alias("v")) for n in WEIGHTS)))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x["v"])
    m = m.withColumn("total", total).select("pairs", F.round("proximity", 3).alias("proximity"), F.round("enclosure", 3).alias("enclosure"), "total", F.explode("w").alias("x"))
    return m.select("x.weight", F.when(enough, F.round(F.col("x.v") / F.col("total"), 2)).otherwise(F.col("x.v")).alias("suggested"), "pairs", "proximity", "enclosure")


def page_manifests(pages: DataFrame, most: int = 16, size: int = 2_500_000) -> DataFrame:
    """file_id, page, data (null beyond `size` bytes), too_large, bytes (of the thumbnail, else the data) of the first `most` pages of each file.

    pages: file_id, page, seq, data, thumb (base64, perhaps behind a data: head). A later entry of a page replaces its values, but for null ones; page 0 or
    null is none."""
    bytes_of = lambda c: F.ceil(F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "^[^,]*,", "")) * 3 / 4).cast("long")
    own = pages.where(F.coalesce("page", F.lit(0)) != 0)
    w = Window.partitionBy("file_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = own.withColumns({"first": F.min("seq").over(w), "data_now": F.last("data", ignorenulls=True).over(w), "thumb_now": F.last("thumb", ignorenulls=True).over(w)})
    last = first_by(last, ["file_id", "page"], [F.desc("seq")])
    big = bytes_of(F.col("data_now")) > size
    last = last.select("file_id", "page", "first", F.when(~big, F.col("data_now")).alias("data"), big.alias("too_large"), F.when(F.coalesce("thumb_now", F.lit("")) != "", bytes_of(F.col("thumb_now"))).otherwise(bytes_of(F.col("data_now"))).alias("bytes"))
    return first_by(last, ["file_id"], ["first", "page"], most).drop("first")


ENTRY = ("timestamp", "documentId", "tokenSource", "matchSource", "winnerCandidateId", "correctedCandidateId", "label", "previewExtractedText", "expectedText", "geometryLabel", "candidateLabel", "cropLabel")


def normalised_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """Learning entries of mixed form as columns: the query as an object or a bare text, sources and choices filled from one another, candidates a list.

    Blank texts are null; what is no JSON object has only nulls, a blank query and no candidates."""
    get = lambda p: F.nullif(F.get_json_object(column, f"$.{p}"), F.lit(""))
    none = F.lit("")
    nested = F.get_json_object(column, "$.query.raw").isNotNull() | F.get_json_object(column, "$.query.normalized").isNotNull() | F.coalesce(F.startswith(F.get_json_object(column, "$.query"), F.lit("{")), F.lit(False))
    raw = F.when(nested, get("query.raw")).otherwise(get("query"))
    normalized = F.when(nested, get("query.normalized")).otherwise(get("normalized"))
    many = F.coalesce(F.from_json(F.when(F.startswith(F.coalesce(F.get_json_object(column, "$.candidates"), none), F.lit("[")), F.get_json_object(column, "$.candidates")), "array<string>"), F.array().cast("array<string>"))
    named = [get(n).alias(n) for n in ENTRY]
    return lines.select(*[c for c in lines.columns if c != column], *named, get("page").try_cast("double").alias("page"), F.coalesce(raw, none).alias("query_raw"), F.coalesce(normalized, none).alias("query_normalized"), F.coalesce(get("source"), get("tokenSource")).alias("source"), F.coalesce(get("chosenCandidateId"), get("winnerCandidateId")).alias("chosenCandidateId"), many.alias("candidates"))


def associated(seeds: DataFrame, nodes: DataFrame, keys: list[str], width: Column, height: Column, size: float = 100.0) -> DataFrame:
    """keys, seed_id, role, node_id, place of what belongs to a selection (id, x, y, w, h): overlapping tokens, the 8 nearest lines and 6 nearest blocks,
    intersecting and containing regions, and the 6 surfaces of the highest signal.

    nodes: id, kind (token, line, block, region, surface), x, y, w, h, orientation. Overlaps meet by grid cells; the nearest are of all of a page."""
    a, b = (F.struct(*(F.col(f"{s}_{c}").alias(c) for c in "xywh")) for s in "ab")
    boxes = nodes.select(*keys, "id", "kind", "x", "y", "w", "h", "orientation")
    meet = near_pairs(seeds.select(*keys, "id", "x", "y", "w", "h"), boxes.where("kind in ('token', 'region')"), keys, size).where(G.overlap_area(a, b) > 0)
    role = F.when(F.col("b_kind") == "token", F.array(F.lit("token"))).otherwise(F.when(G.contains(b, a), F.array(F.lit("intersecting"), F.lit("containing"))).otherwise(F.array(F.lit("intersecting"))))
    whole = [*(F.col(f"a_{k}").alias(k) for k in keys), F.col("a_id").alias("seed_id")]
    over = meet.select(*whole, F.explode(role).alias("role"), F.col("b_id").alias("node_id"))
    over = over.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "seed_id", "role").orderBy("node_id")))
    side = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in keys))
    p = side(seeds.select(*keys, "id", "x", "y", "w", "h"), "a").join(side(boxes.where("kind in ('line', 'block', 'surface')"), "b"), keys)
    away = G.distance(a, b) / F.hypot(width, height)
    turn = F.greatest(F.lit(0.0), 1 - F.least(F.lit(180.0), F.abs(F.coalesce("b_orientation", F.lit(0.0)))) / 180)
    shared = G.overlap_area(a, b)
    iou = F.when(shared > 0, shared / F.greatest(F.lit(1.0), G.area(a) + G.area(b) - shared)).otherwise(0.0)
    signal = iou * 0.6 + (1 - away) * 0.25 + turn * 0.15
    p = p.select(*keys, F.col("a_id").alias("seed_id"), F.col("b_kind").alias("role"), F.col("b_id").alias("node_id"), F.when(F.col("b_kind") == "surface", -signal).otherwise(away).alias("order"))
    p = p.where((F.col("role") != "surface") | (F.col("order") < -0.05))
    w = Window.partitionBy(*keys, "seed_id", "role").orderBy("order", "node_id")
    p = p.withColumn("place", F.row_number().over(w)).where(F.col("place") <= F.when(F.col("role") == "line", 8).otherwise(6)).drop("order")
    return over.unionByName(p)
