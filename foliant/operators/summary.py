"""Structural summaries of documents, and how stable a batch of them is in seven metrics.

A summary is one row per document; per-region descriptors and signatures stay in a table of their own, so no row grows with the
regions of a document. Pairwise averages over a batch come from sums of unit vectors, or from pairs of cells of a fixed grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from .batchstats import mean_pairwise_cosine, robust_stability, to_stability

#: The sides of the grid of a page, and the weights of the parts of two composite metrics.
GRID = 4
GRAPH = {"edge_count": 0.40, "edge_types": 0.35, "avg_weight": 0.25}
TEXT = {"line_count": 0.35, "block_count": 0.35, "token_count": 0.30}
#: Shares of edge types are compared on a grid of hundredths: at most 5,151 cells, whatever the number of documents.
STEPS = 100


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def region_descriptors(regions: DataFrame, documents: DataFrame) -> DataFrame:
    """Regions with normalised boxes (nx, ny, nw, nh), area, centroid (cx, cy), aspect and cell of the page's grid.

    regions: doc_id, region_id, x, y, w, h, confidence, density, surface; documents: doc_id, width, height. Null numbers count 0, a
    null surface is unknown, and a page without a size has sides of 1."""
    r = regions.na.fill(0.0, ["confidence", "density"]).na.fill("unknown", ["surface"])
    r = r.select("doc_id", "region_id", "confidence", "density", "surface", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in "xywh"))
    side = lambda c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(1.0)).alias(c)
    r = r.join(documents.select("doc_id", side("width"), side("height")), "doc_id")
    across, down = F.col("width"), F.col("height")
    r = r.withColumns({
        "nx": _unit(F.col("x") / across), "ny": _unit(F.col("y") / down), "nw": _unit(F.col("w") / across), "nh": _unit(F.col("h") / down),
        "area": _unit(F.col("w") * F.col("h") / (across * down)), "aspect": F.coalesce(F.try_divide("w", "h"), F.lit(0.0)),
        "cx": _unit((F.col("x") + F.col("w") / 2) / across), "cy": _unit((F.col("y") + F.col("h") / 2) / down),
    })
    at = lambda c: F.least(F.floor(F.col(c) * GRID), F.lit(GRID - 1))
    return r.withColumn("cell", (at("cy") * GRID + at("cx")).cast("int")).drop("x", "y", "w", "h", "width", "height")


def neighbourhoods(descriptors: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, region_id with neighbours, edge_weight (mean), contains, proximity, adjacency and depth (larger containers).

    edges: doc_id, source_id, target_id, edge_type, weight. Each end of an edge has the other as neighbour."""
    weight = F.coalesce("weight", F.lit(0.0))
    ends = F.explode(F.array(*(F.struct(F.col(a).alias("region_id"), F.col(b).alias("other")) for a, b in (("source_id", "target_id"), ("target_id", "source_id"))))).alias("e")
    n = edges.select("doc_id", "edge_type", weight.alias("weight"), ends).select("doc_id", "edge_type", "weight", "e.*")
    size = lambda key, name: descriptors.select("doc_id", F.col("region_id").alias(key), F.col("area").alias(name))
    n = n.join(size("region_id", "__own"), ["doc_id", "region_id"]).join(size("other", "__other"), ["doc_id", "other"], "left")
    kind = lambda k: F.count_if(F.col("edge_type") == k)
    return n.groupBy("doc_id", "region_id").agg(
        F.count("*").alias("neighbours"), F.avg("weight").alias("edge_weight"), kind("contains").alias("contains"), kind("spatial_proximity").alias("proximity"),
        kind("spatial_adjacency").alias("adjacency"), F.count_if((F.col("edge_type") == "contains") & (F.col("__other") > F.col("__own"))).alias("depth"),
    )


def signatures(descriptors: DataFrame, near: DataFrame) -> DataFrame:
    """doc_id, region_id, cell and vector: the 14 comparable numbers of a region. Without rectangularity or solidity they are 1."""
    d = descriptors.join(near, ["doc_id", "region_id"], "left").na.fill(0, ["neighbours", "adjacency", "depth"]).na.fill(0.0, ["edge_weight"])
    extra = [F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(1.0)) if c in d.columns else F.lit(1.0) for c in ("rectangularity", "solidity")]
    parts = [*(F.col(c) for c in ("nx", "ny", "nw", "nh", "area")), F.least("aspect", F.lit(10.0)), F.col("confidence"), F.col("density")]
    parts += [F.col("neighbours") / 10, F.col("edge_weight"), F.col("adjacency") / 10, F.col("depth") / 5, *extra]
    return d.select("doc_id", "region_id", "cell", F.array(*(p.cast("double") for p in parts)).alias("vector"))


def summaries(documents: DataFrame, descriptors: DataFrame, edges: DataFrame) -> DataFrame:
    """One compact row per document: validity with its reason, counts, means, grid shares, surface counts and edge statistics.

    documents: doc_id, width, height, line_count, block_count, token_count. A document is valid with regions and a page larger
    than 1 by 1."""
    cell = lambda k: F.coalesce(F.try_divide(F.sum(F.when(F.col("cell") == k, F.col("area"))), F.sum("area")), F.lit(0.0))
    r = descriptors.groupBy("doc_id").agg(
        F.count("*").alias("region_count"), F.avg("area").alias("avg_area"), F.avg("density").alias("avg_density"), F.avg("confidence").alias("avg_confidence"),
        F.array(*(cell(k) for k in range(GRID * GRID))).alias("distribution"),
    )
    kinds = descriptors.groupBy("doc_id", "surface").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("surface", "n")))).alias("surfaces"))
    share = lambda test: F.count_if(test) / F.count("*")
    kind = F.coalesce("edge_type", F.lit(""))
    e = edges.groupBy("doc_id").agg(
        F.count("*").alias("edge_count"), F.avg(F.coalesce("weight", F.lit(0.0))).alias("avg_weight"),
        F.array(share(kind == "spatial_proximity"), share(kind == "contains"), share(~kind.isin("spatial_proximity", "contains"))).alias("edge_types"),
    )
    d = documents.join(r, "doc_id", "left").join(kinds, "doc_id", "left").join(e, "doc_id", "left")
    d = d.na.fill(0, ["region_count", "edge_count", "line_count", "block_count", "token_count"]).na.fill(0.0, ["avg_area", "avg_density", "avg_confidence", "avg_weight"])
    zeros = lambda n: F.array(*([F.lit(0.0)] * n))
    d = d.withColumns({"edge_types": F.coalesce("edge_types", zeros(3)), "distribution": F.coalesce("distribution", zeros(GRID * GRID))})
    sized = F.coalesce((F.col("width") > 1) & (F.col("height") > 1), F.lit(False))
    reason = F.when(~sized, "no viewport").when(F.col("region_count") == 0, "no regions").otherwise("")
    return d.withColumn("reason", reason).withColumn("valid", reason == "")


def split_valid(summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid summaries, doc_id and reason of the others)."""
    return summary.where("valid"), summary.where(~F.coalesce("valid", F.lit(False))).select("doc_id", "reason")


def _long(docs: DataFrame, array: str) -> DataFrame:
    return docs.select("doc_id", F.posexplode(array).alias("dim", "value"))


def mean_divergence(docs: DataFrame, array: str) -> DataFrame:
    """mean_divergence over all pairs of documents of a three-way distribution, its first two shares rounded to hundredths.

    Documents are counted by cell, so pairs are of at most 5,151 cells. Fewer than two documents have none: 0."""
    at = lambda k: F.round(F.col(array)[k] * STEPS).cast("int")
    rest = lambda d: F.when(F.aggregate(array, F.lit(0.0), lambda s, x: s + x) == 0, 0).otherwise(F.greatest(F.lit(0), STEPS - d[0] - d[1]))
    cells = docs.groupBy(F.array(at(0), at(1), rest((at(0), at(1)))).alias("c")).agg(F.count("*").alias("n"))
    p = F.transform("c", lambda x: x / STEPS)
    a, b = cells.select(p.alias("p"), F.col("n").alias("np")), cells.select(p.alias("q"), F.col("n").alias("nq"))
    pairs = a.join(F.broadcast(b), F.col("p") < F.col("q"))  # b is bounded by the grid
    total = pairs.agg(F.sum(_unit(S.divergence(F.col("p"), F.col("q"))) * F.col("np") * F.col("nq")).alias("s"))
    n = docs.agg(F.count("*").alias("n"))
    return total.crossJoin(n).select(F.coalesce(F.try_divide("s", F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("mean_divergence"))


def stability(summary: DataFrame) -> DataFrame:
    """metric, stability: the seven metrics over the valid summaries of a batch, composites rounded to three places.

    region_count, region_area and region_density are one less the robust variation; adjacency_graph and text_structure weigh
    several; spatial_distribution and surface_type are mean cosines of pairs. A batch of one pair at least is expected."""
    v, _ = split_valid(summary)
    names = {"region_count": "region_count", "avg_area": "region_area", "avg_density": "region_density"}
    one = robust_stability(v, *names, "edge_count", "avg_weight", "line_count", "block_count", "token_count")
    take = lambda c: F.max(F.when(F.col("metric") == c, F.col("stability")))
    wide = one.agg(*(take(c).alias(c) for c in (*names, "edge_count", "avg_weight", *TEXT)))
    cosine = lambda df, name: mean_pairwise_cosine(df, "doc_id", "dim", "value").select(F.coalesce("mean_cosine", F.lit(1.0)).alias(name))
    counts = v.select("doc_id", F.explode("surfaces").alias("dim", "value"))
    wide = wide.crossJoin(mean_divergence(v, "edge_types")).crossJoin(cosine(_long(v, "distribution"), "spatial_distribution")).crossJoin(cosine(counts, "surface_type"))
    graph = GRAPH["edge_count"] * F.col("edge_count") + GRAPH["edge_types"] * to_stability(F.col("mean_divergence")) + GRAPH["avg_weight"] * F.col("avg_weight")
    text = sum((F.lit(w) * F.col(c) for c, w in TEXT.items()), F.lit(0.0))
    rows = {new: F.col(old) for old, new in names.items()} | {
        "adjacency_graph": F.round(graph, 3), "spatial_distribution": F.round(_unit(F.col("spatial_distribution")), 3),
        "text_structure": F.round(text, 3), "surface_type": F.round(_unit(F.col("surface_type")), 3),
    }
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), c.cast("double").alias("stability")) for k, c in rows.items()))).alias("r")).select("r.*")
