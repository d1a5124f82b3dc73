"""Statistics over batches of documents: stability, correspondence, landmarks, histograms.

Pairwise averages of cosines over documents need no pairs: with unit vectors u_i, the sum over pairs is
(|sum u|^2 - sum |u|^2) / 2, one aggregate over the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S

#: Weights of the stability metrics and the bounds of its bands.
WEIGHTS = {"region_count": 0.20, "region_area": 0.15, "region_density": 0.10, "adjacency_graph": 0.20, "spatial_distribution": 0.15, "text_structure": 0.10, "surface_type": 0.10}
BANDS = ((0.85, "stable"), (0.7, "mostly_stable"), (0.5, "moderately_stable"))
#: Weights of a region's parts in its likeness to another.
SIMILARITY = {"position": 0.25, "shape": 0.15, "size": 0.10, "dimension": 0.10, "topology": 0.25, "semantic": 0.15}


def to_stability(cv: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - cv))


def scalar_stability(docs: DataFrame, column: str) -> DataFrame:
    """metric, n, mean, stddev, cv, stability of one number per document."""
    s = docs.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("stddev"), S.variation(F.col(column)).alias("cv"))
    return s.select(F.lit(column).alias("metric"), "*", to_stability(F.col("cv")).alias("stability"))


def floor_quantiles(values: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """metric, n and an exact quantile q0, q1, ... for each share: the value at index floor(n share) of a metric's sorted values.

    values: metric, v. Approximate percentiles on either side (ranks to 1 in 10,000) bracket each quantile; only distinct values in
    the bracket, some thousandth of the rows, are ranked. No array or window spans all values."""
    around = [F.lit(min(1.0, max(0.0, s + d))) for s in shares for d in (-0.001, 0.001)]
    b = values.groupBy("metric").agg(F.count("v").alias("n"), F.percentile_approx("v", F.array(*around), 10000).alias("p"))
    one = lambda k, s: F.struct(F.lit(k).alias("k"), F.floor(F.col("n") * s).alias("index"), F.col("p")[2 * k].alias("lo"), F.col("p")[2 * k + 1].alias("hi"))
    b = b.select("metric", "n", F.explode(F.array(*(one(k, s) for k, s in enumerate(shares)))).alias("b")).select("metric", "n", "b.*")
    at = values.join(F.broadcast(b), "metric").where("v <= hi")  # a row per metric and share
    c = at.groupBy("metric", "n", "k", "index", F.greatest("v", "lo").alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("metric", "k").orderBy("v")
    c = c.withColumn("upto", F.sum("c").over(w)).where(F.col("upto") > F.col("index"))
    return c.groupBy("metric", "n").agg(*(F.min(F.when(F.col("k") == k, F.col("v"))).alias(f"q{k}") for k in range(len(shares))))


def robust_stability(docs: DataFrame, *columns: str) -> DataFrame:
    """metric, robust_cv, stability of numbers of documents, outliers dropped first: beyond 1.5 interquartile ranges of the quartiles.

    Below four values, or where under two would remain, all count. A column without values has no row."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns))).alias("r")
    values = docs.select(each).select("r.*").where("v is not null")
    marked = values.join(F.broadcast(floor_quantiles(values, (0.25, 0.75))), "metric")  # a row per metric
    inside = F.col("v").between(F.col("q0") - 1.5 * (F.col("q1") - F.col("q0")), F.col("q1") + 1.5 * (F.col("q1") - F.col("q0")))
    marked = marked.withColumn("inside", (F.col("n") < 4) | inside)
    kept = marked.groupBy("metric").agg(F.count_if("inside").alias("kept"), S.variation(F.when(F.col("inside"), F.col("v"))).alias("a"), S.variation(F.col("v")).alias("b"))
    return kept.select("metric", F.when(F.col("kept") < 2, F.col("b")).otherwise(F.col("a")).alias("robust_cv")).withColumn("stability", to_stability(F.col("robust_cv")))


def mean_pairwise_cosine(vectors: DataFrame, key: str, dim: str, value: str) -> DataFrame:
    """pairs, mean_cosine over all unordered pairs of keys, from long rows (key, dim, value)."""
    norm = Window.partitionBy(key)
    unit = vectors.withColumn("__u", F.try_divide(F.col(value), F.sqrt(F.sum(F.col(value) * F.col(value)).over(norm))))
    sums = unit.groupBy(dim).agg(F.sum("__u").alias("s"), F.sum(F.col("__u") * F.col("__u")).alias("q"))
    n = vectors.agg(F.countDistinct(key).alias("n"))
    total = sums.agg(((F.sum(F.col("s") * F.col("s")) - F.sum("q")) / 2).alias("dot"))
    return total.crossJoin(n).select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.try_divide(F.col("dot"), F.col("n") * (F.col("n") - 1) / 2).alias("mean_cosine"))


def centrality(vectors: DataFrame, key: str, dim: str, value: str) -> DataFrame:
    """key, mean_similarity: each key's mean cosine to all others, by one pass over the sum of unit vectors; the largest is the reference."""
    unit = vectors.withColumn("__u", F.try_divide(F.col(value), F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(key)))))
    sums = unit.groupBy(F.col(dim).alias("__d")).agg(F.sum("__u").alias("__s"))
    n = unit.select(F.count_distinct(key).alias("__n"))
    per = unit.join(sums, F.col(dim) == F.col("__d")).groupBy(key).agg(F.sum(F.col("__u") * F.col("__s")).alias("__t"), F.sum(F.col("__u") * F.col("__u")).alias("__o"))
    return per.crossJoin(n).select(key, F.try_divide(F.col("__t") - F.col("__o"), F.col("__n") - 1).alias("mean_similarity"))


def reference(vectors: DataFrame, key: str, dim: str, value: str) -> DataFrame:
    return centrality(vectors, key, dim, value).orderBy(F.desc(F.round("mean_similarity", 9)), key).limit(1)


def overall(metrics: DataFrame) -> DataFrame:
    """overall_stability, status from (metric, stability)."""
    weight = F.coalesce(*(F.when(F.col("metric") == k, F.lit(w)) for k, w in WEIGHTS.items()), F.lit(0.0))
    o = metrics.agg(F.sum(weight * F.col("stability")).alias("overall_stability"))
    status = F.coalesce(*(F.when(F.col("overall_stability") >= b, F.lit(s)) for b, s in BANDS), F.lit("unstable"))
    return o.withColumn("status", status)


def region_similarity(a: str = "a", b: str = "b") -> Column:
    """Six-part likeness of regions in struct columns: x, y (centre), w, h, aspect, rectangularity, solidity, neighbours,
    edge_weight, edge_types (shares of contains, proximity, adjacency; null if none), depth, type, confidence, density."""
    g = lambda s, c: F.col(f"{s}.{c}")
    away = lambda c, u=None, v=None: F.abs((g(a, c) if u is None else u) - (g(b, c) if v is None else v))
    held = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    ar, br = F.least(g(a, "aspect"), F.lit(10.0)), F.least(g(b, "aspect"), F.lit(10.0))
    aa, ba = g(a, "w") * g(a, "h"), g(b, "w") * g(b, "h")
    kinds = F.zip_with(g(a, "edge_types"), g(b, "edge_types"), lambda p, q: 1 - F.abs(p - q))
    types = F.coalesce(F.aggregate(kinds, F.lit(0.0), lambda s, x: s + x) / 3, F.lit(1.0))
    part = {
        "position": held(1 - F.sqrt(F.pow(away("x"), 2) + F.pow(away("y"), 2)) / 1.414),
        "shape": held(0.5 * held(1 - F.abs(ar - br) / F.greatest(ar, br, F.lit(0.1))) + 0.25 * (1 - away("rectangularity")) + 0.25 * (1 - away("solidity"))),
        "size": held(1 - F.abs(aa - ba) / F.greatest(aa, ba, F.lit(0.001))),
        "dimension": held(1 - away("w") - away("h")),
        "topology": held(0.25 * (1 - away("neighbours") / F.greatest(g(a, "neighbours"), g(b, "neighbours"), F.lit(1))) + 0.15 * (1 - away("edge_weight")) + 0.35 * types + 0.25 * (1 - away("depth") / F.greatest(g(a, "depth"), g(b, "depth"), F.lit(1)))),
        "semantic": held(0.5 * F.when(g(a, "type") == g(b, "type"), 1.0).otherwise(0.3) + 0.35 * (1 - away("confidence")) + 0.15 * (1 - away("density"))),
    }
    return F.round(sum((F.lit(w) * part[k] for k, w in SIMILARITY.items()), F.lit(0.0)), 4)


def similar_regions(reference: DataFrame, targets: DataFrame, keys: list[str], least: float = 0.4) -> DataFrame:
    """keys, doc, a_id, b_id, similarity: regions of a reference document and of the other documents (doc) of its batch that are alike by at least `least`.

    Both have id and the columns of region_similarity(). Pairs are of one batch, and of one document each; keys
    must not be named a or b."""
    names = [c for c in reference.columns if c not in keys]
    a = reference.select(*keys, F.struct(*names).alias("a"))
    b = targets.select(*keys, "doc", F.struct(*names).alias("b"))
    p = b.join(a, keys).withColumn("similarity", region_similarity()).where(F.col("similarity") >= least)
    return p.select(*keys, "doc", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "similarity")


def spatial_histogram(boxes: DataFrame, key: str, cells: int = 4) -> DataFrame:
    """key, cell, share: normalised area by grid cell of the box centres; all cells present."""
    at = lambda c, s: F.least(F.floor((F.col(c) + F.col(s) / 2) * cells), F.lit(cells - 1))
    cell = (at("y", "h") * cells + at("x", "w")).cast("int")
    sums = boxes.groupBy(key, cell.alias("cell")).agg(F.sum(F.col("w") * F.col("h")).alias("a"))
    grid = boxes.select(key).distinct().select(key, F.explode(F.sequence(F.lit(0), F.lit(cells * cells - 1))).alias("cell"))
    full = grid.join(sums, [key, "cell"], "left").na.fill(0.0, ["a"])
    return full.select(key, "cell", F.coalesce(F.try_divide(F.col("a"), F.sum("a").over(Window.partitionBy(key))), F.lit(0.0)).alias("share"))


def token_frequency(tokens: DataFrame, least_share: float = 0.5, most_per_doc: int = 1) -> DataFrame:
    """Landmark candidates: text, docs, max_per_doc, mean position and its population deviation; in enough documents, unambiguous in each."""
    n = tokens.select(F.count_distinct("doc_id").alias("__n"))
    per = tokens.groupBy("text", "doc_id").agg(F.count("*").alias("k"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    t = per.groupBy("text").agg(F.count("*").alias("docs"), F.max("k").alias("max_per_doc"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("dx"), F.coalesce(F.stddev_pop("y"), F.lit(0.0)).alias("dy"))
    return t.crossJoin(n).where((F.col("docs") >= least_share * F.col("__n")) & (F.col("max_per_doc") <= most_per_doc)).drop("__n")


def anchors(matches: DataFrame, documents: int, least: float = 0.25) -> DataFrame:
    """Reference regions matched often enough: frequency, mean similarity, confidence."""
    m = matches.groupBy("ref_region").agg(F.count_distinct("doc_id").alias("docs"), F.avg("similarity").alias("mean_similarity"))
    m = m.withColumn("frequency", F.col("docs") / documents)
    return m.where(F.col("frequency") >= least).withColumn("confidence", F.col("frequency") * F.col("mean_similarity"))


def diagnoses(metrics: DataFrame) -> DataFrame:
    """metric, severity, place: weak metrics by severity; high comes last, as the reports list it."""
    sev = F.when(F.col("stability") < 0.5, "high").when(F.col("stability") < 0.7, "medium").when(F.col("stability") < 0.85, "low")
    order = F.when(F.col("severity") == "medium", 1).when(F.col("severity") == "low", 2).otherwise(3)
    return metrics.withColumn("severity", sev).where("severity is not null").withColumn("place", order).select("metric", "severity", "place")


def graph_stats(nodes: DataFrame, degree: str = "degree") -> DataFrame:
    """Count, mean, population deviation, CV, median and a five-bin histogram of a node measure in [0, 1]."""
    d = F.col(degree)
    bins = [F.count_if((d >= k / 5) & ((d < (k + 1) / 5) if k < 4 else F.lit(True))).alias(f"bin{k}") for k in range(5)]
    s = nodes.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"), F.median(d).alias("median"), *bins)
    return s.withColumn("cv", F.coalesce(F.try_divide(F.col("sd"), F.col("mean")), F.lit(0.0)))
