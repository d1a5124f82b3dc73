"""Candidates against signatures: weighted signals, static scores, row pruning, landmarks, descriptors, local subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from .dedupe import first_by
from .search import within_edits
from .spatial import SLACK, nearest_pairs

#: Weights of the signals that rank candidates, and of those that keep nodes near a selection.
SIGNALS = {"anchor_text": 0.20, "nearby_label": 0.17, "structural": 0.14, "containing_region": 0.10, "sibling_arrangement": 0.10, "local_geometry": 0.17, "graph_relationship": 0.12}
RELEVANCE = {"overlap": 0.26, "distance": 0.20, "containment": 0.12, "shared_parent": 0.10, "topology": 0.14, "adjacency": 0.08, "alignment": 0.04, "provenance": 0.03, "text_confidence": 0.03}
RETAINED = 0.22
#: What an address or a telephone number looks like.
POSTAL = r"(?i)\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b|\b\d{5}(-\d{4})?\b"
STREET = r"(?i)\b(STREET|ST\.?|RD\.?|ROAD|AVE|AVENUE|BLVD|DR\.?|DRIVE|WAY|LANE|LN\.?|CRES|COURT|CT\.?|TRL|TRAIL)\b"
PHONE = r"\b\(?\d{3}\)?[\s./-]?\d{3}[\s./-]?\d{4}\b"


def weighted(signals: dict[str, float]) -> Column:
    """Sum of weight times column, missing signals counting nothing."""
    return sum((F.lit(w) * F.coalesce(F.col(k), F.lit(0.0)) for k, w in signals.items()), F.lit(0.0))


def rank_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """score, confidence and rank of candidates with the seven signals; ties by id."""
    s = candidates.withColumn("score", weighted(SIGNALS)).withColumn("confidence", N.clamp(0.92 * F.col("score") + 0.05, 0.0, 1.0))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id")))


def relevance(nodes: DataFrame) -> DataFrame:
    """score and retained of nodes with the nine relevance columns."""
    return nodes.withColumn("score", weighted(RELEVANCE)).withColumn("retained", F.col("score") >= RETAINED)


def local_subgraph(nodes: DataFrame, edges: DataFrame, retained: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(retained nodes, edges with either end retained)."""
    kept = nodes.join(retained.select(*keys, "id"), [*keys, "id"], "left_semi")
    end = lambda c: edges.join(retained.select(*keys, F.col("id").alias(c)), [*keys, c], "left_semi")
    return kept, end("source_id").unionByName(end("target_id")).distinct()


def distance_score(distance: Column, base_distance: Column, far: Column, radius: float = 0.35) -> Column:
    """Closeness to the expected centre, less the farther from the base position; distances in page units."""
    bias = F.when(base_distance.isNull(), 1.0).otherwise(F.greatest(F.lit(0.65), 1 - F.least(F.lit(1.0), base_distance / radius)))
    return F.when(distance.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - distance / radius) * bias * F.when(far, 0.6).otherwise(1.0))


def total_score(confidence: Column, keyword: Column, distance: Column, anchor: Column, fingerprint: Column, line: Column) -> Column:
    return N.clamp(confidence * keyword * (0.55 + distance * 0.45) * anchor * fingerprint * line, 0.0, 2.0)


def static_confidence(cleaned: Column, fingerprint_ok: Column, anchor_ok: Column, anchor_soft: Column, distance: Column) -> Column:
    base = F.coalesce(F.nullif(cleaned, F.lit(0.0)), F.lit(0.6))
    return N.clamp(base * F.when(fingerprint_ok, 1.0).otherwise(0.75) * F.when(anchor_ok, 1.0).when(anchor_soft, 0.85).otherwise(0.75) * (0.55 + distance * 0.45), 0.0, 1.0)


def field_bias(kind: Column, text: Column) -> tuple[Column, Column]:
    """(factor of the total score, factor of the confidence) for customer_name and customer_address fields."""
    t = F.upper(F.coalesce(text, F.lit("")))
    digit, postal, street, phone = t.rlike(r"\d"), t.rlike(POSTAL), t.rlike(STREET), t.rlike(PHONE)
    address, strong, only_phone = digit | postal | street | phone, postal | (digit & street), phone & ~street & ~postal
    named = t.rlike(r"[A-Z]{3,}\s+[A-Z]{3,}(\s+[A-Z]{2,})?") & ~address
    name, where = kind == "customer_name", kind == "customer_address"
    down, up = (name & address) | (where & only_phone), (name & named) | (where & strong)
    return F.when(up & down, 1.15 * 0.6).when(up, 1.15).when(down, 0.6).otherwise(1.0), F.when(up & down, 1.1 * 0.65).when(up, 1.1).when(down, 0.65).otherwise(1.0)


def pick_static(candidates: DataFrame, keys: list[str], most: int, accept: float) -> DataFrame:
    """Per key the best candidate, the current one, and whether the best replaces it.

    Columns id, total_score, is_current, fp_ok, distance_score, line_diff. The list is cut to `most`, the current one always kept."""
    w = Window.partitionBy(*keys).orderBy(F.desc("total_score"), "id")
    c = candidates.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= most) | F.col("is_current"))
    row = F.struct("id", "total_score", "fp_ok", "distance_score", "line_diff")
    p = c.groupBy(*keys).agg(F.min_by(row, "rank").alias("best"), F.max(F.when(F.col("is_current"), row)).alias("current"))
    score = F.coalesce("current.total_score", F.lit(0.0))
    better = (F.col("best.total_score") > 1.05 * score) | (~F.coalesce("current.fp_ok", F.lit(False)) & F.col("best.fp_ok") & (F.col("best.distance_score") > F.coalesce("current.distance_score", F.lit(0.0))))
    fits = (F.coalesce("best.line_diff", F.lit(99)) <= 1) | F.col("best.fp_ok")
    other = ~F.col("best.id").eqNullSafe(F.col("current.id"))
    return p.select(*keys, F.col("best.id").alias("best_id"), F.col("current.id").alias("current_id"), (other & better & fits & (F.col("best.total_score") >= accept)).alias("prefer_best"))


def row_target(counts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Expected rows per key: the trimmed mean of its column counts, rounded half up."""
    from ..functions.stats import trimmed_mean

    return counts.groupBy(*keys).agg(F.floor(trimmed_mean(F.col(count)) + 0.5).alias("target"))


def prune_rows(rows: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """The best supported rows up to the key's target: dropped by hits, then tokens, then anchors, later rows first."""
    w = Window.partitionBy(*keys).orderBy(F.desc("hits"), F.desc("tokens"), F.desc("anchors"), "idx")
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= F.col(target)).drop("__k")


def hamming_matches(queries: DataFrame, train: DataFrame, ratio: float = 0.78, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Nearest descriptor (array of long words) of each query on its page, if it beats the second by the ratio."""
    q = queries.select(*keys, F.col("id").alias("query_id"), F.col("words").alias("a"))
    t = train.select(*keys, F.col("id").alias("train_id"), F.col("words").alias("b"))
    dist = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    two = first_by(q.join(t, list(keys)).withColumn("distance", dist), [*keys, "query_id"], ["distance", "train_id"], 2)
    w = Window.partitionBy(*keys, "query_id").orderBy("distance", "train_id")
    two = two.withColumn("second", F.lead("distance").over(w)).withColumn("n", F.row_number().over(w))
    return two.where((F.col("n") == 1) & (F.col("distance") < ratio * F.col("second"))).select(*keys, "query_id", "train_id", "distance")


def landmark_matches(landmarks: DataFrame, tokens: DataFrame, most: float = 0.3) -> DataFrame:
    """Per landmark and document the exact token nearest to its position, else the closest within the edit ratio.

    landmarks: landmark_id, text, x, y; tokens: doc_id, text, x, y. Texts are compared once for each pair of distinct ones."""
    lm = landmarks.withColumn("norm", T.keyword_norm(F.col("text"))).select("landmark_id", "norm", F.col("x").alias("lx"), F.col("y").alias("ly"))
    tk = tokens.withColumn("t", T.keyword_norm(F.col("text")))
    away = F.sqrt(F.pow(F.col("x") - F.col("lx"), 2) + F.pow(F.col("y") - F.col("ly"), 2))
    close = within_edits(tk.select(F.col("t").alias("a")), lm.select(F.col("norm").alias("b")), most)
    # equal tokens and equal landmarks once, and of each document only the texts that are closest to the landmark's
    said = tk.select("doc_id", "t", "text", "x", "y").distinct()
    near = said.select("doc_id", "t").distinct().join(close, F.col("t") == F.col("a")).select("doc_id", "t", F.col("b").alias("norm"), "distance")
    least = near.groupBy("doc_id", "norm").agg(F.min("distance").alias("distance"))
    near = near.join(least, ["doc_id", "norm", "distance"])
    place = lm.select("norm", "lx", "ly").distinct()
    found = place.join(near, "norm").join(said, ["doc_id", "t"]).withColumn("away", away)
    best = first_by(found, ["norm", "lx", "ly", "doc_id"], ["away", "x", "y", "text"])
    return lm.join(best, ["norm", "lx", "ly"]).select("landmark_id", "doc_id", "text", "x", "y", "distance")


def context(fields: DataFrame, landmarks: DataFrame, keys: list[str], radius: float = 0.4, k: int = 10) -> DataFrame:
    """The k landmarks nearest to each field within the radius, ties to the smaller id, with the landmarks' columns.

    A field meets the landmarks of a circle that holds k, or of the whole radius where fewer lie in it."""
    at = lambda df: df.withColumns({"__px": F.col("x"), "__py": F.col("y")})
    p = nearest_pairs(at(fields.select(*keys, "id", "x", "y")), at(landmarks), keys, k, radius * SLACK)
    away = F.sqrt(F.pow(F.col("b_x") - F.col("a_x"), 2) + F.pow(F.col("b_y") - F.col("a_y"), 2))
    near = p.withColumn("distance", away).where(F.col("distance") <= radius)
    more = [c for c in landmarks.columns if c not in (*keys, "id", "x", "y")]
    near = near.select(*(F.col(f"a_{c}").alias(c) for c in keys), F.col("b_id").alias("id"), F.col("b_x").alias("x"), F.col("b_y").alias("y"), F.col("a_id").alias("field_id"), F.col("a_x").alias("fx"), F.col("a_y").alias("fy"), "distance", *(F.col(f"b_{c}").alias(c) for c in more))
    return first_by(near, [*keys, "field_id"], ["distance", "id"], k)


def blended(structure: DataFrame, landmark: DataFrame, keys: list[str], least: float = 0.7) -> DataFrame:
    """Boxes by structure, those below the confidence blended with the landmark's by confidence."""
    lm = landmark.select(*keys, *(F.col(c).alias(f"l_{c}") for c in ("x", "y", "w", "h", "confidence")))
    j = structure.join(lm, keys, "left")
    use = (F.col("confidence") < least) & F.col("l_confidence").isNotNull()
    mean = lambda c: F.when(use, F.try_divide(F.col(c) * F.col("confidence") + F.col(f"l_{c}") * F.col("l_confidence"), F.col("confidence") + F.col("l_confidence"))).otherwise(F.col(c))
    return j.select(*keys, *(mean(c).alias(c) for c in "xywh"), F.when(use, F.greatest("confidence", "l_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(use, "blended").otherwise("structure").alias("method"))


def overridden(scores: DataFrame, supervision: DataFrame, by: float = 0.4) -> DataFrame:
    """Pair scores raised for merge labels and lowered for keep labels, by unordered pair (its last label by seq), held to [0, 1]."""
    pair = lambda df, a, b: df.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)})
    last = pair(supervision, "a", "b").groupBy("low", "high").agg(F.max_by("label", "seq").alias("label"))
    s = last.select("low", "high", F.when(F.col("label") == "merge", by).when(F.col("label") == "keep", -by).otherwise(0.0).alias("shift"))
    return pair(scores, "a", "b").join(s, ["low", "high"], "left").withColumn("score", N.clamp(F.col("score") + F.coalesce("shift", F.lit(0.0)), 0.0, 1.0)).drop("low", "high", "shift")


def boosted(base: Column, landmark: Column) -> Column:
    """A landmark raises confidences between 0.3 and 0.8 only."""
    return F.when((base > 0.3) & (base < 0.8), F.greatest(base, landmark)).otherwise(base)
