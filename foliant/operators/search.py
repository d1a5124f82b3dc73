"""Text search in tokens: phrases, candidates, ranking; keyword boxes and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .dedupe import first_by


def containing(small: DataFrame, large: DataFrame) -> DataFrame:
    """a, b: pairs of the distinct texts in column a of small and b of large where b contains a.

    The key is the first three characters of a (all of it, if shorter), which stand somewhere in b."""
    s = small.select("a").where("a <> ''").distinct().withColumn("key", F.left("a", F.lit(3)))
    starts = F.sequence(F.lit(1), F.length("b"))
    grams = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substr("b", i, n)))))
    g = large.select("b").where("b <> ''").distinct().withColumn("key", F.explode(grams))
    return s.join(g, "key").where(F.contains("b", "a")).select("a", "b").distinct()


def phrase_candidates(tokens: DataFrame, queries: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Runs of consecutive tokens on a line that match all parts of a query, and single tokens that match it squashed.

    tokens: keys, line, place, text. queries: query_id, query. Tokens meet a query by their distinct normalised texts: equal
    to its first part, or one containing the other; the other parts are checked at their places, as far as the longest query."""
    t = tokens.withColumn("norm", T.squash(T.keyword_norm(F.col("text")))).where("norm <> ''")
    q = queries.withColumn("plain", T.keyword_norm(F.col("query"))).where("plain <> ''").withColumn("parts", F.split("plain", " ")).withColumn("whole", T.squash(F.col("plain")))
    longest = q.agg(F.max(F.size("parts"))).first()[0] or 1
    words = t.select("norm").distinct()
    sought = q.select(F.explode(F.array(F.element_at("parts", 1), "whole")).alias("sought")).distinct()
    within = containing(words.select(F.col("norm").alias("a")), sought.select(F.col("sought").alias("b"))).select(F.col("a").alias("norm"), F.col("b").alias("sought"))
    around = containing(sought.select(F.col("sought").alias("a")), words.select(F.col("norm").alias("b"))).select(F.col("b").alias("norm"), F.col("a").alias("sought"))
    meets = within.union(around).distinct()
    first = meets.join(q.select("query_id", "parts", "whole"), F.col("sought") == F.element_at("parts", 1)).where(T.token_matches(F.col("norm"), F.col("sought")))
    squashed = meets.join(q.select("query_id", "parts", "whole"), F.col("sought") == F.col("whole")).where(F.size("parts") > 1)
    found = first.unionByName(squashed).select("query_id", "parts", "whole", F.col("norm").alias("met")).distinct()
    w = Window.partitionBy(*keys, line).orderBy("place").rowsBetween(0, longest - 1)
    ahead = t.withColumn("following", F.collect_list("norm").over(w)).withColumn("shown", F.collect_list("text").over(w))
    p = ahead.join(found, F.col("norm") == F.col("met"))
    n = F.size("parts")
    match = lambda a, b: F.coalesce(T.token_matches(a, b), F.lit(False))
    fits = F.forall(F.zip_with(F.slice("following", 1, n), F.col("parts"), match), lambda ok: ok) & (F.size("following") >= n)
    single = (n > 1) & (F.contains("norm", "whole") | F.contains("whole", "norm"))
    takes = F.explode(F.array_distinct(F.filter(F.array(F.when(single, 1), F.when(fits, n)), lambda k: k.isNotNull())))
    hit = p.withColumn("taken", takes)
    pairs = F.zip_with(F.slice("following", 1, F.col("taken")), F.slice("parts", 1, F.col("taken")), lambda a, b: T.token_match_score(a, b))
    score = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    whole = F.when(F.col("taken") == 1, T.token_match_score(F.col("norm"), F.col("whole"))).otherwise(0.0)
    text = F.array_join(F.slice("shown", 1, F.col("taken")), " ")
    return hit.select("query_id", *keys, line, "place", F.col("taken").alias("n_tokens"), text.alias("candidate"), (score + whole + T.form_penalty(text)).alias("score"))


def ranked(candidates: DataFrame, keys: list[str], mode: str = "best") -> DataFrame:
    """rank by falling score, ties by order; mode first: by order alone."""
    order = ["order"] if mode == "first" else [F.desc("score"), F.col("order")]
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def within_edits(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """a, b, distance: all pairs of the distinct texts a of left and b of right whose edit distance is at most `most` (below 0.5)
    times the longer length.

    Of texts of m and n characters that are k edits apart at most, one of k + 1 pieces of b is untouched and stands in a at most
    k characters from its place; key: both lengths, the piece's number and its text."""
    if not 0 <= most < 0.5:
        raise ValueError("the edit ratio must be below 0.5, or pieces would be empty")

    def lengths(n):
        edits = lambda m: F.floor(F.greatest(m, n) * most + 1e-9)
        near = F.sequence(F.greatest(F.lit(1), F.floor(n * (1 - most)).cast("int") - 1), F.ceil(n / (1 - most)).cast("int") + 1)
        return F.explode(F.filter(near, lambda m: F.abs(m - n) <= edits(m)))

    k = F.floor(F.greatest("m", "n") * most + 1e-9).cast("int")
    begin, end = F.floor(F.col("i") * F.col("n") / (F.col("k") + 1)).cast("int"), F.floor((F.col("i") + 1) * F.col("n") / (F.col("k") + 1)).cast("int")
    b = right.select("b").where("b <> ''").distinct().withColumn("n", F.length("b"))
    b = b.withColumn("m", lengths(F.col("n"))).withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    b = b.select("b", "m", "n", "i", F.substr("b", begin + 1, end - begin).alias("piece"))
    a = left.select("a").where("a <> ''").distinct().withColumn("m", F.length("a"))
    a = a.withColumn("n", lengths(F.col("m"))).withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    a = a.withColumn("begin", begin).withColumn("size", end - begin).withColumn("at", F.explode(F.sequence(F.col("begin") - F.col("k"), F.col("begin") + F.col("k"))))
    a = a.where("at >= 0 AND at + size <= m AND abs(at - begin - (m - n)) <= k").select("a", "m", "n", "i", F.substr("a", F.col("at") + 1, F.col("size")).alias("piece"))
    pairs = a.join(b, ["m", "n", "i", "piece"]).select("a", "b").distinct()
    return pairs.withColumn("distance", T.edit_ratio(F.col("a"), F.col("b"))).where(F.col("distance") <= most)


def nearest_text(queries: DataFrame, terms: DataFrame, most: float = 0.3) -> DataFrame:
    """query_id, term, distance: the exact match, else the closest term within the edit ratio, ties to the smaller term."""
    q = queries.withColumn("q", T.keyword_norm(F.col("query")))
    t = terms.withColumn("t", T.keyword_norm(F.col("term"))).groupBy("t").agg(F.min("term").alias("term"))
    p = within_edits(q.select(F.col("q").alias("a")), t.select(F.col("t").alias("b")), most).join(t, F.col("b") == F.col("t"))
    best = first_by(p, ["a"], ["distance", "term"]).select("a", "term", "distance")
    return q.join(best, F.col("q") == F.col("a")).select("query_id", "term", "distance")


#: Fixed value: reach of a keyword, as a share of the page.
KEYWORD_RADIUS = 0.35


def keyword_weight(distance: Column, width_ratio: Column, height_ratio: Column, strong: bool = False) -> Column:
    """1 without a prediction or beyond the radius; else 0.6 closeness and 0.4 likeness of size about 1, held to [0.8, 1.2] (1.05 if strong)."""
    composite = 0.6 * (1 - distance / KEYWORD_RADIUS) + 0.2 * (width_ratio + height_ratio)
    weight = F.least(F.greatest(1 + (composite - 0.5) * 0.4, F.lit(0.8)), F.lit(1.05 if strong else 1.2))
    return F.when(distance.isNull() | (distance > KEYWORD_RADIUS), 1.0).otherwise(weight)


def triangulate(relations: DataFrame, key: str) -> DataFrame:
    """Weighted mean box of the boxes that relations predict; sides of at least 4."""
    w = F.col("weight")
    mean = lambda c: F.try_divide(F.sum(F.col(c) * w), F.sum(w))
    return relations.groupBy(key).agg(mean("cx").alias("cx"), mean("cy").alias("cy"), F.greatest(mean("w"), F.lit(4.0)).alias("w"), F.greatest(mean("h"), F.lit(4.0)).alias("h"), F.sum(w).alias("weight"))


def first_passing(attempts: DataFrame, keys: list[str], order: str, score: str, threshold: float = 0.65) -> DataFrame:
    """The first attempt that reaches the threshold, else the last that is not empty."""
    good = F.when(F.col(score) >= threshold, 0).otherwise(1)
    place = F.when(F.col(score) >= threshold, F.col(order)).otherwise(-F.col(order))
    return first_by(attempts.where("text <> ''"), keys, [good, place])
