"""Landmark phrases: stable tokens of a batch that follow each other on a line, chained, each used once.

`keys` names a batch. A line is a run of tokens whose mean heights are at most LINE apart; lines are folded one by one, so a task
holds one line's tokens, never a batch. Positions per document are joined after that.

Defined results: ties in height and place go to the smaller id; a phrase in fewer than two documents, all its tokens in each, is
none; its tokens then stand alone if they are in two documents; a batch without documents has none.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import clamp

LINE, TALL, WIDE = 0.02, 1.5, 2.0


def lines(stable: DataFrame, keys: list[str]) -> DataFrame:
    """stable (id, text, mean_x, mean_y, mean_w, mean_h) with its line."""
    w = Window.partitionBy(*keys).orderBy("mean_y", "id")
    t = stable.withColumn("__new", F.when(F.col("mean_y") - F.lag("mean_y").over(w) > LINE, 1).otherwise(0))
    return t.withColumn("line", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def chains(stable: DataFrame, keys: list[str]) -> DataFrame:
    """keys, id, head (id of the first token of its chain), place (in it) of every stable token.

    From left to right a token joins the open chain if it begins at most twice the wider token's width behind the middle of the last
    one, and ends the search for more if it stands over one and a half mean heights off the line."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["mean_x", "id"])
        ids, x, y, w, h = (rows[c].tolist() for c in ("id", "mean_x", "mean_y", "mean_w", "mean_h"))
        head: list = [None] * len(ids)
        place = [0] * len(ids)
        for i in range(len(ids)):
            if head[i] is not None:
                continue
            head[i], last, n = ids[i], i, 0
            for j in range(i + 1, len(ids)):
                if head[j] is not None:
                    continue
                if abs(y[j] - y[last]) > (h[last] + h[j]) / 2 * TALL:
                    break
                if 0 <= x[j] - (x[last] + w[last] / 2) < max(w[last], w[j]) * WIDE:
                    n += 1
                    head[j], place[j], last = ids[i], n, j
        return pd.DataFrame({k: group[k].iloc[0] for k in keys} | {"id": ids, "head": head, "place": place})[[*keys, "id", "head", "place"]]

    own = [stable.schema[k] for k in keys] + [stable.schema["id"], T.StructField("head", stable.schema["id"].dataType), T.StructField("place", T.IntegerType())]
    return lines(stable, keys).groupBy(*keys, "line").applyInPandas(fold, T.StructType(own))


def phrases(stable: DataFrame, positions: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, head, text, tokens, docs, frequency, stability, confidence, x, y of every landmark phrase, single tokens included.

    positions: id, doc, x, y (centres), w, h; docs: one row per document of a batch; stable has stability too. A token of a phrase that
    is in too few documents stands alone."""
    total = docs.groupBy(*keys).agg(F.countDistinct("doc").alias("all_docs"))
    member = chains(stable, keys).join(stable, [*keys, "id"])
    size = member.groupBy(*keys, "head").agg(F.count("*").alias("tokens"))
    full = lambda m: m.join(positions.select(*keys, "id", "doc"), [*keys, "id"]).groupBy(*keys, "head", "doc").agg(F.countDistinct("id").alias("present"))
    inside = full(member).join(size, [*keys, "head"]).where(F.col("present") == F.col("tokens")).groupBy(*keys, "head").agg(F.count("*").alias("docs"))
    good = inside.where("docs >= 2")
    lone = member.join(good.select(*keys, "head"), [*keys, "head"], "left_anti").withColumn("head", F.col("id")).withColumn("place", F.lit(0))
    lone_docs = positions.groupBy(*keys, F.col("id").alias("head")).agg(F.countDistinct("doc").alias("docs")).where("docs >= 2")
    every = member.join(good, [*keys, "head"]).unionByName(lone.join(lone_docs, [*keys, "head"]))
    g = every.groupBy(*keys, "head").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("said"), F.count("*").alias("tokens"), F.first("docs").alias("docs"), F.avg("stability").alias("stability"), F.avg("mean_x").alias("x"), F.avg("mean_y").alias("y"))
    g = g.join(total, keys).withColumn("frequency", F.col("docs") / F.col("all_docs"))
    return g.select(*keys, "head", F.array_join(F.transform("said", lambda s: s["text"]), " ").alias("text"), "tokens", "docs", F.round("frequency", 4).alias("frequency"), F.round("stability", 4).alias("stability"), F.round(clamp(F.col("frequency") * 0.5 + F.col("stability") * 0.5, 0.0, 1.0), 4).alias("confidence"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def phrase_boxes(stable: DataFrame, positions: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, head, doc, x, y, w, h (corner and size): where a phrase of several tokens stands in each document that has all of it."""
    member = chains(stable, keys).join(found.where("tokens > 1").select(*keys, "head", "tokens"), [*keys, "head"])
    p = member.join(positions.select(*keys, "id", "doc", "x", "y", "w", "h"), [*keys, "id"])
    low, high = (lambda c, s: F.min(F.col(c) - F.col(s) / 2)), (lambda c, s: F.max(F.col(c) + F.col(s) / 2))
    g = p.groupBy(*keys, "head", "doc", "tokens").agg(F.countDistinct("id").alias("present"), low("x", "w").alias("x"), low("y", "h").alias("y"), high("x", "w").alias("x1"), high("y", "h").alias("y1")).where("present = tokens")
    return g.select(*keys, "head", "doc", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))
