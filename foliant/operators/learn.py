"""Learned thresholds, weights, layouts and linear models, as aggregates over events and labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .scratch import dropped, written


def threshold_sweep(rows: DataFrame, score: str, label: str, thresholds: list[float], measure: str = "f1") -> DataFrame:
    """threshold, tp, fp, fn, tn, accuracy, f1; one pass over the rows, the thresholds as conditional counts."""
    s, y = F.col(score), F.col(label).cast("boolean")
    n = rows.agg(*(F.count_if(cond).alias(f"{k}{i}") for i, t in enumerate(thresholds) for k, cond in (("tp", (s >= t) & y), ("fp", (s >= t) & ~y), ("fn", (s < t) & y), ("tn", (s < t) & ~y))))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), *(F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn"))) for i, t in enumerate(thresholds))))
    m = n.select(each.alias("m")).select("m.*")
    acc = F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return m.withColumns({"accuracy": acc, "f1": f1})


def best_threshold(sweep: DataFrame, measure: str = "f1") -> DataFrame:
    """The first threshold of the highest measure."""
    return sweep.orderBy(F.desc(measure), "threshold").limit(1)


def precision_recall(rows: DataFrame, key: str, predicted: str, actual: str) -> DataFrame:
    """Per key, then averaged: precision, recall."""
    per = rows.groupBy(key).agg(F.count_if(F.col(predicted) & F.col(actual)).alias("tp"), F.count_if(predicted).alias("p"), F.count_if(actual).alias("a"))
    return per.agg(F.avg(F.try_divide("tp", "p")).alias("precision"), F.avg(F.try_divide("tp", "a")).alias("recall"))


def slot_scores(events: DataFrame, key: list[str], text: str = "slots", gain: int = 5) -> DataFrame:
    """key, pos, letter, number: additive scores of unambiguous glyphs by position, over all events."""
    rows = events.select(*key, F.posexplode(T.chars(F.col(text))).alias("pos", "c"))
    plain = ~F.col("c").isin(*T.AMBIGUOUS_DIGITS, *T.AMBIGUOUS_LETTERS)
    hit = lambda cond: F.sum(F.when(plain & cond, gain).otherwise(0))
    return rows.groupBy(*key, "pos").agg(hit(F.col("c").rlike("[A-Za-z]")).alias("letter"), hit(F.col("c").rlike("[0-9]")).alias("number"))


def layout_of(letter: Column, number: Column) -> Column:
    """L or N at a total of 20 and a lead of 15, else ?."""
    lead = (letter + number >= 20) & (F.abs(letter - number) >= 15)
    return F.when(lead & (letter > number), "L").when(lead, "N").otherwise("?")


def layouts(scores: DataFrame, key: list[str]) -> DataFrame:
    """key, layout, coverage, mixed (an L next to an N), violation (coverage of 0.6 and mixed)."""
    w = Window.partitionBy(*key).orderBy("pos")
    s = scores.withColumn("l", layout_of(F.col("letter"), F.col("number")))
    s = s.withColumn("edge", F.concat(F.lag("l").over(w), "l").isin("LN", "NL"))
    got = s.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l"))), lambda r: r["l"]), "").alias("layout"), F.avg(F.when(F.col("l") == "?", 0.0).otherwise(1.0)).alias("coverage"), F.coalesce(F.bool_or("edge"), F.lit(False)).alias("mixed"))
    return got.withColumn("violation", (F.col("coverage") >= 0.6) & F.col("mixed"))


def running_layouts(events: DataFrame, key: list[str], order: str, text: str = "slots") -> DataFrame:
    """Per event and position the scores up to and with it, as a stream of states."""
    rows = events.select(*key, order, F.posexplode(T.chars(F.col(text))).alias("pos", "c"))
    plain = ~F.col("c").isin(*T.AMBIGUOUS_DIGITS, *T.AMBIGUOUS_LETTERS)
    w = Window.partitionBy(*key, "pos").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    hit = lambda cond: F.sum(F.when(plain & cond, 5).otherwise(0)).over(w)
    return rows.withColumns({"letter": hit(F.col("c").rlike("[A-Za-z]")), "number": hit(F.col("c").rlike("[0-9]"))}).drop("c")


def apply_layout(slots: Column, layout: Column) -> Column:
    """Ambiguous glyphs turned to the learned kind of their position; lower case follows the corrected letter before."""
    pairs = F.arrays_zip(T.chars(slots).alias("c"), T.chars(layout).alias("l"))
    step = lambda out, p: F.concat(
        out,
        F.when((p["l"] == "N") & p["c"].isin(*T.AMBIGUOUS_LETTERS), T.letter_to_digit(p["c"])).when((p["l"] == "L") & p["c"].isin(*T.AMBIGUOUS_DIGITS), T.digit_to_letter(p["c"], F.right(out, F.lit(1)))).otherwise(F.coalesce(p["c"], F.lit(""))),
    )
    return F.aggregate(pairs, F.lit(""), step)


def moving_centroid(values: Column) -> Column:
    """Fold of an ordered array: each value moves the centre by 1 / min(n, 10)."""
    step = lambda s, v: F.struct((s["n"] + 1).alias("n"), F.when(s["n"] == 0, v).otherwise(s["c"] + (v - s["c"]) / F.least(s["n"] + 1, F.lit(10))).alias("c"))
    return F.aggregate(values, F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("c")), step, lambda s: s["c"])


def affine(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted least-squares affine transform of (x, y) to (u, v) per key: twelve sums and Cramer's rule, no UDF."""
    w = F.col("weight")
    s = {n: F.sum(w * e) for n, e in {"w": F.lit(1.0), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y"), "yy": F.col("y") * F.col("y"), "u": F.col("u"), "xu": F.col("x") * F.col("u"), "yu": F.col("y") * F.col("u"), "v": F.col("v"), "xv": F.col("x") * F.col("v"), "yv": F.col("y") * F.col("v")}.items()}
    g = pairs.groupBy(*keys).agg(*(c.alias(f"s_{n}") for n, c in s.items()), F.count("*").alias("pairs"))
    c = lambda n: F.col(f"s_{n}")
    det3 = lambda a, b, d: a[0] * (b[1] * d[2] - b[2] * d[1]) - b[0] * (a[1] * d[2] - a[2] * d[1]) + d[0] * (a[1] * b[2] - a[2] * b[1])
    x, y, one = (c("xx"), c("xy"), c("x")), (c("xy"), c("yy"), c("y")), (c("x"), c("y"), c("w"))
    base = det3(x, y, one)
    out = {}
    for names, r in ((("a", "b", "tx"), (c("xu"), c("yu"), c("u"))), (("c", "d", "ty"), (c("xv"), c("yv"), c("v")))):
        out |= {names[0]: F.try_divide(det3(r, y, one), base), names[1]: F.try_divide(det3(x, r, one), base), names[2]: F.try_divide(det3(x, y, r), base)}
    return g.select(*keys, *(e.alias(n) for n, e in out.items()), "pairs")


def fit_logistic(rows: DataFrame, features: list[str], label: str, rate: float = 0.01, steps: int = 50) -> dict[str, float]:
    """Batch gradient descent without intercept: one aggregate of the gradient per step over the features, which are written once; the
    weights alone reach the driver."""
    rows = written(rows.select(*features, label), "logistic")
    w = np.zeros(len(features))
    y = F.col(label).cast("double")
    for _ in range(steps):
        z = sum((F.lit(float(k)) * F.col(f) for k, f in zip(w, features)), F.lit(0.0))
        r = 1 / (1 + F.exp(-z)) - y
        got = rows.agg(*(F.avg(r * F.col(f)).alias(f) for f in features)).first()
        w -= rate * np.array([got[f] or 0.0 for f in features])
    dropped(rows)
    return dict(zip(features, map(float, w)))


def logistic(weights: dict[str, float]) -> Column:
    return 1 / (1 + F.exp(-sum((F.lit(w) * F.col(f) for f, w in weights.items()), F.lit(0.0))))


def linear_score(features: Column, weights: Column, bias: Column) -> Column:
    """bias + sum of weight times feature over two maps; features without a value or weight count nothing."""
    return F.aggregate(F.map_entries(features), bias, lambda s, e: s + F.coalesce(e["value"] * F.try_element_at(weights, e["key"]), F.lit(0.0)))


def weighted_profile(rows: DataFrame, key: str, columns: list[str], weight: str = "confidence") -> DataFrame:
    """Confidence-weighted mean of each column per key."""
    return rows.groupBy(key).agg(*(F.try_divide(F.sum(F.col(c) * F.col(weight)), F.sum(weight)).alias(c) for c in columns), F.count("*").alias("n"))


def similar(rows: DataFrame, query: dict[str, float], scales: dict[str, float], k: int) -> DataFrame:
    """The k rows most similar to a query: mean exponential decay over features, ties by id."""
    parts = [F.exp(-F.abs(F.col(f) - F.lit(float(v))) / F.lit(float(scales[f]))) for f, v in query.items()]
    return rows.withColumn("similarity", sum(parts, F.lit(0.0)) / len(parts)).orderBy(F.desc("similarity"), "id").limit(k)
