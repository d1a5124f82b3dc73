"""Table cells from tokens: which tokens of a page lie in a column and a row band.

Both are intervals, so tokens meet columns by slices of the page's width and bands by slices of its height (equi-joins on key and
slice with the exact test behind), and cells are where a token has both.

Defined results: a token without visible text is in no cell; ties go to the smaller y, x, then id; a column without expected
edges or without tolerance keeps all its tokens; a cell without tokens has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACROSS, OVERLAP, KEPT = 1.0, 0.35, 3


def slices(low: Column, high: Column, size: float) -> Column:
    """Every slice of the given size that [low, high] touches."""
    return F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))


def column_tokens(tokens: DataFrame, columns: DataFrame, keys: list[str], size: float = 50.0) -> DataFrame:
    """tokens (keys, id, x, y, w, h, text) with column_id, diff (distance from where the column's alignment expects them) and tolerance.

    columns: column_id, x0, x1, header_bottom, header_pad, expected_left, expected_right, expected_center, tolerance, align. A token
    belongs to a column if its centre is within its edges, give or take 1, and below its header."""
    left, right = F.col("expected_left"), F.col("expected_right")
    center = F.coalesce("expected_center", (left + right) / 2)
    c = columns.select(*keys, "column_id", "x0", "x1", (F.col("header_bottom") + F.col("header_pad")).alias("header"), left.alias("e_left"), right.alias("e_right"), center.alias("e_center"), "tolerance", F.coalesce("align", F.lit("left")).alias("align"), slices(F.col("x0") - ACROSS, F.col("x1") + ACROSS, size).alias("slice"))
    t = tokens.where(F.trim("text") != "").withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2})
    t = t.withColumn("slice", F.floor(F.col("cx") / size)).join(c, [*keys, "slice"]).where(F.col("cx").between(F.col("x0") - ACROSS, F.col("x1") + ACROSS) & (F.col("cy") > F.col("header")))
    off = {"left": F.abs(F.col("x") - F.col("e_left")), "right": F.abs(F.col("x") + F.col("w") - F.col("e_right")), "center": F.abs(F.col("cx") - F.col("e_center"))}
    own = F.when(F.col("align") == "right", off["right"]).when(F.col("align") == "center", off["center"])
    diff = F.coalesce(own, off["left"], off["right"], off["center"], F.lit(0.0))
    return t.select(*tokens.columns, "column_id", diff.alias("diff"), "tolerance")


def band_tokens(tokens: DataFrame, bands: DataFrame, keys: list[str], size: float = 50.0) -> DataFrame:
    """keys, id, band_id of the tokens that overlap a band (band_id, y0, y1) by 35 percent of the lower of both."""
    b = bands.select(*keys, "band_id", "y0", "y1", slices(F.col("y0"), F.col("y1"), size).alias("slice"))
    t = tokens.select(*keys, "id", "y", "h", slices(F.col("y"), F.col("y") + F.col("h"), size).alias("slice"))
    p = t.join(b, [*keys, "slice"]).where(F.col("slice") == F.floor(F.greatest("y", "y0") / size))  # each pair once
    over = F.least(F.col("y") + F.col("h"), F.col("y1")) - F.greatest("y", "y0")
    return p.where(over >= F.least(F.col("h"), F.col("y1") - F.col("y0")) * OVERLAP).select(*keys, "id", "band_id")


def cell_tokens(tokens: DataFrame, columns: DataFrame, bands: DataFrame, keys: list[str], size: float = 50.0) -> DataFrame:
    """keys, column_id, band_id, id, x, y, w, h, text, diff, aligned, best_diff of the tokens of every cell.

    Where the column has a tolerance, tokens within it stay; where none is, the one nearest to the expected edge, of three or more
    the two nearest, stay all the same, not aligned."""
    p = column_tokens(tokens, columns, keys, size).join(band_tokens(tokens, bands, keys, size), [*keys, "id"])
    cell = [*keys, "column_id", "band_id"]
    w = Window.partitionBy(*cell)
    strict = F.coalesce(F.col("tolerance"), F.lit(0.0)) > 0
    p = p.withColumns({"near": F.col("diff") <= F.col("tolerance"), "place": F.row_number().over(w.orderBy("diff", "y", "x", "id"))})
    p = p.withColumns({"hits": F.sum(F.when(F.col("near"), 1).otherwise(0)).over(w), "n": F.count("*").over(w), "best_diff": F.min("diff").over(w)})
    keep = ~strict | F.when(F.col("hits") > 0, F.col("near")).otherwise(F.col("place") <= F.ceil(F.least(F.lit(KEPT), F.col("n")) / 2))
    return p.where(keep).select(*cell, "id", "x", "y", "w", "h", "text", "diff", (~strict | (F.col("hits") > 0)).alias("aligned"), F.when(strict, F.col("best_diff")).alias("best_diff"))


def cell_texts(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, column_id, band_id, text (tokens from left to right), tokens, aligned of every cell of cell_tokens()."""
    said = F.struct("x", "y", "w", "id", F.trim("text").alias("text"))
    g = found.groupBy(*keys, "column_id", "band_id").agg(F.array_sort(F.collect_list(said)).alias("row"), F.count("*").alias("tokens"), F.bool_and("aligned").alias("aligned"))
    return g.select(*keys, "column_id", "band_id", F.array_join(F.transform("row", lambda r: r["text"]), " ").alias("text"), "tokens", "aligned")
