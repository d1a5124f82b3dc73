"""Event tables for charts: header aliases, last row per document, valid dates, long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, numeric

MEASURES = ("money_in", "money_out", "gross_or_total", "ytd_total")
#: Other names of the columns, in order of preference.
ALIASES = {"event_date": ["event_date"], "money_in": ["money_in"], "money_out": ["money_out"], "gross_or_total": ["gross_or_total", "total_amount"], "ytd_total": ["ytd_total"], "doc_id": ["doc_id", "file_id"]}


class MissingColumns(ValueError):
    """Required columns that no header names."""


def _plain(name: str) -> str:
    import re

    return re.sub("[^a-z0-9_]", "", re.sub(r"\s+", "_", name.strip().lower()))


def resolve_columns(rows: DataFrame) -> DataFrame:
    """The canonical columns as text, found by name or alias; ytd_total may be missing."""
    names = {}
    for c in rows.columns:
        names.setdefault(_plain(c), c)
    found = {k: next((names[a] for a in aliases if a in names), None) for k, aliases in ALIASES.items()}
    if lost := [k for k, c in found.items() if c is None and k != "ytd_total"]:
        raise MissingColumns(", ".join(f"Missing required column: {k}" for k in lost))
    order = [c for c in ("row_index",) if c in rows.columns]
    return rows.select(*order, *((F.col(f"`{c}`").cast("string") if c else F.lit(None).cast("string")).alias(k) for k, c in found.items()))


def latest_rows(rows: DataFrame) -> DataFrame:
    """Parsed rows, the last of each document by row_index (blank doc_ids stay apart); before, whether the date is valid."""
    key = F.coalesce(F.nullif(F.trim("doc_id"), F.lit("")), F.concat(F.lit("__row_"), F.col("row_index").cast("string")))
    parsed = rows.select("row_index", dates.event_date(F.col("event_date")).alias("event_date"), *(numeric.parse_numeric(F.col(m)).alias(m) for m in MEASURES), key.alias("doc_id"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("row_index"))
    return parsed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def events(rows: DataFrame) -> DataFrame:
    """Valid events; a later row with a bad date removes an earlier good one, as the last row counts."""
    return latest_rows(resolve_columns(rows)).where(F.col("event_date").isNotNull()).drop("row_index")


def datasets(found: DataFrame) -> DataFrame:
    """series, x, y of every finite measure."""
    return found.unpivot(["event_date", "doc_id"], list(MEASURES), "series", "y").where(F.col("y").isNotNull()).select("series", F.col("event_date").alias("x"), "y", "doc_id")


def summary(rows: DataFrame) -> DataFrame:
    """Rows read, used, excluded by date, and collisions resolved."""
    last = latest_rows(resolve_columns(rows))
    one = last.agg(F.count("*").alias("documents"), F.count("event_date").alias("rows_used"))
    read = rows.agg(F.count("*").alias("rows_read"))
    return read.crossJoin(one).select("rows_read", "rows_used", (F.col("documents") - F.col("rows_used")).alias("rows_excluded"), (F.col("rows_read") - F.col("documents")).alias("collisions"))
