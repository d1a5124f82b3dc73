"""Keep one row per key: by confidence, by order, latest per unordered pair, bounded logs, key-wise merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_by(rows: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark limits groups before the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def best_confidence(rows: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """The most confident record per key, the newer of equals, the first to arrive of full ties."""
    return first_by(rows, keys, [F.coalesce(F.col("confidence"), F.lit(0.0)).desc(), F.coalesce(F.col("ts"), F.lit(0)).desc(), F.col(arrival)])


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_by(rows, keys, [F.desc(order)])


def latest_pairs(rows: DataFrame, a: str, b: str, order: str) -> DataFrame:
    """The last row of each unordered pair, with columns low and high."""
    return first_by(rows.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)}), ["low", "high"], [F.desc(order)])


def seen_boxes(rows: DataFrame) -> DataFrame:
    """The first candidate of each page and rounded box."""
    return first_by(rows, ["page", *(F.round(c, 0) for c in "xywh")], [F.col("order")])


def keep_last(rows: DataFrame, n: int, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """A log bounded to its last n entries, per key or in all."""
    if keys:
        return first_by(rows, list(keys), [F.desc(order)], n)
    return rows.orderBy(F.desc(order)).limit(n)


def local_wins(local: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of local, and those of other whose key local lacks."""
    return local.unionByName(other.join(local.select(*keys), keys, "left_anti"))


def import_new(store: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """store with the incoming records of new ids, each id once."""
    return store.unionByName(first_by(incoming, [key], [F.col(order)]).join(store.select(key), key, "left_anti"))


def without_deleted(rows: DataFrame) -> DataFrame:
    return rows.where(F.coalesce(F.col("status"), F.lit("")) != "deleted")


def read_through(remote: DataFrame, cache: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Remote values that are not deleted; the cached one where remote has none."""
    live = without_deleted(remote).select(*keys, F.col(value).alias("__r"))
    return live.join(cache.select(*keys, F.col(value).alias("__c")), keys, "full_outer").select(*keys, F.coalesce("__r", "__c").alias(value), F.when(F.col("__r").isNotNull(), "remote").otherwise("cache").alias("origin"))
