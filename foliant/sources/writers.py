"""Sinks: CSV, JSON lines, partitioned stores with upserts and tombstones, text reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import first_by


def csv_cell(value: Column) -> Column:
    """A cell, quoted if it holds a quote, comma or line break; empty for null."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One text line per row."""
    return df.select(F.concat_ws(",", *(csv_cell(F.col(f"`{c}`")) for c in columns)).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quoteAll=False, escape='"', emptyValue="", nullValue="").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def merged(old: DataFrame, new: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The latest row per key, new over old at equal versions, the untouched columns of old kept where new has null."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "__new", version)]
    order = F.struct(version, "__new")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
    return both.groupBy(*keys).agg(*(last(c) for c in rest), F.max(version).alias(version))


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], partition: str = "uid") -> None:
    """Merge rows into a partitioned store: only the partitions that occur in new are rewritten, by dynamic overwrite."""
    touched = new.select(partition).distinct()
    try:
        old = spark.read.parquet(path).join(touched, partition, "left_semi")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = new.limit(0)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    merged(old, new, keys).write.mode("overwrite").parquet(staged)  # the source must not be overwritten while it is read
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def tombstones(keys: DataFrame) -> DataFrame:
    """Rows that mark keys deleted."""
    return keys.withColumn("status", F.lit("deleted"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_by(rows, keys, [F.desc(order)])


def report_lines(df: DataFrame, template: str, columns: list[str]) -> DataFrame:
    """line: a formatted text of every row."""
    return df.select(F.format_string(template, *(F.col(c) for c in columns)).alias("line"))


def write_report(df: DataFrame, path: str, template: str, columns: list[str]) -> None:
    """A text report of any size: every row of df as a line, in the order of df's partitions."""
    report_lines(df, template, columns).write.mode("overwrite").text(path)


def report(df: DataFrame, title: str, template: str, columns: list[str], most: int = 1000) -> str:
    """A text report of a small result: a title line, then one formatted line per row. More than `most` rows are an error; use write_report."""
    lines = report_lines(df, template, columns).limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"a report of over {most} lines belongs into a file")
    return "\n".join([title, *(r["line"] for r in lines)])
