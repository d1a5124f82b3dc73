"""Sources: CSV as text, JSON lines with errors, log lines, key-value stores, chunked documents, OCR tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; every cell a string, quotes doubled, no line breaks inside cells, a leading BOM dropped."""
    df = spark.read.options(header=True, inferSchema=False, quote='"', escape='"', multiLine=False, emptyValue="", nullValue="\0").csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns)).na.fill("")  # blank cells are empty texts


def csv_lines(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Cells of text lines (column value) under the given column names."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    bare = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r$", "")
    return lines.where(F.length("value") > 0).select(F.from_csv(bare, schema, {"quote": '"', "escape": '"', "emptyValue": ""}).alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed columns, file, line_no within it (from 1, blank lines counted), and error for lines that are no JSON object; blank
    lines are dropped. A line's number is its place in its split of the file, after the lines of the splits before."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")
    splits = splits.select("file", "split", (before - F.col("first") + 1).alias("base"))
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(F.trim("value") != "").join(splits, ["file", "split"])
    return rows.select("file", (F.col("at") + F.col("base")).alias("line_no"), parsed.alias("r")).select("file", "line_no", "r.*").withColumnRenamed("_bad", "error")


def safe_json(column: str) -> Column:
    """VARIANT of a text, null if it is no JSON."""
    return F.try_parse_json(F.col(column))


def tokens(raw: DataFrame, source: str | None = None) -> DataFrame:
    """OCR tokens (doc_id, page, id, text, x, y, w, h, confidence, source): blanks dropped, confidence 0.75 by default."""
    own = raw if source is None else raw.where(F.col("source") == source)
    text = T.collapse(F.col("text"))
    box = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in "xywh"}
    named = own.withColumns({"text": text, "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.75)), "page": F.coalesce("page", F.lit(1))} | box).where("text <> ''")
    return named.withColumns({"char_count": F.length("text"), "aspect_ratio": F.try_divide("w", F.nullif("h", F.lit(0.0)))})


def key_values(rows: DataFrame, user: str) -> DataFrame:
    """Stored profiles of a user: keys wiz.profile.<user>.<type>[.<wizard>[.<geometry>]] split to columns."""
    prefix = f"wiz.profile.{user}."
    part = lambda k: F.nullif(F.split_part("key", F.lit("."), F.lit(k)), F.lit(""))
    return rows.where(F.startswith("key", F.lit(prefix))).select(part(3).alias("user"), part(4).alias("doc_type"), part(5).alias("wizard_id"), part(6).alias("geometry_id"), "value")


def chunks(df: DataFrame, key: str, value: str, size: int = 450_000, most: int = 900_000) -> DataFrame:
    """key, n, i, data: long values in pieces of `size` characters, values up to `most` bytes in one."""
    n = F.when(F.octet_length(value) > most, F.ceil(F.length(value) / size)).otherwise(1).cast("int")
    return df.select(key, n.alias("n"), value).select(key, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), value).select(key, "n", "i", F.when(F.col("n") == 1, F.col(value)).otherwise(F.substr(value, F.col("i") * size + 1, F.lit(size))).alias("data"))


def reassembled(pieces: DataFrame, key: str) -> DataFrame:
    """key, value from chunks in order; a missing chunk is an error."""
    whole = pieces.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "data"))).alias("c"))
    joined = F.array_join(F.transform("c", lambda x: x["data"]), "")
    return whole.select(key, F.when(F.size("c") == F.col("n"), joined).otherwise(F.raise_error(F.concat(F.lit("missing chunk of "), F.col(key).cast("string")))).alias("value"))


def store(spark: SparkSession, path: str, uid: str, wizard_id: str | None = None) -> DataFrame:
    """Documents of a store partitioned by uid and wizard_id; the filter prunes partitions."""
    df = spark.read.parquet(path).where(F.col("uid") == uid)
    return df if wizard_id is None else df.where(F.col("wizard_id") == wizard_id)


def images(spark: SparkSession, path: str) -> DataFrame:
    """Binary page images with path and length."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
