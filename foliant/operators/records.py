"""From field entries to records, and from records to sheets: field maps, compiled records, table configuration, root and area sheets.

Entries are rows (file_id, seq, field_key, value, raw, confidence). A file's fields, items and warnings fit a row; files are
spread by file_id, and entries are reduced to the last of each key before they are gathered. Defined results: null confidences
count 0, null values are empty, entries without field_key are dropped, equal seq are decided by the larger value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from . import tabular
from .dedupe import first_by

FIELD = "struct<value:string,raw:string,confidence:double>"
#: The fields behind a record's invoice and totals, and the names of row modes.
INVOICE = {"number": "invoice_number", "sales_date": "invoice_date", "salesperson": "salesperson_rep", "store": "store_name"}
TOTALS = {"subtotal": "subtotal_amount", "tax": "tax_amount", "total": "invoice_total", "discount": "discounts_amount"}
TABLE_MODES = ("table", "table-like", "table_rows", "rows")
BLOCK_MODES = ("block", "repeating-block", "block_row", "block_rows")


def leading_number(text: Column) -> Column:
    """The number that a text begins with, null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1), F.lit("")).try_cast("double")


def selection_first(raw: Column, cleaned: Column) -> Column:
    """The cleaned text of a selection; where cleaning leaves nothing, the text itself."""
    return F.coalesce(F.nullif(cleaned, F.lit("")), raw, F.lit(""))


def field_rows(entries: DataFrame, expected: list[str], area_keys: list[str] | None = None) -> DataFrame:
    """file_id, field_key, value, raw, confidence: each file's last entry of a key, keys of areas left out, expected keys filled up blank."""
    own = entries.where(F.col("field_key").isNotNull() & ~F.col("field_key").isin(area_keys or []))
    cells = {"value": F.coalesce(F.col("value").cast("string"), F.lit("")), "raw": F.coalesce(F.col("raw").cast("string"), F.lit("")), "confidence": F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))}
    last = first_by(own.withColumns(cells), ["file_id", "field_key"], [F.desc("seq"), F.desc("value")]).select("file_id", "field_key", *cells)
    blank = entries.select("file_id").distinct().select("file_id", F.explode(F.array(*map(F.lit, expected)) if expected else F.array().cast("array<string>")).alias("field_key"))
    missing = blank.join(last.select("file_id", "field_key"), ["file_id", "field_key"], "left_anti")
    return last.unionByName(missing.select("*", F.lit("").alias("value"), F.lit("").alias("raw"), F.lit(0.0).alias("confidence")))


def field_map(entries: DataFrame, expected: list[str], area_keys: list[str] | None = None) -> DataFrame:
    """file_id, fields (map of FIELD by key)."""
    rows = field_rows(entries, expected, area_keys)
    one = F.struct("field_key", F.struct("value", "raw", "confidence").alias("field"))
    return rows.groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(one))).alias("fields"))


def _value(key: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("fields"), F.lit(key))["value"], F.lit(""))


def _confident(keys: tuple[str, ...], change) -> Column:
    """fields with the confidence of these keys changed and held to [0, 1]."""
    return F.transform_values("fields", lambda k, v: F.when(k.isin(*keys), v.withField("confidence", N.clamp(change(v["confidence"]), 0.0, 1.0))).otherwise(v))


def compiled(fields: DataFrame, line_items: DataFrame) -> DataFrame:
    """Records: file_id, fields, invoice, totals, line_items (numbered, amounts filled in), line_sum, warnings.

    fields: file_id, fields of field_map(); line_items: file_id, line_items (array of tabular.ITEM). Subtotal, tax and total that
    add up to within 1 gain 0.05 of confidence each, others lose 0.2; lines whose known amounts miss the subtotal by over 0.02
    are a warning and cost the subtotal a fifth of its confidence."""
    r = fields.join(line_items, "file_id", "left")
    sub, tax, total = (leading_number(_value(TOTALS[k])) for k in ("subtotal", "tax", "total"))
    off = F.abs(sub + tax - total)
    shift = F.when(off.isNull(), 0.0).when(off < 1, 0.05).otherwise(-0.2)
    r = r.withColumn("__shift", shift).withColumn("fields", _confident(("subtotal_amount", "tax_amount", "invoice_total"), lambda c: c + F.col("__shift")))
    r = r.withColumn("line_items", tabular.enrich_items(F.coalesce("line_items", F.array().cast(f"array<{tabular.ITEM}>"))))
    amounts = F.transform("line_items", lambda x: leading_number(x["amount"]))
    r = r.withColumn("__amounts", amounts).withColumn("line_sum", F.aggregate("__amounts", F.lit(0.0), lambda s, a: s + F.coalesce(a, F.lit(0.0))))
    # sums of cents are not exact in binary: two cents apart must not count as more
    off_lines = F.coalesce(F.forall("__amounts", lambda a: a.isNotNull()) & (F.round(F.abs(F.col("line_sum") - sub), 6) > 0.02), F.lit(False))
    r = r.withColumn("__off", off_lines).withColumn("fields", F.when(F.col("__off"), _confident(("subtotal_amount",), lambda c: c * 0.8)).otherwise(F.col("fields")))
    invoice = F.struct(*(T.collapse(_value(f)).alias(k) for k, f in INVOICE.items()))
    totals = F.struct(*(_value(f).alias(k) for k, f in TOTALS.items()))
    warnings = F.when(F.col("__off"), F.array(F.lit("line_totals_vs_subtotal"))).otherwise(F.array().cast("array<string>"))
    return r.select("file_id", "fields", invoice.alias("invoice"), totals.alias("totals"), "line_items", "line_sum", warnings.alias("warnings"))


def as_table_records(records: DataFrame, place: str = "file_id") -> DataFrame:
    """Compiled records as tabular.flatten() takes them; place: the column that orders them, a whole number."""
    fields = F.transform_values("fields", lambda k, v: v["value"])
    totals = F.map_from_arrays(F.array(*map(F.lit, TOTALS)), F.array(*(F.col("totals")[k] for k in TOTALS)))
    return records.select(F.col(place).cast("long").alias("doc_seq"), F.col("file_id").cast("string").alias("file_id"), fields.alias("fields"), totals.alias("totals"), "line_items")


def _text(*candidates) -> str:
    return next((" ".join(str(c).split()) for c in candidates if c is not None and str(c).strip()), "")


def row_mode(area: dict) -> str:
    """table, block or nothing, by any of the names that configurations use."""
    mode = _text(area.get("row_mode"), area.get("row_behavior"), area.get("row_type"), area.get("type")).lower()
    return "table" if mode in TABLE_MODES else "block" if mode in BLOCK_MODES else ""


def normalized_config(config: dict | None) -> dict:
    """A table configuration with every default filled in: static_fields (key, label), area_keys, document_keys, areas, has_document_fields,
    include_line_items, line_item_fields, custom, global_fields. Fields of areas, or below them, are no document fields."""
    c = config or {}
    named = [f | {"key": key, "label": f.get("label") or key} for f in c.get("static_fields") or [] if (key := f.get("field_key") or f.get("key") or f.get("name"))]
    static = [f for f in named if not f.get("is_area")]
    area_keys = list(dict.fromkeys(k for k in [*(c.get("area_keys") or []), *(f["key"] for f in named if f.get("is_area") or f.get("is_subordinate"))] if k))
    given = c.get("document_keys")
    documents = [k for k in given if k] if given is not None else [f["key"] for f in static]
    areas = []
    for a in c.get("areas") or []:
        own = {"area_id": _text(a.get("id"), a.get("area_id"), a.get("key"), a.get("name")), "area_name": _text(a.get("name"), a.get("label"), a.get("id"), a.get("area_id"))}
        columns = [_text(x.get("key"), x.get("field_key"), x.get("name")) if isinstance(x, dict) else _text(x) for x in a.get("columns") or []]
        if own["area_id"] or own["area_name"]:
            areas.append(own | {"aliases": [t for x in a.get("aliases") or [] if (t := _text(x))], "columns": [x for x in columns if x], "row_mode": row_mode(a)})
    return {
        "custom": bool(c.get("custom")), "static_fields": static, "area_keys": area_keys, "document_keys": documents, "areas": areas,
        "has_document_fields": bool(documents) or (given is None and not area_keys),
        "include_line_items": bool(c.get("include_line_items", True)), "line_item_fields": c.get("line_item_fields") or [], "global_fields": c.get("global_fields") or [],
    }


def root_sheet(records: DataFrame, config: dict) -> DataFrame:
    """The root table: the configured columns of a custom table, else the invoice table."""
    if not config["custom"]:
        return tabular.flatten(records)
    static = {f["label"]: f["key"] for f in config["static_fields"] if f["key"] in config["document_keys"]}
    columns = {f.get("label") or f["key"]: f["key"] for f in config["line_item_fields"]} if config["include_line_items"] else {}
    return tabular.flatten_custom(records, static, columns)


def sheets(records: DataFrame, area_rows: DataFrame | None, config: dict | None) -> dict[str, DataFrame]:
    """The tables of a batch: "root", and one for every area that has rows, by its name.

    records: as tabular.flatten(); area_rows: file_id, area_id, area_name, row_mode, fields, rows. Only the areas that occur are
    gathered by the driver. The root is left out where the configuration has no document fields or where areas have rows and it has
    none; neither rows nor areas is an error."""
    c = normalized_config(config)
    found: dict[str, DataFrame] = {}
    if area_rows is not None:
        known = [(i, a["area_id"], a["area_name"], a["aliases"]) for i, a in enumerate(c["areas"])]
        registry = tabular.area_registry(area_rows.sparkSession.createDataFrame(known, "seq int, area_id string, area_name string, aliases array<string>"))
        resolved = tabular.resolve_areas(area_rows, registry)
        modes = {a["area_id"]: a["row_mode"] for a in c["areas"] if a["row_mode"]}
        mode = reduce(lambda other, m: F.when(F.col("resolved_id") == m[0], m[1]).otherwise(other), modes.items(), F.col("row_mode"))
        cells = tabular.area_cells(resolved.withColumn("row_mode", mode))
        names = {r.resolved_id: r.resolved_name for r in resolved.groupBy("resolved_id").agg(F.min("resolved_name").alias("resolved_name")).collect()}
        columns = {a["area_id"]: a["columns"] for a in c["areas"]}
        for area, name in sorted(names.items()):
            found[name] = tabular.sheet(cells, area, columns.get(area) or None)
    root = root_sheet(records, c)
    some = bool(root.take(1))
    if not some and not found:
        raise ValueError("Exporter input empty")
    return ({"root": root} if c["has_document_fields"] and (some or not found) else {}) | found
