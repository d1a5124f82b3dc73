"""Records with nested line items to checked tables.

A record is file_id STRING, fields MAP<STRING,STRING>, totals MAP<STRING,STRING>, line_items ARRAY<ITEM>. Rows are kept in
the order (doc_seq, idx): doc_seq is the record's place, idx the item's. Steps that the batch shares (line numbers,
presence of real ones) aggregate by document first and join the small result back, so no window spans the batch's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from .scratch import written

ITEM = "struct<sku:string,description:string,quantity:string,unit_price:string,amount:string,line_no:string,row_number:int,missing:map<string,string>>"
#: The exported header, the field behind each invoice column, and the words that only name a column.
HEADER = ["Store / Business Name", "Department / Division", "Invoice #", "Invoice Date", "Salesperson", "Customer Name", "Customer Address", "Item Code (SKU)", "Item Description", "Quantity", "Unit Price", "Line Total", "Subtotal", "Discount", "Tax Amount", "Invoice Total", "Payment Method", "Payment Status", "Line No", "File ID"]
TEXT_FIELDS = {"store": "store_name", "dept": "department_division", "number": "invoice_number", "date": "invoice_date", "salesperson": "salesperson_rep", "customer": "customer_name", "address": "customer_address", "payment_method": "payment_method", "payment_status": "payment_status"}
NUMBER_FIELDS = {"subtotal": "subtotal_amount", "discount": "discounts_amount", "tax": "tax_amount", "total": "invoice_total"}
HEADER_WORDS = ("item", "description", "qty", "quantity", "unit", "price", "amount", "total")
#: Records whose lines a task numbers; their place among the batch's records is doc_seq.
STRETCH = 1 << 14
DYNAMIC, CORE = ("sku", "description", "quantity", "unit_price", "amount"), ("sku", "description", "quantity")


def field(key: str) -> Column:
    """A record's field, empty if missing."""
    return F.coalesce(F.try_element_at(F.col("fields"), F.lit(key)), F.lit(""))


def invoice_cells(records: DataFrame) -> DataFrame:
    """The cleaned invoice columns beside the record's own."""
    text = {k: T.collapse(field(f)) for k, f in TEXT_FIELDS.items()}
    return records.withColumns(text | {k: N.clean_numeric(field(f)) for k, f in NUMBER_FIELDS.items()})


def items(records: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_seq, file_id, idx and the cleaned cells of every line item; also: columns of the record to carry along."""
    rows = records.select("doc_seq", "file_id", *also, F.posexplode("line_items").alias("idx", "item"))
    clean = {"sku": T.collapse, "description": T.collapse, "quantity": N.clean_numeric, "unit_price": N.clean_numeric, "amount": N.clean_numeric, "line_no": T.collapse}
    return rows.select("doc_seq", "file_id", *also, "idx", *(f(F.col("item")[c]).alias(c) for c, f in clean.items()), F.col("item.row_number").alias("row_number"), F.col("item.missing").alias("missing"))


def numeric_filled() -> Column:
    return (F.col("quantity") != "") | (F.col("unit_price") != "") | (F.col("amount") != "")


def usable() -> Column:
    return (F.col("description") != "") & numeric_filled()


def mark_zero_rows(rows: DataFrame) -> DataFrame:
    """Described rows without numbers, next to a row with numbers (row numbers at most one apart), become 1.00 at 0.00."""
    w = Window.partitionBy("doc_seq").orderBy("idx")
    place = F.coalesce("row_number", F.col("idx") + 1)
    marked = rows.withColumn("__n", numeric_filled()).withColumn("__r", place)
    beside = lambda f: F.coalesce(f("__n").over(w) & (F.abs(F.col("__r") - f("__r").over(w)) <= 1), F.lit(False))
    word = F.lower(F.trim("description"))
    titled = word.isin(*HEADER_WORDS) | (F.length(word) <= 2)
    zero = (F.col("description") != "") & ~titled & ~F.col("__n") & (beside(F.lag) | beside(F.lead))
    marked = marked.withColumn("synthetic_zero", zero)
    fill = lambda c, v: F.when(F.col("synthetic_zero") & (F.col(c) == ""), v).otherwise(F.col(c))
    return marked.withColumns({"quantity": fill("quantity", "1.00"), "unit_price": fill("unit_price", "0.00"), "amount": fill("amount", "0.00")}).drop("__n", "__r")


def _most(rows: Column) -> Column:
    """The commonest positive count of the core columns (n_<column>), the smaller of equally common ones; of all columns if no core one is filled."""

    def commonest(columns: tuple[str, ...]) -> Column:
        values = F.filter(F.array(*(F.col(f"n_{c}") for c in columns)), lambda v: v > 0)
        often = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda u: u == v))).alias("f"), v.alias("v")))
        return F.array_min(often)["v"]

    return F.least(F.coalesce(commonest(CORE), commonest(DYNAMIC), rows), rows)


def majority(rows: DataFrame) -> DataFrame:
    """doc_seq, original_rows, majority (rows to keep) and the non-blank counts of each document."""
    counts = rows.groupBy("doc_seq").agg(F.count("*").alias("original_rows"), *(F.count_if(F.col(c) != "").alias(f"n_{c}") for c in DYNAMIC))
    return counts.withColumn("majority", _most(F.col("original_rows")))


def select_majority(rows: DataFrame) -> DataFrame:
    """The densest rows of each document up to its majority count; rows without any cell only fill up, in row order. kept: the place among them."""
    filled = reduce(lambda a, b: a + b, (F.when(F.col(c) != "", 1).otherwise(0) for c in DYNAMIC))
    place = F.coalesce("row_number", F.col("idx") + 1)
    own = Window.partitionBy("doc_seq")
    counted = rows.withColumns({f"n_{c}": F.count_if(F.col(c) != "").over(own) for c in DYNAMIC} | {"__rows": F.count("*").over(own)})
    ranked = counted.withColumn("__f", filled).withColumn("__r", place).withColumn("__k", F.row_number().over(own.orderBy(F.desc("__f"), "__r", "idx")))
    chosen = ranked.where(F.col("__k") <= _most(F.col("__rows"))).drop("__f", "__r", "__k", "__rows", *(f"n_{c}" for c in DYNAMIC))
    return chosen.withColumn("kept", F.row_number().over(own.orderBy("idx")))


def infer_lines(rows: DataFrame) -> DataFrame:
    q, a, assumed = N.infer(F.col("quantity"), F.col("unit_price"), F.col("amount"))
    return rows.select("*", q.alias("__q"), a.alias("__a"), assumed.alias("assumed_quantity")).withColumns({"quantity": F.col("__q"), "amount": F.col("__a")}).drop("__q", "__a")


def number_lines(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Running numbers for usable rows across the whole batch, unless any row of it has a numeric line number.

    Numbers count on from those of the stretches of doc_seq before, whose sums are a small table."""
    real = F.col("line_no").rlike(r"^\s*[-+]?(\d|\.\d)")
    open_ = usable() & (F.col("line_no") == "")
    rows = rows.withColumn("__s", F.floor(F.col("doc_seq") / stretch))
    per = rows.groupBy("__s").agg(F.count_if(open_).alias("n"), F.max(real).alias("real"))
    per = per.select("__s", (F.sum("n").over(Window.orderBy("__s")) - F.col("n")).alias("__base"), F.max("real").over(Window.partitionBy()).alias("__real"))
    inside = F.sum(F.when(open_, 1).otherwise(0)).over(Window.partitionBy("__s").orderBy("doc_seq", "idx"))
    known = rows.withColumn("__i", inside).join(per, "__s")
    given = ~F.col("__real") & open_
    number = F.when(given, (F.col("__base") + F.col("__i")).cast("string")).otherwise(F.col("line_no"))
    return known.withColumn("virtual_line_no", given).withColumn("line_no", number).drop("__i", "__base", "__real", "__s")


def single_item_fallback(rows: DataFrame, records: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """If the batch has no usable row, one row for the first record with a subtotal or total."""
    r = invoice_cells(records)
    total = lambda k: F.coalesce(F.nullif(F.col(k), F.lit("")), F.nullif(N.clean_numeric(F.try_element_at(F.col("totals"), F.lit(k))), F.lit("")))
    first = r.withColumn("__amount", F.coalesce(total("subtotal"), total("total"))).where(F.col("__amount").isNotNull()).orderBy("doc_seq").limit(1)
    none = rows.agg(F.coalesce(F.max(usable()), F.lit(False)).alias("__some"))
    own = first.crossJoin(none).where(~F.col("__some"))  # one row by one row
    amount, one = F.col("__amount"), F.lit("1.00")
    cells = {"sku": F.lit(""), "description": F.lit("Primary Item (single-item contract)"), "quantity": one, "unit_price": amount, "amount": amount, "line_no": F.lit("1"), "row_number": F.lit(1), "kept": F.lit(1)}
    row = own.select("doc_seq", "file_id", *also, F.lit(0).alias("idx"), *(v.alias(k) for k, v in cells.items()))
    return rows.unionByName(row, allowMissingColumns=True)


def selected_items(records: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """All item steps up to numbering. The selected rows are written before, as their numbers need the sums of all of them."""
    return number_lines(written(infer_lines(select_majority(mark_zero_rows(items(records, also)))), "items"))


def flatten(records: DataFrame, fallback: bool = True) -> DataFrame:
    """The exported table: one row per selected item with the columns of HEADER, then doc_seq and idx for order."""
    heads = (*TEXT_FIELDS, *NUMBER_FIELDS)
    rows = selected_items(invoice_cells(records), heads)
    if fallback:
        rows = single_item_fallback(rows, records, heads)
    product = F.nullif(F.col("quantity"), F.lit("")).cast("double") * F.nullif(F.col("unit_price"), F.lit("")).cast("double")
    number = F.coalesce(F.nullif(F.col("line_no"), F.lit("")), F.coalesce(F.nullif(F.col("row_number"), F.lit(0)), F.col("kept")).cast("string"))
    out = rows.withColumns({"line_total": F.when(F.col("amount") == "", F.coalesce(N.fixed2(product), F.lit(""))).otherwise(F.col("amount")), "line_no": number})
    order = ["store", "dept", "number", "date", "salesperson", "customer", "address", "sku", "description", "quantity", "unit_price", "line_total", "subtotal", "discount", "tax", "total", "payment_method", "payment_status", "line_no", "file_id"]
    return out.select(*(F.col(c).alias(h) for c, h in zip(order, HEADER)), "doc_seq", "idx")


def missing_reasons(rows: DataFrame) -> DataFrame:
    """row (row number, else place in the batch is not needed: place in the document), column, reasons, flagged of blank or flagged cells."""
    place = F.coalesce(F.nullif(F.col("row_number"), F.lit(0)), F.col("idx") + 1)
    checked = ("sku", "quantity", "unit_price", "line_no")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.try_element_at(F.col("missing"), F.lit(c)).alias("flag")) for c in checked)))
    found = rows.select("doc_seq", place.alias("row"), cells.alias("c")).select("doc_seq", "row", "c.*")
    flags = F.when(F.col("flag").isNull(), F.array().cast("array<string>")).when(F.trim("flag").isin("", "true"), F.array(F.lit("flagged"))).otherwise(F.array(F.trim("flag")))
    reasons = F.array_sort(F.array_distinct(F.concat(flags, F.when(F.col("value") == "", F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>")))))
    return found.withColumn("reasons", reasons).where(F.size("reasons") > 0).select("doc_seq", "row", "column", "reasons", F.col("flag").isNotNull().alias("flagged"))


def missing_summary(rows: DataFrame) -> DataFrame:
    """column, rows (sorted distinct row numbers)."""
    return missing_reasons(rows).groupBy("column").agg(F.array_sort(F.collect_set("row")).alias("rows"))


def integrity(rows: DataFrame) -> DataFrame:
    """The batch's counts of filled, usable and synthetic rows."""
    some = lambda c: F.count_if(F.col(c) != "")
    zero = (F.col("unit_price") == "0.00") & (F.col("amount") == "0.00")
    return rows.agg(some("sku").alias("sku_count"), some("quantity").alias("qty_count"), some("unit_price").alias("price_count"), some("line_no").alias("line_no_count"), F.count_if(usable()).alias("usable_row_count"), F.count_if("synthetic_zero").alias("synthetic_zero_count"), F.count_if(zero).alias("zero_price_row_count"))


def flatten_custom(records: DataFrame, static: dict[str, str], item_columns: dict[str, str] | None = None) -> DataFrame:
    """Configured columns {label: field}, items {label: item key} if wanted; a record without items keeps one padded row."""
    head = {label: T.collapse(field(key)) for label, key in static.items()}
    if not item_columns:
        return records.select("doc_seq", F.lit(0).alias("idx"), *(c.alias(k) for k, c in head.items()), F.col("file_id").alias("File ID"))
    rows = records.select("doc_seq", "file_id", *(c.alias(k) for k, c in head.items()), F.posexplode_outer("line_items").alias("idx", "item"))
    return rows.select("doc_seq", F.coalesce("idx", F.lit(0)).alias("idx"), *head, *(T.collapse(F.col("item")[k]).alias(label) for label, k in item_columns.items()), F.col("file_id").alias("File ID"))


def first_non_blank(*candidates: Column) -> Column:
    return F.coalesce(*(F.nullif(T.collapse(c), F.lit("")) for c in candidates), F.lit(""))


def enrich_items(line_items: Column) -> Column:
    """Sequential line_no unless given, amount from quantity and price where missing."""
    num = lambda c: F.regexp_replace(c, "[^0-9.-]", "").try_cast("double")
    return F.transform(line_items, lambda x, i: x.withField("line_no", F.coalesce(F.nullif(F.trim(x["line_no"]), F.lit("")), (i + 1).cast("string"))).withField("amount", F.coalesce(F.nullif(F.trim(x["amount"]), F.lit("")), F.nullif(N.fixed2(num(x["quantity"]) * num(x["unit_price"])), F.lit("")), F.lit(""))))


def totals_check(records: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """file_id, line_sum, subtotal, consistent, confidence: line amounts against the subtotal, if every amount is known."""
    rows = records.select("file_id", N.parse_numeric(field("subtotal_amount")).alias("subtotal"), F.explode_outer("line_items").alias("i"))
    per = rows.groupBy("file_id", "subtotal").agg(F.sum(N.parse_numeric(F.col("i.amount"))).alias("line_sum"), F.bool_and(N.parse_numeric(F.col("i.amount")).isNotNull()).alias("known"))
    same = F.when(F.col("known") & F.col("subtotal").isNotNull(), F.abs(F.col("line_sum") - F.col("subtotal")) <= tolerance)
    return per.select("file_id", "line_sum", "subtotal", same.alias("consistent"), F.when(~same, 0.8).otherwise(1.0).alias("confidence"))


# areas

def area_registry(config: DataFrame) -> DataFrame:
    """alias, area_id, area_name: ids, names and aliases in lower case, the first registration of each."""
    names = F.concat(F.array("area_id", "area_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    rows = config.select("seq", "area_id", "area_name", F.posexplode(names).alias("k", "alias")).withColumn("alias", F.lower(T.collapse(F.col("alias")))).where("alias <> ''")
    w = Window.partitionBy("alias").orderBy("seq", "k")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("alias", "area_id", "area_name")


def resolve_areas(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows with resolved_id, resolved_name: by id, then by name, else their own."""
    by = lambda c, p: registry.select(F.col("alias").alias(f"__{p}"), F.col("area_id").alias(f"__{p}_id"), F.col("area_name").alias(f"__{p}_name")).withColumnRenamed(f"__{p}", f"__{p}_key")
    key = lambda c: F.lower(T.collapse(F.col(c)))
    found = rows.join(by("area_id", "i"), key("area_id") == F.col("__i_key"), "left").join(by("area_name", "n"), key("area_name") == F.col("__n_key"), "left")
    return found.select(*rows.columns, F.coalesce("__i_id", "__n_id", "area_id", "area_name").alias("resolved_id"), F.coalesce("__i_name", "__n_name", "area_name", "area_id").alias("resolved_name"))


def area_cells(rows: DataFrame) -> DataFrame:
    """Rows (file_id, resolved_id, row_mode, fields, rows) to long cells: nested rows in table mode, the first in block mode, own fields if none."""
    nested = F.when(F.col("row_mode") == "block", F.slice("rows", 1, 1)).otherwise(F.col("rows"))
    every = F.when(F.size(F.coalesce("rows", F.array().cast("array<map<string,string>>"))) > 0, F.transform(nested, lambda r: F.map_concat(F.map_filter("fields", lambda k, v: ~F.map_contains_key(r, k)), r))).otherwise(F.array("fields"))
    lines = rows.select("file_id", "resolved_id", F.posexplode(every).alias("row", "cells"))
    return lines.select("file_id", "resolved_id", "row", F.explode("cells").alias("column", "value")).withColumn("value", T.collapse(F.col("value")))


def sheet(cells: DataFrame, area_id: str, columns: list[str] | None = None) -> DataFrame:
    """One area's table: columns as they occur (or as given; then others raise), blanks empty, File ID last."""
    own = cells.where(F.col("resolved_id") == area_id)
    if columns is not None:
        own = own.withColumn("column", F.when(F.col("column").isin(*columns), F.col("column")).otherwise(F.raise_error(F.concat(F.lit("unexpected column "), F.col("column")))))
    wide = own.groupBy("file_id", "row").pivot("column", columns).agg(F.first("value")) if columns else own.groupBy("file_id", "row").pivot("column").agg(F.first("value"))
    names = [c for c in wide.columns if c not in ("file_id", "row")]
    return wide.na.fill("").select("row", *names, F.col("file_id").alias("File ID"))
