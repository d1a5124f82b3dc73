"""Orders as field entries, compiled to records and sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records
from .tabular_queries import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def entries(spark, sf_dir) -> DataFrame:
    """Field entries of every order: totals, and an entry of a repeated key for every line item."""
    o, item = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    money = lambda c: F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    tail = F.when(F.col("o_orderkey") % 2 == 0, 1000).otherwise(2000)
    cells = {"subtotal_amount": money(cents), "tax_amount": F.lit("10.00"), "invoice_total": money(cents + tail), "invoice_number": F.concat(F.lit(" N "), F.col("o_orderkey").cast("string"))}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("field_key"), v.alias("value")) for k, v in cells.items())))
    heads = o.select(F.col("o_orderkey").alias("file_id"), F.lit(0).alias("seq"), each.alias("c")).select("file_id", "seq", "c.*", F.lit(0.9).alias("confidence"))
    lines = item.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("int").alias("seq"), F.concat(F.lit("k"), (F.col("l_linenumber") % 3).cast("string")).alias("field_key"), F.col("l_partkey").cast("string").alias("value"), F.lit(0.5).alias("confidence"))
    return heads.unionByName(lines).withColumn("raw", F.col("value"))


EXPECTED = ["invoice_number", "k0", "k2", "store_name"]
ENTRIES = """WITH o AS (SELECT o_orderkey AS file_id, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c, CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 2000 END AS t FROM orders),
e AS (
  SELECT file_id, 0 AS seq, 'subtotal_amount' AS field_key, (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS value, 0.9::DOUBLE AS confidence FROM o
  UNION ALL SELECT file_id, 0, 'tax_amount', '10.00', 0.9 FROM o
  UNION ALL SELECT file_id, 0, 'invoice_total', ((c + t) // 100) || '.' || lpad(((c + t) % 100)::VARCHAR, 2, '0'), 0.9 FROM o
  UNION ALL SELECT file_id, 0, 'invoice_number', ' N ' || file_id, 0.9 FROM o
  UNION ALL SELECT l_orderkey, l_linenumber, 'k' || (l_linenumber % 3), l_partkey::VARCHAR, 0.5 FROM lineitem),
f0 AS (SELECT file_id, field_key, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file_id, field_key ORDER BY seq DESC, value DESC) AS n FROM e WHERE field_key <> 'k1') WHERE n = 1),
f AS (SELECT * FROM f0 UNION ALL SELECT file_id, k, '', 0.0 FROM (SELECT DISTINCT file_id FROM e), (SELECT unnest(['invoice_number', 'k0', 'k2', 'store_name']) AS k)
      WHERE NOT EXISTS (SELECT 1 FROM f0 WHERE f0.file_id = e.file_id AND f0.field_key = k))
"""


@query(ENTRIES.replace("(SELECT DISTINCT file_id FROM e),", "(SELECT DISTINCT file_id FROM e) e,") + "SELECT * FROM f")
def field_entries(spark, sf_dir):
    return records.field_rows(entries(spark, sf_dir), EXPECTED, ["k1"]).select("file_id", "field_key", "value", "confidence")


@query("""WITH o AS (SELECT o_orderkey AS file_id, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS c FROM orders),
i AS (SELECT l_orderkey AS file_id, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS u, l_linenumber AS ln FROM lineitem),
s AS (SELECT file_id, sum(CASE WHEN ln % 4 = 0 THEN 0 ELSE q * u END) AS cents, bool_and(ln % 4 <> 0) AS known, count(*) AS n FROM i GROUP BY file_id),
r AS (SELECT file_id, coalesce(n, 0) AS items, coalesce(cents, 0) AS cents, coalesce(known, true) AND abs(coalesce(cents, 0) - c) > 2 AS off, c FROM o LEFT JOIN s USING (file_id))
SELECT file_id, items, round(cents / 100.0::DOUBLE, 2) AS line_sum, CASE WHEN off THEN 'line_totals_vs_subtotal' ELSE '' END AS warnings, 'N ' || file_id AS number,
  round(CASE WHEN file_id % 2 = 0 THEN 0.95 ELSE 0.7 END * CASE WHEN off THEN 0.8 ELSE 1 END, 9)::DOUBLE AS subtotal_confidence, CASE WHEN file_id % 2 = 0 THEN 0.95 ELSE 0.7 END::DOUBLE AS total_confidence FROM r""")
def compiled_records(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    unit = F.floor(F.col("l_extendedprice") + 0.5).cast("long")
    money = F.concat(F.floor(unit / 100).cast("string"), F.lit("."), F.lpad((unit % 100).cast("string"), 2, "0"))
    quantity = F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.col("l_quantity").cast("long").cast("string"))
    cells = {"sku": F.lit(""), "description": F.lit("d"), "quantity": quantity, "unit_price": money, "amount": F.lit(""), "line_no": F.lit(""), "row_number": F.lit(None).cast("int"), "missing": F.lit(None).cast("map<string,string>")}
    lines = item.groupBy(F.col("l_orderkey").alias("file_id")).agg(F.collect_list(F.struct(*(v.alias(k) for k, v in cells.items()))).alias("line_items"))
    own = entries(spark, sf_dir).where("field_key not like 'k_'")
    r = records.compiled(records.field_map(own, ["invoice_number"]), lines)
    sure = lambda k: F.round(F.col("fields")[k]["confidence"], 9)
    return r.select("file_id", F.size("line_items").alias("items"), F.round("line_sum", 2).alias("line_sum"), F.array_join("warnings", ",").alias("warnings"), F.col("invoice.number").alias("number"), sure("subtotal_amount").alias("subtotal_confidence"), sure("invoice_total").alias("total_confidence"))


@query("""WITH t AS (SELECT 'zone ' || (c_nationkey % 3) AS sheet, count(*) AS rows FROM customer GROUP BY 1) SELECT * FROM t
UNION ALL SELECT 'root', count(*) FROM customer""")
def table_sheets(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    fields = F.create_map(F.lit("store_name"), F.col("c_name"))
    none = F.array().cast(f"array<{records.tabular.ITEM}>")
    rows = c.select(F.col("c_custkey").alias("doc_seq"), F.col("c_custkey").cast("string").alias("file_id"), fields.alias("fields"), F.lit(None).cast("map<string,string>").alias("totals"), none.alias("line_items"))
    nested = F.array(F.create_map(F.lit("bin"), F.col("c_phone"))) if "c_phone" in c.columns else F.array(F.create_map(F.lit("bin"), F.col("c_name")))
    areas = c.select(F.col("c_custkey").cast("string").alias("file_id"), F.lit(None).cast("string").alias("area_id"), F.concat(F.lit("Z"), (F.col("c_nationkey") % 3).cast("string")).alias("area_name"), F.lit("").alias("row_mode"), F.create_map(F.lit("store"), F.col("c_name")).alias("fields"), nested.alias("rows"))
    config = {"custom": True, "static_fields": [{"key": "store_name", "label": "Store"}, {"key": "bin", "is_area": True}], "areas": [{"id": f"z{k}", "name": f"zone {k}", "type": "rows"} for k in range(3)]}
    found = records.sheets(rows, areas, config)
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("sheet"), "rows") for name, df in found.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out
