"""Invoices: orders as records, line items with blanks by rule, flattened and checked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numeric, text
from ..operators import dedupe, scratch, series, tabular
from ..sources import readers, writers

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoice_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_seq, file_id, fields, totals, line_items of every order that has items."""
    item, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    unit = F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity") + 0.5).cast("long")
    money = lambda c: F.concat((F.floor(c / 100)).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))
    n = F.col("l_orderkey") + F.col("l_linenumber")
    qty = F.col("l_quantity").cast("long")
    blank = lambda cond, c: F.when(cond, "").otherwise(c)
    cells = F.struct(
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"),
        blank(F.col("l_linenumber") == 4, F.concat(F.lit(" SKU-"), F.col("l_partkey").cast("string"))).alias("sku"),
        blank(F.col("l_linenumber") == 5, F.replace(F.col("p_name"), F.lit(" "), F.lit("  "))).alias("description"),
        blank((n % 5 == 0) | (F.col("l_linenumber") == 3), qty.cast("string")).alias("quantity"),
        blank((n % 7 == 0) | (F.col("l_linenumber") == 3), F.concat(F.lit("$"), money(unit))).alias("unit_price"),
        blank((n % 3 == 0) | (F.col("l_linenumber") == 3), money(unit * qty)).alias("amount"),
    )
    lines = item.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(cells)).alias("cells"))
    flagged = lambda i: F.when(i % 6 == 5, F.create_map(F.lit("line_no"), F.lit("true")))
    items = F.transform("cells", lambda c, i: F.struct(c["sku"].alias("sku"), c["description"].alias("description"), c["quantity"].alias("quantity"), c["unit_price"].alias("unit_price"), c["amount"].alias("amount"), F.lit("").alias("line_no"), (i + 1).alias("row_number"), flagged(i).alias("missing")))
    head = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    field = {"store_name": F.concat(F.lit("Store  "), F.col("c_nationkey").cast("string")), "invoice_number": F.col("o_orderkey").cast("string"), "invoice_date": F.date_format("o_orderdate", "yyyy-MM-dd"), "customer_name": F.concat(F.lit(" "), F.col("c_name")), "subtotal_amount": money(F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")), "payment_status": F.col("o_orderstatus")}
    fields = F.create_map(*(x for k, v in field.items() for x in (F.lit(k), v)))
    joined = head.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select(F.col("o_orderkey").alias("doc_seq"), F.concat(F.lit("file-"), F.col("o_orderkey").cast("string")).alias("file_id"), fields.alias("fields"), F.create_map(F.lit("total"), F.lit("")).alias("totals"), items.alias("line_items"))


BASE = """
WITH c0 AS (
  SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS idx,
         l_linenumber AS ln, l_orderkey + l_linenumber AS n, l_partkey, p_name, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT) AS u
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey)),
c AS (
  SELECT doc, idx, idx + 1 AS rn,
    CASE WHEN ln = 4 THEN '' ELSE 'SKU-' || l_partkey END AS sku, CASE WHEN ln = 5 THEN '' ELSE p_name END AS description,
    CASE WHEN n % 5 = 0 OR ln = 3 THEN NULL ELSE q * 100 END AS q, CASE WHEN n % 7 = 0 OR ln = 3 THEN NULL ELSE u END AS u,
    CASE WHEN n % 3 = 0 OR ln = 3 THEN NULL ELSE u * q END AS a
  FROM c0),
z0 AS (SELECT *, (q IS NOT NULL OR u IS NOT NULL OR a IS NOT NULL) AS num FROM c),
z1 AS (SELECT *, coalesce(lag(num) OVER w, false) OR coalesce(lead(num) OVER w, false) AS beside FROM z0 WINDOW w AS (PARTITION BY doc ORDER BY idx)),
z AS (SELECT *, description <> '' AND lower(description) NOT IN ('item', 'description', 'qty', 'quantity', 'unit', 'price', 'amount', 'total') AND length(description) > 2 AND NOT num AND beside AS zero FROM z1),
y AS (SELECT doc, idx, rn, sku, description, zero, CASE WHEN zero AND q IS NULL THEN 100 ELSE q END AS q, CASE WHEN zero AND u IS NULL THEN 0 ELSE u END AS u, CASE WHEN zero AND a IS NULL THEN 0 ELSE a END AS a FROM z),
k AS (SELECT doc, count(*) AS rows_, count(*) FILTER (WHERE sku <> '') AS ns, count(*) FILTER (WHERE description <> '') AS nd, count(q) AS nq, count(u) AS nu, count(a) AS na FROM y GROUP BY doc),
k1 AS (SELECT doc, v, count(*) AS f FROM (SELECT doc, unnest([ns, nd, nq]) AS v FROM k) WHERE v > 0 GROUP BY doc, v),
k2 AS (SELECT doc, v FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY f DESC, v) AS r FROM k1) WHERE r = 1),
m AS (SELECT k.doc, rows_, ns, nd, nq, nu, na, least(coalesce(v, rows_), rows_) AS majority FROM k LEFT JOIN k2 USING (doc)),
s AS (SELECT y.*, row_number() OVER (PARTITION BY doc ORDER BY CAST(sku <> '' AS INT) + CAST(description <> '' AS INT) + CAST(q IS NOT NULL AS INT) + CAST(u IS NOT NULL AS INT) + CAST(a IS NOT NULL AS INT) DESC, rn, idx) AS place, majority FROM y JOIN m USING (doc)),
i0 AS (SELECT doc, idx, rn, sku, description, zero, q, u, a, floor(a / nullif(u, 0)::DOUBLE + 0.5) AS whole, a / nullif(u, 0)::DOUBLE AS ratio FROM s WHERE place <= majority),
i1 AS (SELECT *, CASE WHEN q IS NULL AND abs(ratio - whole) < 0.01 THEN CAST(whole * 100 AS BIGINT) ELSE q END AS q1 FROM i0),
i AS (SELECT doc, idx, rn, sku, description, zero, u, q1 IS NULL AND a IS NULL AND u IS NOT NULL AS assumed,
        CASE WHEN q1 IS NULL AND a IS NULL AND u IS NOT NULL THEN 100 ELSE q1 END AS q,
        CASE WHEN a IS NOT NULL THEN a WHEN q1 IS NULL AND u IS NOT NULL THEN u WHEN q1 IS NOT NULL AND u IS NOT NULL THEN q1 * u // 100 END AS a FROM i1),
l AS (SELECT *, description <> '' AND (q IS NOT NULL OR u IS NOT NULL OR a IS NOT NULL) AS usable FROM i),
ln AS (SELECT *, CASE WHEN usable THEN CAST(sum(CAST(usable AS INT)) OVER (ORDER BY doc, idx) AS VARCHAR) ELSE '' END AS line_no FROM l)
"""
MONEY = lambda c: f"coalesce(({c} // 100)::VARCHAR || '.' || lpad(({c} % 100)::VARCHAR, 2, '0'), '')"


@query(BASE + f"""
SELECT 'Store ' || c_nationkey AS "Store / Business Name", '' AS "Department / Division", o_orderkey::VARCHAR AS "Invoice #", strftime(o_orderdate, '%Y-%m-%d') AS "Invoice Date",
  '' AS "Salesperson", c_name AS "Customer Name", '' AS "Customer Address", sku AS "Item Code (SKU)", description AS "Item Description", {MONEY('q')} AS "Quantity", {MONEY('u')} AS "Unit Price",
  {MONEY('a')} AS "Line Total", {MONEY('CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)')} AS "Subtotal", '' AS "Discount", '' AS "Tax Amount", '' AS "Invoice Total", '' AS "Payment Method", o_orderstatus AS "Payment Status",
  CASE WHEN line_no = '' THEN rn::VARCHAR ELSE line_no END AS "Line No", 'file-' || o_orderkey AS "File ID", doc AS doc_seq, idx::INT AS idx
FROM ln JOIN orders ON o_orderkey = doc JOIN customer ON c_custkey = o_custkey""")
def flatten_invoices(spark, sf_dir):
    return tabular.flatten(invoice_records(spark, sf_dir), fallback=False)


@query(BASE + "SELECT doc AS doc_seq, rows_ AS original_rows, majority, ns AS n_sku, nd AS n_description, nq AS n_quantity, nu AS n_unit_price, na AS n_amount FROM m")
def majority_counts(spark, sf_dir):
    return tabular.majority(tabular.mark_zero_rows(tabular.items(invoice_records(spark, sf_dir)))).select("doc_seq", "original_rows", F.col("majority").cast("long").alias("majority"), *(f"n_{c}" for c in tabular.DYNAMIC))


@query(BASE + f"SELECT doc AS doc_seq, idx::INT AS idx, sku, description, {MONEY('q')} AS quantity, {MONEY('u')} AS unit_price, {MONEY('a')} AS amount, zero AS synthetic_zero FROM y")
def synthetic_zero_rows(spark, sf_dir):
    return tabular.mark_zero_rows(tabular.items(invoice_records(spark, sf_dir))).select("doc_seq", "idx", "sku", "description", "quantity", "unit_price", "amount", "synthetic_zero")


@query(BASE + f"SELECT doc AS doc_seq, idx::INT AS idx, {MONEY('q')} AS quantity, {MONEY('u')} AS unit_price, {MONEY('a')} AS amount, assumed AS assumed_quantity, line_no, usable AS virtual_line_no FROM ln")
def inferred_numbered_lines(spark, sf_dir):
    return tabular.selected_items(invoice_records(spark, sf_dir)).select("doc_seq", "idx", "quantity", "unit_price", "amount", "assumed_quantity", "line_no", "virtual_line_no")


@query(BASE + """, f AS (SELECT doc, rn AS row, unnest(['sku', 'quantity', 'unit_price', 'line_no']) AS col, unnest([sku = '', q IS NULL, u IS NULL, line_no = '']) AS blank, unnest([false, false, false, idx % 6 = 5]) AS flagged FROM ln)
SELECT doc AS doc_seq, row::INT AS row, col AS "column", CASE WHEN blank AND flagged THEN 'empty,flagged' WHEN blank THEN 'empty' ELSE 'flagged' END AS reasons, flagged FROM f WHERE blank OR flagged""")
def missing_cells(spark, sf_dir):
    found = tabular.missing_reasons(tabular.selected_items(invoice_records(spark, sf_dir)))
    return found.select("doc_seq", "row", "column", F.array_join("reasons", ",").alias("reasons"), "flagged")


@query(BASE + """, f AS (SELECT rn AS row, unnest(['sku', 'quantity', 'unit_price', 'line_no']) AS col, unnest([sku = '', q IS NULL, u IS NULL, line_no = '' OR idx % 6 = 5]) AS bad FROM ln)
SELECT col AS "column", string_agg(DISTINCT row::VARCHAR, ',' ORDER BY row::VARCHAR) AS rows FROM f WHERE bad GROUP BY col""")
def missing_summary(spark, sf_dir):
    found = tabular.missing_summary(tabular.selected_items(invoice_records(spark, sf_dir)))
    return found.select("column", F.array_join(F.array_sort(F.transform("rows", lambda r: r.cast("string"))), ",").alias("rows"))


@query(BASE + """SELECT count(*) FILTER (WHERE sku <> '') AS sku_count, count(q) AS qty_count, count(u) AS price_count, count(*) FILTER (WHERE line_no <> '') AS line_no_count,
  count(*) FILTER (WHERE usable) AS usable_row_count, count(*) FILTER (WHERE zero) AS synthetic_zero_count, count(*) FILTER (WHERE u = 0 AND a = 0) AS zero_price_row_count FROM ln""")
def integrity_counts(spark, sf_dir):
    return tabular.integrity(tabular.selected_items(invoice_records(spark, sf_dir)))


@query("""WITH p AS (SELECT DISTINCT o_orderkey, c_nationkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey)),
i AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS idx, CASE WHEN l_linenumber = 5 THEN '' ELSE p_name END AS d FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT o_orderkey AS doc_seq, idx::INT AS idx, 'Store ' || c_nationkey AS "Store", c_name AS "Customer", d AS "Item", 'file-' || o_orderkey AS "File ID" FROM p JOIN i ON l_orderkey = o_orderkey""")
def flatten_custom_columns(spark, sf_dir):
    return tabular.flatten_custom(invoice_records(spark, sf_dir), {"Store": "store_name", "Customer": "customer_name"}, {"Item": "description"})


@query(BASE + """, t AS (SELECT doc, sum(a) AS s, bool_and(a IS NOT NULL) AS known FROM c GROUP BY doc)
SELECT 'file-' || doc AS file_id, s / 100.0::DOUBLE AS line_sum, floor(o_totalprice * 100 + 0.5) / 100 AS subtotal,
  CASE WHEN known THEN abs(s / 100.0::DOUBLE - floor(o_totalprice * 100 + 0.5) / 100) <= 0.02 END AS consistent,
  CASE WHEN known AND abs(s / 100.0::DOUBLE - floor(o_totalprice * 100 + 0.5) / 100) > 0.02 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS confidence
FROM t JOIN orders ON o_orderkey = doc""")
def line_sum_check(spark, sf_dir):
    return tabular.totals_check(invoice_records(spark, sf_dir))


@query(f"""SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey AS part, {MONEY('CAST(l_quantity * 100 AS BIGINT)')} AS quantity,
  CASE WHEN l_extendedprice IS NULL THEN '' ELSE {MONEY('CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)')} END AS clean, -floor(l_extendedprice * 100 + 0.5) / 100 AS parsed FROM lineitem""")
def numeric_cleaning(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), "l_quantity", numeric.fixed2(F.col("l_extendedprice")).alias("e"))
    return t.select("doc", "n", "part", numeric.clean_numeric(F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(" pcs"))).alias("quantity"), numeric.clean_numeric(F.concat(F.lit("$ "), F.col("e"))).alias("clean"), numeric.parse_numeric(F.concat(F.lit("($"), F.col("e"), F.lit(")"))).alias("parsed"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) AS iso, CAST(o_orderdate AS DATE) AS us,
  CASE WHEN day(o_orderdate) > 12 THEN CAST(o_orderdate AS DATE) ELSE make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) END AS eu,
  strftime(o_orderdate, '%Y-%m-%d') AS named FROM orders""")
def event_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shown = lambda p: F.date_format("o_orderdate", p)
    return o.select("o_orderkey", dates.event_date(shown("yyyy-MM-dd")).alias("iso"), dates.event_date(shown("M/d/yyyy")).alias("us"), dates.event_date(shown("d-M-yyyy")).alias("eu"), dates.normal_date(shown("MMM d, yyyy")).alias("named"))


EVENTS = """WITH e0 AS (SELECT event_id, user_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS d, event_type AS t, floor(value * 100 + 0.5) / 100 AS v,
  CASE WHEN event_id % 13 = 0 THEN '__row_' || event_id ELSE 'doc-' || (event_id % 4000) END AS doc_id FROM events),
last_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY event_id DESC) AS r FROM e0) WHERE r = 1),
ev AS (SELECT d AS event_date, CASE WHEN t = 'purchase' THEN v END AS money_in, CASE WHEN t = 'click' THEN -v END AS money_out, v AS gross_or_total, CASE WHEN event_id % 2 = 0 THEN v * 1 END AS ytd_total, doc_id FROM last_ WHERE d IS NOT NULL)
"""


def event_rows(spark, sf_dir) -> DataFrame:
    """The events table as text rows of a money series under aliased headers."""
    e = table(spark, sf_dir, "events")
    v = numeric.fixed2(F.col("value"))
    day = F.when(F.col("event_id") % 17 == 0, "bad-date").when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    kind = lambda k, c: F.when(F.col("event_type") == k, c).otherwise("")
    return e.select(F.col("event_id").alias("row_index"), day.alias("Event Date"), kind("purchase", F.concat(F.lit("$"), v)).alias("Money In"), kind("click", F.concat(F.lit("("), v, F.lit(")"))).alias("Money Out"), v.alias("Total Amount"), F.when(F.col("event_id") % 2 == 0, v).otherwise("n/a").alias("YTD Total"), F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.concat(F.lit("doc-"), (F.col("event_id") % 4000).cast("string"))).alias("File ID"))


@query(EVENTS + "SELECT * FROM ev")
def money_events(spark, sf_dir):
    return series.events(event_rows(spark, sf_dir))


@query(EVENTS + """SELECT series, x, y, doc_id FROM (SELECT unnest(['money_in', 'money_out', 'gross_or_total', 'ytd_total']) AS series, event_date AS x, unnest([money_in, money_out, gross_or_total, ytd_total]) AS y, doc_id FROM ev) WHERE y IS NOT NULL""")
def series_long_form(spark, sf_dir):
    return series.datasets(series.events(event_rows(spark, sf_dir)))


@query(EVENTS + "SELECT (SELECT count(*) FROM events) AS rows_read, count(d) AS rows_used, count(*) - count(d) AS rows_excluded, (SELECT count(*) FROM events) - count(*) AS collisions FROM last_")
def series_summary(spark, sf_dir):
    return series.summary(event_rows(spark, sf_dir))


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY floor(value / 10) DESC, ts DESC, event_id) AS r FROM events) WHERE r = 1""")
def best_confidence_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.floor(F.col("value") / 10).cast("double").alias("confidence"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return dedupe.best_confidence(e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("""SELECT low, high, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY low, high ORDER BY event_id DESC) AS r FROM
  (SELECT *, least(user_id, event_id % 50) AS low, greatest(user_id, event_id % 50) AS high FROM events)) WHERE r = 1""")
def latest_constraint_per_pair(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("other", F.col("event_id") % 50)
    return dedupe.latest_pairs(e, "user_id", "other", "event_id").select("low", "high", "event_id", "event_type")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 500")
def bounded_log(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return dedupe.keep_last(e, 500, "o", ("event_type",)).select("event_type", "event_id")


@query("""SELECT c_custkey AS key, c_name AS name, 'local' AS origin FROM customer WHERE c_custkey % 3 <> 0 UNION ALL
SELECT o_custkey, 'order ' || min(o_orderkey), 'cloud' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) GROUP BY o_custkey""")
def merge_local_wins(spark, sf_dir):
    local = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("local").alias("origin"))
    cloud = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.concat(F.lit("order "), F.min("o_orderkey").cast("string")).alias("name")).withColumn("origin", F.lit("cloud"))
    return dedupe.local_wins(local, cloud, ["key"])


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 4 <> 0 THEN c_name ELSE 'cached' END AS value, CASE WHEN c_custkey % 4 <> 0 THEN 'remote' ELSE 'cache' END AS origin FROM customer WHERE c_custkey % 4 <> 0 OR c_custkey % 2 = 0""")
def read_through_cache(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    remote = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"), F.when(F.col("c_custkey") % 4 == 0, "deleted").otherwise("active").alias("status"))
    cache = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.lit("cached").alias("value"))
    return dedupe.read_through(remote, cache, ["key"], "value")


@query("""SELECT o_orderkey AS key, o_orderstatus AS status, 'p' || (o_orderkey % 7) AS note, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS version FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 'X', 'p' || (o_orderkey % 7), 2 FROM orders WHERE o_orderkey % 5 = 0""")
def merge_documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("p"), (F.col("o_orderkey") % 7).cast("string")).alias("note"), F.lit(1).alias("version"))
    new = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("key"), F.lit("X").alias("status"), F.lit(2).alias("version"))
    return writers.merged(old, new, ["key"])


@query("""SELECT doc_id, CASE WHEN n <= 4000 THEN 1 ELSE CAST(ceil(n / 2000.0) AS INT) END AS chunks, md5(text) AS whole FROM (SELECT doc_id, text, strlen(text) AS b, length(text) AS n FROM documents) WHERE b <= 4000
UNION ALL SELECT doc_id, CAST(ceil(length(text) / 2000.0) AS INT), md5(text) FROM documents WHERE strlen(text) > 4000""")
def chunked_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = readers.chunks(d, "doc_id", "text", 2000, 4000)
    n = pieces.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunks"))
    return readers.reassembled(pieces, "doc_id").select("doc_id", F.md5("value").alias("whole")).join(n, "doc_id")


@query("""SELECT s_suppkey AS id, 'area-' || s_nationkey AS resolved_id, n_name AS resolved_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 < 2
UNION ALL SELECT s_suppkey, 'other', 'other' FROM supplier WHERE s_suppkey % 3 = 2""")
def area_identity(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq"), F.concat(F.lit("area-"), F.col("n_nationkey").cast("string")).alias("area_id"), F.col("n_name").alias("area_name"), F.array(F.concat(F.lit("Alias "), F.col("n_nationkey").cast("string"))).alias("aliases"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("AREA-"), F.col("s_nationkey").cast("string"))).when(F.col("s_suppkey") % 3 == 2, "other").alias("area_id"), F.when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit(" alias  "), F.col("s_nationkey").cast("string"))).when(F.col("s_suppkey") % 3 == 2, "other").alias("area_name"))
    return tabular.resolve_areas(s, tabular.area_registry(n)).select("id", "resolved_id", "resolved_name")


@query("""SELECT (s_suppkey % 2)::INT AS row, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal::VARCHAR ELSE '' END AS balance, s_name AS name, 'f' || (s_suppkey // 2) AS "File ID" FROM supplier""")
def area_sheet(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("file_id", F.concat(F.lit("f"), F.floor(F.col("s_suppkey") / 2).cast("string")))
    cell = F.when(F.col("s_suppkey") % 2 == 0, F.create_map(F.lit("name"), F.col("s_name"), F.lit("balance"), F.col("s_acctbal").cast("string"))).otherwise(F.create_map(F.lit("name"), F.col("s_name")))
    entry = F.struct(F.col("s_suppkey").alias("k"), F.map_entries(cell).alias("c"))
    rows = s.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.map_from_entries(x["c"])).alias("rows"))
    rows = rows.select("file_id", F.lit("a").alias("resolved_id"), F.lit("table").alias("row_mode"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("fields"), "rows")
    return tabular.sheet(tabular.area_cells(rows), "a")


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%,%' OR p_name LIKE '%"%' THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END || ',' || '"' || p_brand || ', ' || '""' || p_type || '""' || '"' || ',' AS line FROM part""")
def csv_export_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')).alias("b"), F.lit(None).cast("string").alias("c"))
    return p.select("p_partkey", F.concat_ws(",", *(writers.csv_cell(F.col(c)) for c in "abc")).alias("line"))


@query("SELECT p_partkey::VARCHAR AS id, p_name AS name, p_brand || ', \"' || p_type || '\"' AS note FROM part")
def csv_line_parsing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("a"), F.col("p_name").alias("b"), F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')).alias("c"))
    return readers.csv_lines(writers.csv_rows(p, ["a", "b", "c"]).withColumnRenamed("line", "value"), ["id", "name", "note"])


@query("""SELECT c_custkey, 'u' || (c_custkey % 10) AS "user", c_mktsegment AS doc_type, CASE WHEN c_custkey % 2 = 0 THEN 'w' || c_nationkey END AS wizard_id, NULL::VARCHAR AS geometry_id FROM customer WHERE c_custkey % 10 = 3 OR c_custkey % 10 = 4""")
def key_value_scan(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.concat_ws(".", F.lit("wiz.profile"), F.concat(F.lit("u"), (F.col("c_custkey") % 10).cast("string")), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("w"), F.col("c_nationkey").cast("string"))))
    rows = c.select(key.alias("key"), F.col("c_custkey").alias("value"))
    both = readers.key_values(rows, "u3").unionByName(readers.key_values(rows, "u4"))
    return both.select(F.col("value").alias("c_custkey"), "user", "doc_type", "wizard_id", "geometry_id")


@query("""SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id END AS event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) END AS k,
  CASE WHEN event_id % 10 = 0 THEN '{"event_id": ' || event_id END AS error, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) AS line_no FROM events""")
def json_with_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "props", F.floor(F.col("event_id") / 1000).alias("file"))
    broken = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"))
    line = F.when(F.col("event_id") % 10 == 0, broken).otherwise(F.concat(broken, F.lit(', "props": '), F.col("props"), F.lit("}")))
    path = f"{scratch.shared_dir(spark)}/foliant/lines-{uuid.uuid4().hex}"
    e.withColumn("value", line).repartition("file").sortWithinPartitions("file", "event_id").select("value", "file").write.partitionBy("file").text(path)
    found = readers.json_lines(spark, path, "event_id long, props struct<k:int>")
    return found.select("event_id", "props.k", "error", "line_no")


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM documents""")
def keyword_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.keyword_norm(F.col("text")).alias("norm"))


@query("""WITH w AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
s AS (SELECT *, levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE AS d, string_split(x, ' ') AS xs, string_split(y, ' ') AS ys FROM w)
SELECT a, b, d AS edit_ratio, 1 - d AS similarity, len(list_intersect(list_distinct(xs), list_distinct(ys))) / len(list_distinct(list_concat(xs, ys)))::DOUBLE AS jaccard,
  CASE WHEN x = y THEN 3.0 WHEN starts_with(x, y) THEN 2.0 WHEN contains(x, y) THEN 1.0 WHEN contains(y, x) THEN 0.5 ELSE 0.0 END::DOUBLE AS match_score FROM s""")
def name_similarity(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x, y = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x")), p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y"))
    j = x.join(y, F.col("b") == F.col("a") + 1)
    return j.select("a", "b", text.edit_ratio(F.col("x"), F.col("y")).alias("edit_ratio"), text.similarity(F.col("x"), F.col("y")).alias("similarity"), text.jaccard(F.col("x"), F.col("y")).alias("jaccard"), text.token_match_score(F.col("x"), F.col("y")).alias("match_score"))


@query("""SELECT c_custkey, translate(c_name, 'OIlST', '01157') AS as_number, replace(replace(c_name, '#', ''), ' ', '') AS slots, lower(c_mktsegment) AS header FROM customer""")
def glyph_maps(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", text.type_fixed(F.col("c_name"), F.lit("numeric_only")).alias("as_number"), text.strip_alnum(F.col("c_name")).alias("slots"), text.header_norm(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("!"))).alias("header"))
