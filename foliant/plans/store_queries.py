"""Files written and read back, text comparison, landmarks, captures and likeness of regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import batchstats, matching, records, runs, search, spatial
from ..operators.scratch import shared_dir
from ..sources import readers, writers
from .alignment_queries import KEYS, REGIONS, changed_regions, regions
from .spatial_queries import BOXES, KEY, OVER, boxes
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


def _path(spark, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 5 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN c_name || ', "' || c_mktsegment || '"' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer""")
def csv_file_round_trip(spark, sf_dir):
    """Customers written as CSV files, with quotes, commas and blanks, and read back as text."""
    k = F.col("c_custkey")
    quoted = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 5 == 0, "").when(k % 3 == 0, quoted).otherwise(F.col("c_name")).alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("segment"))
    path = _path(spark, "csv")
    writers.write_csv(c, path)
    return readers.csv_table(spark, path)


@query("""SELECT event_id, event_type, CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id, NULL::VARCHAR AS error FROM events""")
def json_file_round_trip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = _path(spark, "json")
    writers.write_json(e.select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("user_id")), path)
    return readers.json_lines(spark, path, "event_id long, event_type string, user_id long").select("event_id", "event_type", "user_id", "error")


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT) END AS k FROM events""")
def safe_json_values(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    broken = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return e.withColumn("raw", broken).select("event_id", F.try_variant_get(readers.safe_json("raw"), "$.k", "int").alias("k"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS value FROM customer""")
def selected_values(spark, sf_dir):
    k = F.col("c_custkey")
    raw, cleaned = F.when(k % 5 != 0, F.col("c_name")), F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), records.selection_first(raw, cleaned).alias("value"))


@query(BOXES + """SELECT a.page, b.id AS box_id, count(*) AS hits FROM r a JOIN r b ON a.page = b.page AND a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) >= 0.5 * a.h GROUP BY 1, 2""")
def tokens_by_height(spark, sf_dir):
    b = boxes(spark, sf_dir)
    hits = spatial.tokens_in_boxes(b, b, KEY, "vertical", size=0.1)
    return hits.groupBy(F.col("a_page").alias("page"), F.col("b_id").alias("box_id")).agg(F.count("*").alias("hits"))


@query(BOXES + f"""SELECT a.page, b.id AS box_id, string_agg('t' || a.id, ' ' ORDER BY a.y + a.h / 2, a.x, a.id) AS text, count(*) AS hits FROM r a JOIN r b ON a.page = b.page AND {OVER} > 0 AND {OVER} >= 0.5 * a.w * a.h GROUP BY 1, 2""")
def box_texts(spark, sf_dir):
    """The text of every box: the tokens half of which it covers, by height, then from left to right."""
    b = boxes(spark, sf_dir)
    hits = spatial.tokens_in_boxes(b.withColumn("text", F.concat(F.lit("t"), F.col("id").cast("string"))), b, KEY, "area", 0.5, size=0.1)
    return spatial.box_text(hits, KEY)


@query(BOXES + """, p AS (SELECT a.page, b.id AS area_id, a.id AS token_id, a.x + a.w / 2 AS cx, a.y + a.h / 2 AS cy, sqrt((a.x + a.w / 2 - b.x - b.w / 2) ** 2 + (a.y + a.h / 2 - b.y - b.h / 2) ** 2) AS away
  FROM r a JOIN r b ON a.page = b.page AND b.id % 4 = 0 AND a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h),
q AS (SELECT *, row_number() OVER (PARTITION BY page, area_id ORDER BY away, token_id) AS rank FROM p)
SELECT q.page, q.area_id, q.token_id, q.rank::INT AS rank, round(q.cx - f.cx, 9) + 0.0 AS dx, round(q.cy - f.cy, 9) + 0.0 AS dy FROM q JOIN q f ON f.page = q.page AND f.area_id = q.area_id AND f.rank = 1 WHERE q.rank <= 8""")
def captured_areas(spark, sf_dir):
    b = boxes(spark, sf_dir)
    c = spatial.area_capture(b, b.where("id % 4 = 0"), KEY)
    return c.select("page", "area_id", "token_id", "rank", (F.round("dx", 9) + 0.0).alias("dx"), (F.round("dy", 9) + 0.0).alias("dy"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS e, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN 'a ' || p_name || ' b' WHEN 3 THEN replace(p_name, 'r', 'xx') ELSE substr(p_name, 1, 3) END AS a FROM part)
SELECT id, (e <> '' AND a <> '' AND (e = a OR (length(e) >= 4 AND contains(a, e)) OR (length(a) >= 4 AND contains(e, a)) OR (greatest(length(e), length(a)) > 3 AND levenshtein(e, a) <= 1))) AS fits FROM t""")
def compatible_texts(spark, sf_dir):
    k, e = F.col("p_partkey"), F.col("p_name")
    a = F.when(k % 5 == 0, e).when(k % 5 == 1, F.substr(e, F.lit(2))).when(k % 5 == 2, F.concat(F.lit("a "), e, F.lit(" b"))).when(k % 5 == 3, F.replace(e, F.lit("r"), F.lit("xx"))).otherwise(F.substring(e, 1, 3))
    return table(spark, sf_dir, "part").select(k.alias("id"), text.compatible(e, a).alias("fits"))


@query("""SELECT doc_id, trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents""")
def match_normalise(spark, sf_dir):
    """Documents as the search compares them, without accents."""
    return table(spark, sf_dir, "documents").select("doc_id", text.match_norm(F.col("text")).alias("norm"))


MARKS = """WITH m AS (SELECT p_partkey AS landmark_id, p_name AS text, (p_partkey * 7 % 100) / 100.0::DOUBLE AS lx, (p_partkey * 3 % 100) / 100.0::DOUBLE AS ly FROM part WHERE p_partkey % 40 = 0),
t AS (SELECT p_partkey % 20 AS doc_id, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', 'a') WHEN p_partkey % 7 = 0 THEN p_name || 'x' ELSE p_name END AS text, (p_partkey * 11 % 100) / 100.0::DOUBLE AS x, (p_partkey * 17 % 100) / 100.0::DOUBLE AS y FROM part),
p AS (SELECT landmark_id, doc_id, t.text, x, y, levenshtein(m.text, t.text) / greatest(length(m.text), length(t.text))::DOUBLE AS distance, sqrt((x - lx) ** 2 + (y - ly) ** 2) AS away FROM m, t)
SELECT landmark_id, doc_id, text, x, y, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY landmark_id, doc_id ORDER BY distance, away, x, y, text) AS rn FROM p WHERE distance <= 0.3) WHERE rn = 1"""


@query(MARKS)
def landmark_positions(spark, sf_dir):
    """Where each landmark stands in each document: the exact text nearest to its place, else the closest within three tenths of its length."""
    k, n = F.col("p_partkey"), F.col("p_name")
    part = table(spark, sf_dir, "part")
    marks = part.where(k % 40 == 0).select(k.alias("landmark_id"), n.alias("text"), (k * 7 % 100 / 100.0).alias("x"), (k * 3 % 100 / 100.0).alias("y"))
    said = F.when(k % 3 == 0, F.replace(n, F.lit("e"), F.lit("a"))).when(k % 7 == 0, F.concat(n, F.lit("x"))).otherwise(n)
    tokens = part.select((k % 20).alias("doc_id"), said.alias("text"), (k * 11 % 100 / 100.0).alias("x"), (k * 17 % 100 / 100.0).alias("y"))
    return matching.landmark_matches(marks, tokens).select("landmark_id", "doc_id", "text", "x", "y", F.round("distance", 9).alias("distance"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id)::INT AS rank FROM events""")
def ranked_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("score"), F.col("event_id").alias("order"))
    return search.ranked(e, ["user_id"]).select("user_id", "event_id", "rank")


@query("""WITH a AS (SELECT user_id AS session_id, event_id % 50 AS document_id, arg_max('s' || event_id, event_id) AS summary, max(event_id) AS seq FROM events WHERE event_type <> 'error' GROUP BY ALL),
g AS (SELECT user_id AS session_id, event_id % 50 AS document_id, max(event_id) AS gone FROM events WHERE event_type = 'error' GROUP BY ALL)
SELECT session_id, document_id, summary, seq FROM a LEFT JOIN g USING (session_id, document_id) WHERE gone IS NULL OR gone < seq""")
def session_documents(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (F.col("event_id") % 50).alias("document_id"), F.col("event_id").alias("seq"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("summary"), "event_type")
    return runs.session_documents(e.where("event_type <> 'error'"), e.where("event_type = 'error'")).select("session_id", "document_id", "summary", "seq")


def _features(df):
    k = F.col("id")
    kinds = F.when(k % 7 != 0, F.array(k % 3 / 3.0, k % 4 / 4.0, k % 5 / 5.0))
    return {"x": F.col("x") + F.col("w") / 2, "y": F.col("y") + F.col("h") / 2, "aspect": F.col("w") / F.col("h"), "rectangularity": k % 10 / 10.0, "solidity": k % 9 / 9.0, "neighbours": k % 6, "edge_weight": k % 8 / 8.0, "edge_types": kinds, "depth": k % 3, "type": k % 2, "confidence": k % 11 / 11.0, "density": k % 13 / 13.0}


_D = lambda c: f"abs(a.{c} - b.{c})"


@query(REGIONS + f""", fa AS (SELECT sheet, id, x + w / 2 AS x, y + h / 2 AS y, w, h, w / h AS aspect FROM r), fb AS (SELECT sheet, v AS doc, id, x + w / 2 AS x, y + h / 2 AS y, w, h, w / h AS aspect FROM rv),
g AS (SELECT *, (id % 10) / 10.0::DOUBLE AS rectangularity, (id % 9) / 9.0::DOUBLE AS solidity, id % 6 AS neighbours, (id % 8) / 8.0::DOUBLE AS edge_weight, CASE WHEN id % 7 <> 0 THEN [(id % 3) / 3.0::DOUBLE, (id % 4) / 4.0::DOUBLE, (id % 5) / 5.0::DOUBLE] END AS e, id % 3 AS depth, id % 2 AS type, (id % 11) / 11.0::DOUBLE AS confidence, (id % 13) / 13.0::DOUBLE AS density FROM (SELECT sheet, 0 AS doc, id, x, y, w, h, aspect FROM fa UNION ALL SELECT * FROM fb)),
s AS (SELECT a.sheet, b.doc, a.id AS a_id, b.id AS b_id,
  greatest(0, least(1, 1 - sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / 1.414)) AS position,
  greatest(0, least(1, 0.5 * greatest(0, least(1, 1 - abs(least(a.aspect, 10) - least(b.aspect, 10)) / greatest(least(a.aspect, 10), least(b.aspect, 10), 0.1))) + 0.25 * (1 - {_D('rectangularity')}) + 0.25 * (1 - {_D('solidity')}))) AS shape,
  greatest(0, least(1, 1 - abs(a.w * a.h - b.w * b.h) / greatest(a.w * a.h, b.w * b.h, 0.001))) AS size, greatest(0, least(1, 1 - {_D('w')} - {_D('h')})) AS dimension,
  greatest(0, least(1, 0.25 * (1 - {_D('neighbours')} / greatest(a.neighbours, b.neighbours, 1)) + 0.15 * (1 - {_D('edge_weight')}) + 0.35 * coalesce((3 - abs(a.e[1] - b.e[1]) - abs(a.e[2] - b.e[2]) - abs(a.e[3] - b.e[3])) / 3, 1.0) + 0.25 * (1 - {_D('depth')} / greatest(a.depth, b.depth, 1)))) AS topology,
  greatest(0, least(1, 0.5 * CASE WHEN a.type = b.type THEN 1.0 ELSE 0.3 END + 0.35 * (1 - {_D('confidence')}) + 0.15 * (1 - {_D('density')}))) AS semantic FROM g a JOIN g b ON a.sheet = b.sheet AND a.doc = 0 AND b.doc > 0)
SELECT sheet, doc, a_id, b_id FROM s WHERE round({' + '.join(f'{w} * {k}' for k, w in batchstats.SIMILARITY.items())}, 4) >= 0.8""")
def similar_regions(spark, sf_dir):
    """Regions of a sheet and of its versions that are alike by at least 0.8."""
    a = regions(spark, sf_dir)
    b = changed_regions(a).withColumnRenamed("v", "doc")
    names = ["id", "w", "h"]
    full = lambda df, *more: df.select("sheet", *more, *names, *(e.alias(n) for n, e in _features(df).items()))
    return batchstats.similar_regions(full(a), full(b, "doc"), KEYS, 0.8).select("sheet", "doc", "a_id", "b_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '2024-0' || (1 + event_id % 9) || '-1' || (event_id % 10) WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN 'a b ' || event_id ELSE ' x  ' || event_id END AS cleaned
FROM (SELECT event_id FROM events) t""".replace("ELSE ' x  ' || event_id", "ELSE 'x  ' || event_id"))
def cleaned_by_hint(spark, sf_dir):
    """Values cleaned as dates, numbers or text, by the type or the key of their field."""
    e = F.col("event_id")
    n = e.cast("string")
    date = F.concat(F.lit("2024/0"), (1 + e % 9).cast("string"), F.lit("/1"), (e % 10).cast("string"))
    value = F.when(e % 4 == 0, date).when(e % 4 == 1, F.concat(F.lit("$ "), n, F.lit(" "))).when(e % 4 == 2, F.concat(F.lit(" a   b "), n)).otherwise(F.concat(F.lit(" x  "), n))
    key = F.when(e % 4 == 0, "invoice_date").when(e % 4 == 1, "total").otherwise("note")
    return table(spark, sf_dir, "events").select("event_id", numeric.cleaned_by_hint(value, F.when(e % 4 == 2, "text_only"), key).alias("cleaned"))
