"""Annotations, selections and stores: customers as boxes that people drew, events as entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import annotations
from .alignment_queries import KEYS, REGIONS, regions
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


DRAWN = REGIONS + """, d AS (SELECT sheet AS record_id, id, ['label', 'field_value', 'visual_region', 'structural_section', 'note'][id % 5 + 1] AS category, x, y, w, h FROM r)
"""


def drawn(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("label", "field_value", "visual_region", "structural_section", "note")))
    return regions(spark, sf_dir).select(F.col("sheet").alias("record_id"), "id", F.get(kinds, F.col("id") % 5).alias("category"), "x", "y", "w", "h")


@query(DRAWN + """SELECT count(DISTINCT record_id) AS records, count(*) AS boxes, count(*) FILTER (WHERE category = 'label') AS labels, count(*) FILTER (WHERE category = 'note') AS notes, min(record_id) AS oldest, max(record_id) AS newest FROM d""")
def store_statistics(spark, sf_dir):
    d = drawn(spark, sf_dir)
    s = annotations.store_statistics(d, d.select("record_id", F.col("record_id").alias("ts")).distinct())
    return s.select("records", "boxes", F.col("categories")["label"].alias("labels"), F.col("categories")["note"].alias("notes"), "oldest", "newest")


@query(DRAWN + """, n AS (SELECT sum(least(l, v)) AS pairs FROM (SELECT record_id, count(*) FILTER (WHERE category = 'label') AS l, count(*) FILTER (WHERE category = 'field_value') AS v FROM d GROUP BY 1)),
p AS (SELECT v.record_id, v.id, max(greatest(0, 1 - sqrt((v.x + v.w / 2 - l.x - l.w / 2) ** 2 + (v.y + v.h / 2 - l.y - l.h / 2) ** 2))) AS near FROM d v LEFT JOIN d l ON l.record_id = v.record_id AND l.category = 'label' WHERE v.category = 'field_value' GROUP BY ALL),
q AS (SELECT v.record_id, v.id, greatest(0, least(v.x + v.w, g.x + g.w) - greatest(v.x, g.x)) * greatest(0, least(v.y + v.h, g.y + g.h) - greatest(v.y, g.y)) AS shared, v.w * v.h + g.w * g.h AS total FROM d v JOIN d g ON g.record_id = v.record_id AND g.category IN ('visual_region', 'structural_section') WHERE v.category = 'field_value'),
e AS (SELECT record_id, id, max(shared / (total - shared)) AS held FROM q GROUP BY ALL),
m AS (SELECT avg(coalesce(near, 0)) AS proximity, avg(coalesce(held, 0)) AS enclosure FROM p LEFT JOIN e USING (record_id, id)),
w AS (SELECT unnest(['anchor_text', 'nearby_label', 'structural', 'containing_region', 'sibling_arrangement', 'local_geometry', 'graph_relationship']) AS weight, pairs, proximity, enclosure, unnest([CASE WHEN proximity > 0.8 THEN 0.15 WHEN proximity < 0.5 THEN 0.25 ELSE 0.2 END, CASE WHEN proximity > 0.8 THEN 0.2 WHEN proximity < 0.5 THEN 0.22 ELSE 0.17 END, 0.14,
  CASE WHEN enclosure > 0.5 THEN 0.15 ELSE 0.1 END, 0.1, CASE WHEN proximity > 0.8 THEN 0.22 WHEN proximity < 0.5 THEN 0.12 ELSE 0.17 END, 0.12])::DOUBLE AS v FROM m, n)
SELECT weight, round(v / sum(v) OVER (), 2) AS suggested, CAST(pairs AS BIGINT) AS pairs, round(proximity, 3) AS proximity, round(enclosure, 3) AS enclosure FROM w""")
def ranking_weights(spark, sf_dir):
    return annotations.ranking_weights(drawn(spark, sf_dir))


@query(REGIONS + """, s AS (SELECT sheet, id, CASE WHEN id % 3 = 2 AND id % 4 <> 3 THEN x * 500 ELSE x * 1000 END AS px, y * 800 AS py, w * 1000 AS pw, h * 800 AS ph FROM r)
SELECT sheet, id, round(px, 6) AS x, round(py, 6) AS y, round(least(greatest(px / 1000, 0), 1), 6) AS nx, round(least(pw / 1000, 1), 6) AS nw FROM s""")
def region_snapshots(spark, sf_dir):
    """Regions given by box, by sides or by shares of the page."""
    k, r = F.col("id"), regions(spark, sf_dir)
    x, y, w, h = F.col("x") * 1000, F.col("y") * 800, F.col("w") * 1000, F.col("h") * 800
    some = lambda cond, e: F.when(cond, e)
    sides, shares = (k % 3 == 1) | (k % 4 == 3), k % 3 == 2
    half = F.when(shares & (k % 4 != 3), F.col("x") / 2).otherwise(F.col("x"))
    named = r.select("sheet", "id", some(k % 3 == 0, G.box(x, y, w, h)).alias("bbox"), some(sides, x).alias("px"), some(sides, y).alias("py"), some(sides, w).alias("pw"), some(sides, h).alias("ph"), half.alias("nx"), F.col("y").alias("ny"), F.col("w").alias("nw"), F.col("h").alias("nh"), F.lit(1000).alias("page_w"), F.lit(800).alias("page_h"), F.lit(None).cast("double").alias("confidence"), F.lit(0.5).alias("text_density"), F.lit(None).cast("string").alias("surface"))
    named = named.select("*", *(F.col(f"p{c}").alias(c) for c in "xywh"))
    s = annotations.region_snapshots(named, KEYS)
    six = lambda e, n: F.round(e, 6).alias(n)
    return s.select("sheet", "id", six(F.col("box.x"), "x"), six(F.col("box.y"), "y"), six(F.col("norm.x"), "nx"), six(F.col("norm.w"), "nw"))


@query("""WITH p AS (SELECT user_id AS file_id, event_id % 20 AS page, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'data:image/png;base64,' || repeat('A', (event_id % 50)::INT + 4) END AS data, CASE WHEN event_id % 7 = 0 THEN 'data:x,' || repeat('B', (event_id % 9)::INT + 1) END AS thumb FROM events WHERE event_id % 20 <> 0),
g AS (SELECT file_id, page, min(seq) AS first, arg_max(data, seq) FILTER (WHERE data IS NOT NULL) AS data, arg_max(thumb, seq) FILTER (WHERE thumb IS NOT NULL) AS thumb FROM p GROUP BY ALL),
s AS (SELECT *, ceil(len(split_part(coalesce(data, ''), ',', 2)) * 3 / 4)::BIGINT AS n, ceil(len(split_part(thumb, ',', 2)) * 3 / 4)::BIGINT AS t FROM g)
SELECT file_id, page, CASE WHEN n <= 30 THEN data END AS data, n > 30 AS too_large, coalesce(t, n) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY first, page) AS k FROM s) WHERE k <= 4""")
def page_manifests(spark, sf_dir):
    e = F.col("event_id")
    n = lambda m, more: (e % m).cast("int") + more
    data = F.when(e % 3 == 0, F.concat(F.lit("data:image/png;base64,"), F.repeat(F.lit("A"), n(50, 4))))
    thumb = F.when(e % 7 == 0, F.concat(F.lit("data:x,"), F.repeat(F.lit("B"), n(9, 1))))
    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), (e % 20).alias("page"), e.alias("seq"), data.alias("data"), thumb.alias("thumb"))
    return annotations.page_manifests(p, most=4, size=30)


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'Q' || user_id ELSE event_type END AS query_raw, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 2 = 0 THEN 'q' ELSE '' END AS query_normalized,
  CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 3 = 0 THEN 'pdfjs' ELSE 'ocr' END END AS source, CASE WHEN event_id % 11 <> 0 THEN 'c' || (event_id % 4) END AS chosen, CASE WHEN event_id % 11 = 0 OR event_id % 5 = 0 THEN 0 ELSE 2 END AS candidates, CASE WHEN event_id % 11 <> 0 THEN (event_id % 7)::DOUBLE END AS page FROM events""")
def learning_entries(spark, sf_dir):
    """Log entries whose query is an object or a text, some without source, choice or candidates, some broken."""
    e = F.col("event_id")
    body = F.to_json(F.struct(F.when(e % 2 == 0, F.struct(F.concat(F.lit("Q"), F.col("user_id").cast("string")).alias("raw"), F.lit("q").alias("normalized"))).alias("query"), F.lit("ocr").alias("tokenSource"), F.when(e % 3 == 0, "pdfjs").alias("source"), F.concat(F.lit("c"), (e % 4).cast("string")).alias("winnerCandidateId"), F.when(e % 5 != 0, F.array(F.lit("x"), F.lit("y"))).alias("candidates"), (e % 7).alias("page")))
    text = F.when(e % 2 == 0, body).otherwise(F.concat(F.lit('{"query": "'), "event_type", F.lit('", '), F.substr(body, F.lit(2))))
    lines = table(spark, sf_dir, "events").select(e.alias("event_id"), F.when(e % 11 == 0, "broken").otherwise(text).alias("value"))
    n = annotations.normalised_entries(lines)
    return n.select("event_id", "query_raw", "query_normalized", "source", F.col("chosenCandidateId").alias("chosen"), F.size("candidates").alias("candidates"), "page")


@query(REGIONS + """, n AS (SELECT sheet, id, ['token', 'line', 'block', 'region', 'surface'][id % 5 + 1] AS kind, x * 1000 AS x, y * 800 AS y, w * 1000 AS w, h * 800 AS h, (id % 200) * 1.0::DOUBLE AS turn FROM r), s AS (SELECT * FROM n WHERE id % 10 = 7),
p AS (SELECT s.sheet, s.id AS seed_id, n.id AS node_id, n.kind, sqrt((s.x + s.w / 2 - n.x - n.w / 2) ** 2 + (s.y + s.h / 2 - n.y - n.h / 2) ** 2) / sqrt(1000 ** 2 + 800 ** 2) AS away, n.turn,
  greatest(0, least(s.x + s.w, n.x + n.w) - greatest(s.x, n.x)) * greatest(0, least(s.y + s.h, n.y + n.h) - greatest(s.y, n.y)) AS shared, s.w * s.h + n.w * n.h AS total, n.x <= s.x AND n.y <= s.y AND n.x + n.w >= s.x + s.w AND n.y + n.h >= s.y + s.h AS around FROM s JOIN n USING (sheet)),
q AS (SELECT *, CASE WHEN shared > 0 THEN shared / greatest(1, total - shared) ELSE 0 END * 0.6 + (1 - away) * 0.25 + greatest(0, 1 - least(180, turn) / 180) * 0.15 AS signal FROM p),
a AS (SELECT sheet, seed_id, 'token' AS role, node_id FROM q WHERE kind = 'token' AND shared > 0 UNION ALL SELECT sheet, seed_id, 'intersecting', node_id FROM q WHERE kind = 'region' AND shared > 0 UNION ALL SELECT sheet, seed_id, 'containing', node_id FROM q WHERE kind = 'region' AND around
  UNION ALL SELECT sheet, seed_id, kind, node_id FROM (SELECT *, row_number() OVER (PARTITION BY sheet, seed_id, kind ORDER BY away, node_id) AS k FROM q WHERE kind IN ('line', 'block')) WHERE k <= CASE WHEN kind = 'line' THEN 8 ELSE 6 END
  UNION ALL SELECT sheet, seed_id, kind, node_id FROM (SELECT *, row_number() OVER (PARTITION BY sheet, seed_id ORDER BY signal DESC, node_id) AS k FROM q WHERE kind = 'surface' AND signal > 0.05) WHERE k <= 6)
SELECT * FROM a""")
def associated_selections(spark, sf_dir):
    """What belongs to every selection of a sheet: tokens, lines, blocks, regions and surfaces."""
    k = F.col("id")
    kind = F.get(F.array(*map(F.lit, ("token", "line", "block", "region", "surface"))), k % 5)
    n = regions(spark, sf_dir).select("sheet", "id", kind.alias("kind"), (F.col("x") * 1000).alias("x"), (F.col("y") * 800).alias("y"), (F.col("w") * 1000).alias("w"), (F.col("h") * 800).alias("h"), (k % 200 * 1.0).alias("orientation"))
    return annotations.associated(n.where(k % 10 == 7), n, KEYS, F.lit(1000.0), F.lit(800.0)).select("sheet", "seed_id", "role", "node_id")
