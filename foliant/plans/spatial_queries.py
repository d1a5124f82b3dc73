"""Boxes and tokens: customers as boxes on one page per nation, conversation words as tokens on lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.numeric import half_up
from ..operators import batchstats, components, dedupe, folds, search, spatial
from ..sources import readers
from .tabular_queries import table

QUERIES: dict = {}
ORACLE: dict = {}
KEY = ["page"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


BOXES = """WITH r AS (SELECT c_nationkey AS page, c_custkey AS id, (c_acctbal + 1000) / 11000 AS x, (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS y, 0.02::DOUBLE + (c_custkey % 7) / 100.0::DOUBLE AS w, 0.02::DOUBLE + (c_custkey % 5) / 100.0::DOUBLE AS h FROM customer)
"""
OVER = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"


def boxes(spark, sf_dir) -> DataFrame:
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(F.col("c_nationkey").alias("page"), k.alias("id"), ((F.col("c_acctbal") + 1000) / 11000).alias("x"), (k * 37 % 1000 / 1000.0).alias("y"), (0.02 + k % 7 / 100.0).alias("w"), (0.02 + k % 5 / 100.0).alias("h"))


def shifted(b: DataFrame) -> DataFrame:
    return b.withColumn("x", F.col("x") + F.when(F.col("id") % 3 == 0, 0.3).otherwise(0.006))


@query(BOXES + f""", t AS (SELECT page, id, x + CASE WHEN id % 3 = 0 THEN 0.3 ELSE 0.006 END AS x, y, w, h FROM r),
p AS (SELECT a.page, a.id, b.id AS auto_id, {OVER} / (a.w * a.h + b.w * b.h - {OVER}) AS iou FROM r a JOIN t b ON a.page = b.page),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY iou DESC, auto_id) AS n FROM p WHERE iou >= 0.3) WHERE n = 1)
SELECT r.page, r.id, auto_id, round(iou, 9) AS iou FROM r LEFT JOIN m USING (page, id)""")
def annotation_match(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return spatial.iou_best(b, shifted(b), KEY, size=0.1).select("page", "id", "auto_id", F.round("iou", 9).alias("iou"))


@query(BOXES + f""", t AS (SELECT page, id, x + CASE WHEN id % 3 = 0 THEN 0.3 ELSE 0.006 END AS x, y, w, h FROM r),
p AS (SELECT a.page, a.id, b.id AS auto_id, {OVER} / (a.w * a.h + b.w * b.h - {OVER}) AS iou FROM r a JOIN t b ON a.page = b.page),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY iou DESC, auto_id) AS n FROM p WHERE iou >= 0.3) WHERE n = 1)
SELECT t.page, t.id FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page = t.page AND m.auto_id = t.id)""")
def annotation_extras(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return spatial.extras(shifted(b), spatial.iou_best(b, shifted(b), KEY, size=0.1), KEY)


DIST = "sqrt((a.x + a.w / 2 - b.x - b.w / 2) * (a.x + a.w / 2 - b.x - b.w / 2) + (a.y + a.h / 2 - b.y - b.h / 2) * (a.y + a.h / 2 - b.y - b.h / 2))"
IN = lambda a, b: f"({a}.x <= {b}.x AND {a}.y <= {b}.y AND {a}.x + {a}.w >= {b}.x + {b}.w AND {a}.y + {a}.h >= {b}.y + {b}.h)"


@query(BOXES + f""", s AS (SELECT page, id, x * 800 AS x, y * 800 AS y, w * 800 AS w, h * 800 AS h, 0.5::DOUBLE + (id % 4) / 10.0::DOUBLE AS conf, id % 2 AS src, id % 4 AS depth FROM r),
p0 AS (SELECT a.page, a.id AS ai, b.id AS bi, {IN('a', 'b')} AS ab, {IN('b', 'a')} AS ba, greatest(0, 1 - {DIST} / 200) AS near, CASE WHEN a.src = b.src THEN 1.0 ELSE 0.85 END::DOUBLE * greatest(0, 1 - 2 * abs(a.conf - b.conf)) AS alike,
  CASE WHEN abs(a.depth - b.depth) <= 1 THEN 0.95 ELSE greatest(0.5, 0.95 - (abs(a.depth - b.depth) - 1) * 0.15) END::DOUBLE AS dw, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ox, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oy,
  least(a.h, b.h) AS mh, least(a.w, b.w) AS mw FROM s a JOIN s b ON a.page = b.page AND a.id < b.id),
p AS (SELECT *, CASE WHEN oy > 8 AND abs(ox) <= 8 THEN oy / greatest(1, mh) WHEN ox > 8 AND abs(oy) <= 8 THEN ox / greatest(1, mw) END AS shared FROM p0)
SELECT page, ai AS source_id, bi AS target_id, 'spatial_proximity' AS edge_type, round(near * alike, 9) AS weight FROM p WHERE near > 0.1 AND near * alike > 0.08
UNION ALL SELECT page, ai, bi, 'contains', dw FROM p WHERE ab UNION ALL SELECT page, bi, ai, 'contains', dw FROM p WHERE ba AND NOT ab
UNION ALL SELECT page, ai, bi, 'spatial_adjacency', round(least(0.9, 0.4 + shared * 0.5), 9) FROM p WHERE shared > 0.15""")
def region_graph(spark, sf_dir):
    b = boxes(spark, sf_dir)
    b = b.select("page", "id", *((F.col(c) * 800).alias(c) for c in "xywh"), (0.5 + F.col("id") % 4 / 10.0).alias("confidence"), (F.col("id") % 2).alias("source"), (F.col("id") % 4).alias("depth"))
    e = spatial.region_edges(b, KEY, 200.0)
    return e.select("page", "source_id", "target_id", "edge_type", half_up(F.col("weight"), 9).alias("weight"))


@query(BOXES + f""", p AS (SELECT a.page, a.id, b.id AS parent, b.w * b.h AS s FROM r a JOIN r b ON a.page = b.page AND a.id <> b.id AND {IN('b', 'a')} AND b.w * b.h > 1.1 * a.w * a.h),
m AS (SELECT page, id, count(*) AS depth, arg_min(parent, (s, parent)) AS parent_id FROM p GROUP BY 1, 2) SELECT r.page, r.id, parent_id, coalesce(depth, 0) AS depth FROM r LEFT JOIN m USING (page, id)""")
def containment_depth(spark, sf_dir):
    return spatial.parents(boxes(spark, sf_dir), KEY, 0.1)


@query(BOXES + f""", p AS (SELECT a.page, a.id AS box_id, b.id AS token_id, {DIST} AS d FROM r a JOIN r b ON a.page = b.page AND {DIST} <= 0.2),
k AS (SELECT *, row_number() OVER (PARTITION BY page, box_id ORDER BY d, token_id) AS rank FROM p) SELECT page, box_id, token_id, rank::INT AS rank, round(d, 9) AS distance FROM k WHERE rank <= 5""")
def nearest_k_capture(spark, sf_dir):
    b = boxes(spark, sf_dir)
    c = spatial.capture(b, b, KEY, 0.2)
    return c.select(F.col("a_page").alias("page"), F.col("a_id").alias("box_id"), F.col("b_id").alias("token_id"), "rank", F.round("distance", 9).alias("distance"))


@query(BOXES + """SELECT a.page, b.id AS box_id, count(*) AS hits FROM r a JOIN r b ON a.page = b.page AND a.x + a.w / 2 BETWEEN b.x AND b.x + b.w AND a.y + a.h / 2 BETWEEN b.y AND b.y + b.h GROUP BY 1, 2""")
def tokens_in_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir)
    hits = spatial.tokens_in_boxes(b, b, KEY, "center", size=0.1)
    return hits.groupBy(F.col("a_page").alias("page"), F.col("b_id").alias("box_id")).agg(F.count("*").alias("hits"))


@query(BOXES + f"""SELECT a.page, b.id AS box_id, count(*) AS hits FROM r a JOIN r b ON a.page = b.page AND {OVER} > 0 AND {OVER} >= 0.25 * a.w * a.h GROUP BY 1, 2""")
def tokens_by_area(spark, sf_dir):
    b = boxes(spark, sf_dir)
    hits = spatial.tokens_in_boxes(b, b, KEY, "area", 0.25, size=0.1)
    return hits.groupBy(F.col("a_page").alias("page"), F.col("b_id").alias("box_id")).agg(F.count("*").alias("hits"))


@query(BOXES + """SELECT page, min(x) AS x, min(y) AS y, max(x + w) AS "right", max(y + h) AS bottom FROM r GROUP BY page""")
def page_bounds(spark, sf_dir):
    return spatial.bounds(boxes(spark, sf_dir), KEY)


@query(BOXES + """, c AS (SELECT page, (least(floor((y + h / 2) * 4), 3) * 4 + least(floor((x + w / 2) * 4), 3))::INT AS cell, sum(w * h) AS a FROM r GROUP BY 1, 2),
g AS (SELECT page, unnest(range(16))::INT AS cell FROM (SELECT DISTINCT page FROM r)) SELECT page, cell, round(coalesce(a, 0) / sum(coalesce(a, 0)) OVER (PARTITION BY page), 9) AS share FROM g LEFT JOIN c USING (page, cell)""")
def spatial_histogram(spark, sf_dir):
    return batchstats.spatial_histogram(boxes(spark, sf_dir), "page").select("page", "cell", F.round("share", 9).alias("share"))


@query(BOXES + """, n AS (SELECT *, CASE WHEN y + h / 2 - lag(y + h / 2) OVER w > 0.02 THEN 1 ELSE 0 END AS new_ FROM r WINDOW w AS (PARTITION BY page ORDER BY y + h / 2, id)),
b AS (SELECT *, sum(new_) OVER (PARTITION BY page ORDER BY y + h / 2, id ROWS UNBOUNDED PRECEDING) AS band FROM n) SELECT page, CAST(band AS BIGINT) AS band, count(*) AS n, min(y) AS top FROM b GROUP BY 1, 2""")
def row_bands(spark, sf_dir):
    b = spatial.row_bands(boxes(spark, sf_dir), KEY, 0.02)
    return b.groupBy("page", "band").agg(F.count("*").alias("n"), F.min("y").alias("top"))


@query(BOXES + """, n AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x) > 0.01 THEN 1 ELSE 0 END AS new_ FROM r),
c AS (SELECT *, sum(new_) OVER (PARTITION BY page ORDER BY x) AS cluster FROM n) SELECT page, id, CAST(cluster AS BIGINT) AS cluster, round(avg(x) OVER (PARTITION BY page, cluster), 9) AS center FROM c""")
def value_clusters(spark, sf_dir):
    return spatial.clusters(boxes(spark, sf_dir), KEY, "x", 0.01).select("page", "id", "cluster", F.round("center", 9).alias("center"))


@query(BOXES + """, g AS (SELECT page, y, max(y + h / 16) OVER (PARTITION BY page ORDER BY y, y + h / 16 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM r)
SELECT page, round(e, 9) AS gap_start, round(y, 9) AS gap_end FROM g WHERE y - e >= 0.01""")
def whitespace_gaps(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("end", F.col("y") + F.col("h") / 16)
    return spatial.gaps(b, KEY, "y", "end", 0.01).select("page", F.round("gap_start", 9).alias("gap_start"), F.round("gap_end", 9).alias("gap_end"))


@query(BOXES + """, q AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y + h / 2, x + w / 2, id) AS rn FROM r),
p AS (SELECT a.page, a.id AS a_id, b.id AS b_id, abs((a.x + a.w / 2) - (b.x + b.w / 2)) AS dx, abs((a.y + a.h / 2) - (b.y + b.h / 2)) AS dy FROM q a JOIN q b ON a.page = b.page AND b.rn BETWEEN a.rn + 1 AND a.rn + 17)
SELECT page, a_id, b_id, CASE WHEN dy <= 0.015 AND dx <= 0.35 THEN 'same_line' WHEN dx <= 0.06 AND dy <= 0.2 THEN 'vertical_near' ELSE 'near' END AS edge_type FROM p WHERE (dy <= 0.015 AND dx <= 0.35) OR (dx <= 0.06 AND dy <= 0.2) OR (dx <= 0.25 AND dy <= 0.12)""")
def lookahead_edges(spark, sf_dir):
    return spatial.lookahead_edges(boxes(spark, sf_dir), KEY)


@query(BOXES + f""", e AS (SELECT a.id AS u, b.id AS v FROM r a JOIN r b ON a.page = b.page AND a.id < b.id AND {OVER} > 0),
reach AS (WITH RECURSIVE c(node, low) AS (SELECT id, id FROM r UNION SELECT CASE WHEN c.node = e.u THEN e.v ELSE e.u END, c.low FROM c JOIN e ON c.node = e.u OR c.node = e.v) SELECT node, min(low) AS component FROM c GROUP BY node) SELECT node AS id, component FROM reach""")
def overlap_components(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return components.overlapping(b, KEY, 0.1, 0.02)


TOKENS = """WITH t0 AS (SELECT conv_id AS doc_id, turn AS line, unnest(string_split(lower(text), ' ')) AS raw, unnest(range(len(string_split(text, ' ')))) AS place FROM conversations),
t AS (SELECT doc_id, line, place, trim(regexp_replace(raw, '[^a-z0-9]+', '', 'g')) AS text FROM t0 WHERE trim(regexp_replace(raw, '[^a-z0-9]+', '', 'g')) <> '')
"""


def tokens(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), F.posexplode(F.split(F.lower("text"), " ")).alias("place", "raw"))
    return t.withColumn("text", T.squash(T.keyword_norm(F.regexp_replace("raw", "[^a-z0-9]+", "")))).where("text <> ''").drop("raw")


@query(TOKENS + """, p AS (SELECT text, doc_id, count(*) AS k, avg(place) AS x, avg(line) AS y FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc_id) AS n FROM t)
SELECT text, count(*) AS docs, max(k) AS max_per_doc, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(stddev_pop(x), 6) AS dx, round(stddev_pop(y), 6) AS dy FROM p CROSS JOIN n GROUP BY text, n HAVING count(*) >= 0.1 * n AND max(k) <= 20""")
def token_frequency(spark, sf_dir):
    t = tokens(spark, sf_dir).select("doc_id", "text", F.col("place").cast("double").alias("x"), F.col("line").cast("double").alias("y"))
    return batchstats.token_frequency(t, 0.1, 20).select("text", "docs", "max_per_doc", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


MATCH = lambda a, b: f"({a} = '{b}' OR ((contains({a}, '{b}') OR contains('{b}', {a})) AND least(length({a}), {len(b)}) >= {min(3, len(b))}))"


@query(TOKENS + f""", l AS (SELECT *, lead(text) OVER (PARTITION BY doc_id, line ORDER BY place) AS next_ FROM t)
SELECT 'q1' AS query_id, doc_id, line, place::INT AS place, 2 AS n_tokens FROM l WHERE {MATCH('text', 'of')} AND next_ IS NOT NULL AND {MATCH('next_', 'the')}
UNION ALL SELECT 'q1', doc_id, line, place::INT, 1 FROM t WHERE contains(text, 'ofthe') OR contains('ofthe', text)""")
def phrase_search(spark, sf_dir):
    q = spark.createDataFrame([("q1", "Of THE")], "query_id string, query string")
    return search.phrase_candidates(tokens(spark, sf_dir), q, ["doc_id"]).select("query_id", "doc_id", "line", "place", "n_tokens")


@query("""SELECT c_nationkey AS page, c_custkey AS id, round((c_acctbal + 1000) / 11000 * 800, 6) AS px, greatest(floor(800 * (0.02::DOUBLE + (c_custkey % 7) / 100.0::DOUBLE) + 0.5), 1) AS pw FROM customer""")
def denormalised_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("b", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    d = b.select("page", "id", F.round(F.col("x") * 800, 6).alias("px"), G.denormalized(F.col("b"), F.lit(800), F.lit(1000)).alias("d"))
    return d.select("page", "id", "px", F.col("d.w").alias("pw"))


@query(BOXES + f""", p AS (SELECT a.page, a.id AS a, b.id AS b, {OVER} / (a.w * a.h) AS ratio, {DIST} AS distance FROM r a JOIN r b ON a.page = b.page AND b.id = a.id + 25) SELECT page, a, b, round(ratio, 9) AS ratio, round(distance, 9) AS distance FROM p""")
def box_relations(spark, sf_dir):
    b = boxes(spark, sf_dir)
    s = b.select("page", "id", G.box(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))
    o = s.select(F.col("page").alias("q"), F.col("id").alias("b"), F.col("box").alias("other"))
    j = s.join(o, (F.col("page") == F.col("q")) & (F.col("b") == F.col("id") + 25))
    return j.select("page", F.col("id").alias("a"), "b", F.round(G.overlap_ratio(F.col("box"), F.col("other")), 9).alias("ratio"), F.round(G.distance(F.col("box"), F.col("other")), 9).alias("distance"))


@query("""SELECT o_custkey AS id, ((o_custkey * 7) % 13)::INT AS page, 'w' || (o_custkey % 3) AS text, coalesce(NULL, 0.75::DOUBLE) AS confidence, length('w' || (o_custkey % 3))::INT AS char_count FROM (SELECT DISTINCT o_custkey FROM orders)""")
def token_ingest(spark, sf_dir):
    k = F.col("o_custkey")
    raw = table(spark, sf_dir, "orders").select("o_custkey").distinct().select(k.alias("id"), (k * 7 % 13).cast("int").alias("page"), F.concat(F.lit(" w"), (k % 3).cast("string"), F.lit("\n")).alias("text"), *(F.lit(1).alias(c) for c in "xywh"), F.lit(None).cast("double").alias("confidence"))
    blank = raw.withColumn("text", F.lit("  "))
    return readers.tokens(raw.unionByName(blank)).select("id", "page", "text", "confidence", "char_count")


RECURSIVE = BOXES.replace("WITH r", "WITH RECURSIVE r")


@query(RECURSIVE + """, o AS (SELECT page, y + h / 2 AS c, row_number() OVER (PARTITION BY page ORDER BY y + h / 2, x, id) AS n FROM r),
s(page, n, line, m, k) AS (SELECT page, n, 0, c, 1 FROM o WHERE n = 1 UNION ALL SELECT o.page, o.n, CASE WHEN abs(m - c) <= 0.01 THEN line ELSE line + 1 END, CASE WHEN abs(m - c) <= 0.01 THEN m + (c - m) / (k + 1) ELSE c END, CASE WHEN abs(m - c) <= 0.01 THEN k + 1 ELSE 1 END FROM s JOIN o ON o.page = s.page AND o.n = s.n + 1)
SELECT page, line::INT AS line, count(*) AS n FROM s GROUP BY 1, 2""")
def line_grouping(spark, sf_dir):
    b = boxes(spark, sf_dir)
    g = folds.group_lines(b, KEY, 0.01, "mean")
    return g.groupBy("page", "line").agg(F.count("*").alias("n"))


@query(RECURSIVE + """, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, id) AS n FROM r),
s(page, n, kept) AS (SELECT page, n, [{id: id, x: x, y: y, w: w, h: h}] FROM o WHERE n = 1 UNION ALL SELECT o.page, o.n,
  CASE WHEN len(list_filter(kept, lambda b: greatest(0, least(o.x + o.w, b.x + b.w) - greatest(o.x, b.x)) * greatest(0, least(o.y + o.h, b.y + b.h) - greatest(o.y, b.y)) > 0.25 * o.w * o.h)) = 0 THEN list_append(kept, {id: o.id, x: o.x, y: o.y, w: o.w, h: o.h}) ELSE kept END
  FROM s JOIN o ON o.page = s.page AND o.n = s.n + 1),
f AS (SELECT page, arg_max(kept, n) AS kept FROM s GROUP BY page) SELECT page, unnest(kept).id AS id FROM f""")
def non_maximum_suppression(spark, sf_dir):
    return folds.suppress(boxes(spark, sf_dir).withColumn("score", F.col("w") * F.col("h")), KEY).select("page", "id")


@query(RECURSIVE + f""", t AS (SELECT page, id, x + CASE WHEN id % 3 = 0 THEN 0.3 ELSE 0.006 END AS x, y, w, h FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, a, b) AS n FROM (SELECT a.page, a.id AS a, b.id AS b, round({OVER}, 9) AS score FROM r a JOIN t b ON a.page = b.page) WHERE score > 0),
s(page, n, l, g, a, b, score) AS (SELECT page, n, [a], [b], a, b, score FROM p WHERE n = 1 UNION ALL SELECT p.page, p.n,
  CASE WHEN list_contains(l, p.a) OR list_contains(g, p.b) THEN l ELSE list_append(l, p.a) END, CASE WHEN list_contains(l, p.a) OR list_contains(g, p.b) THEN g ELSE list_append(g, p.b) END,
  CASE WHEN list_contains(l, p.a) OR list_contains(g, p.b) THEN NULL ELSE p.a END, p.b, p.score FROM s JOIN p ON p.page = s.page AND p.n = s.n + 1)
SELECT page, a, b, score FROM s WHERE a IS NOT NULL""")
def greedy_assignment(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return folds.assign_boxes(b, shifted(b), KEY, 0.1)


@query()
def convex_hulls(spark, sf_dir):
    return folds.hulls(boxes(spark, sf_dir).select("page", "x", "y"), KEY)


@query("""WITH c AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages), n AS (SELECT host, count(*) AS n, min(page_id) AS first_page FROM c GROUP BY host) SELECT host, n, first_page FROM n""")
def pages_by_host(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "://([^/]+)", 1))
    return p.groupBy("host").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("""SELECT page, x, y, id FROM (SELECT *, row_number() OVER (PARTITION BY page, round(x * 10, 0), round(y * 10, 0) ORDER BY id) AS n FROM (SELECT c_nationkey AS page, c_custkey AS id, (c_acctbal + 1000) / 11000 AS x, (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS y FROM customer)) WHERE n = 1""")
def seen_boxes(spark, sf_dir):
    b = boxes(spark, sf_dir).select("page", (F.col("x") * 10).alias("x"), (F.col("y") * 10).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"), F.col("id").alias("order"), F.col("x").alias("x0"), F.col("y").alias("y0"))
    return dedupe.seen_boxes(b).select("page", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("order").alias("id"))
