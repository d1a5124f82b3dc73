"""Areas, grids, text graphs and structural summaries: customers as boxes on one page per nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_up
from ..operators import layout, summary
from .spatial_queries import BOXES, boxes
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


def r9(name: str):
    return F.round(name, 9).alias(name)


#: The boxes in pixels of a page of 800 by 800, with a word each.
PIXELS = BOXES + """, t AS (SELECT page, id, x * 800 AS x, y * 800 AS y, w * 800 AS w, h * 800 AS h, 'w' || (id % 5) AS norm FROM r)
"""


def pixels(spark, sf_dir) -> DataFrame:
    b = boxes(spark, sf_dir)
    return b.select("page", "id", *((F.col(c) * 800).alias(c) for c in "xywh"), F.concat(F.lit("w"), (F.col("id") % 5).cast("string")).alias("norm"))


def rows(spark, schema: str, values: list) -> DataFrame:
    return spark.createDataFrame(values, schema)


@query(BOXES + """, f AS (SELECT * FROM (VALUES ('free', false), ('bound', true), ('other', true)) v(field, bound)),
j AS (SELECT page, field, id FROM r, f WHERE NOT bound OR field = 'other' OR (x + w / 2 BETWEEN 0.25::DOUBLE AND 0.25::DOUBLE + 0.5::DOUBLE AND least(y + h, 0.125::DOUBLE + 0.5::DOUBLE) - greatest(y, 0.125::DOUBLE) >= 0))
SELECT page, field, count(*) AS tokens, CAST(sum(id) AS BIGINT) AS ids FROM j GROUP BY 1, 2""")
def area_scoping(spark, sf_dir):
    b = boxes(spark, sf_dir)
    f = rows(spark, "field string, is_area boolean, subordinate boolean, relative boolean, ax double, ay double, aw double, ah double",
             [("free", False, False, None, 0.25, 0.125, 0.5, 0.5), ("bound", False, True, None, 0.25, 0.125, 0.5, 0.5), ("other", True, True, True, 0.25, 0.125, 0.5, 0.5)])
    seen = layout.scoped(b, b.select("page").distinct().crossJoin(f), KEY)
    return seen.groupBy("page", "field").agg(F.count("*").alias("tokens"), F.sum("id").cast("long").alias("ids"))


@query(PIXELS + """, k AS (SELECT i AS kw, 'w' || i AS norm, 0.25::DOUBLE * i AS cx, 0.5::DOUBLE AS cy, 0.125::DOUBLE * i AS l, 0.25::DOUBLE AS tp, 0.125::DOUBLE AS r, 0.25::DOUBLE AS b FROM range(5) g(i)),
c AS (SELECT page, id, x AS bx, y AS by_, 400.0::DOUBLE AS w, 300.0::DOUBLE AS h FROM t),
p AS (SELECT c.page, c.id, k.kw, sqrt((t.x + t.w / 2 - bx - k.cx * c.w) * (t.x + t.w / 2 - bx - k.cx * c.w) + (t.y + t.h / 2 - by_ - k.cy * c.h) * (t.y + t.h / 2 - by_ - k.cy * c.h)) AS d,
 greatest(abs(l - (t.x - bx) / c.w), abs(tp - (t.y - by_) / c.h), abs(k.r - (bx + c.w - t.x - t.w) / c.w), abs(k.b - (by_ + c.h - t.y - t.h) / c.h)) AS e FROM c JOIN k ON true JOIN t ON t.page = c.page AND t.norm = k.norm),
b AS (SELECT page, id, kw, d / 500 AS d, e, row_number() OVER (PARTITION BY page, id, kw ORDER BY d / 500 + e, d) AS n FROM p WHERE d <= 32),
g AS (SELECT page, id, count(*) AS matched, avg(least(1, d)) AS d, avg(least(1, e)) AS e FROM b WHERE n = 1 GROUP BY 1, 2)
SELECT c.page, c.id AS candidate, coalesce(matched, 0) AS matched, coalesce(matched, 0) / 5.0::DOUBLE AS match_ratio, round(CASE WHEN d IS NULL THEN 0 ELSE least(1, d * 0.6 + e * 0.4) END, 9)::DOUBLE AS position_penalty FROM c LEFT JOIN g USING (page, id)""")
def layout_scores(spark, sf_dir):
    t = pixels(spark, sf_dir)
    c = t.select("page", F.col("id").alias("candidate"), F.lit("L").alias("layout"), "x", "y", F.lit(400.0).alias("w"), F.lit(300.0).alias("h"))
    k = rows(spark, "layout string, kw int, norm string, cx double, cy double, left double, top double, right double, bottom double", [("L", i, f"w{i}", 0.25 * i, 0.5, 0.125 * i, 0.25, 0.125, 0.25) for i in range(5)])
    s = layout.layout_scores(c, k, t, KEY)
    return s.select("page", "candidate", "matched", "match_ratio", r9("position_penalty"))


@query(BOXES + """, t AS (SELECT page, id, 'w' || (id % 5) AS norm, x + w / 2 AS cx, y + h / 2 AS cy FROM r),
a AS (SELECT page, id, cx AS ax, cy AS ay FROM t WHERE norm = 'w0'), s AS (SELECT * FROM (VALUES (0, 'w1', 0.25::DOUBLE, 0.0::DOUBLE), (1, 'w2', -0.125::DOUBLE, 0.25::DOUBLE), (2, 'w3', 0.0::DOUBLE, -0.25::DOUBLE)) v(idx, norm, dx, dy)),
p AS (SELECT a.page, a.id, idx, t.cx AS tx, t.cy AS ty, abs(t.cx - ax - dx) + abs(t.cy - ay - dy) AS e, row_number() OVER (PARTITION BY a.page, a.id, idx ORDER BY abs(t.cx - ax - dx) + abs(t.cy - ay - dy), t.id) AS n
 FROM a JOIN s ON true JOIN t ON t.page = a.page AND t.norm = s.norm WHERE abs(t.cx - ax - dx) <= 0.125::DOUBLE AND abs(t.cy - ay - dy) <= 0.125::DOUBLE),
b AS (SELECT * FROM p WHERE n = 1), m AS (SELECT page, id, count(*) AS matched, sum(e) AS e FROM b GROUP BY 1, 2),
l AS (SELECT f.page, f.id, abs(g.tx - f.tx + 0.375::DOUBLE) + abs(g.ty - f.ty - 0.25::DOUBLE) AS le FROM b f JOIN b g ON f.page = g.page AND f.id = g.id AND f.idx = 0 AND g.idx = 1 WHERE abs(g.tx - f.tx + 0.375::DOUBLE) <= 0.125::DOUBLE AND abs(g.ty - f.ty - 0.25::DOUBLE) <= 0.125::DOUBLE),
z AS (SELECT a.page, a.id, ax - 0.0625::DOUBLE AS x, ay - 0.03125::DOUBLE AS y, coalesce(matched, 0) AS matched, 1 + coalesce(matched, 0) + CASE WHEN le IS NULL THEN 0 ELSE 1 END AS edges, coalesce(m.e, 0) + coalesce(le, 0) AS e FROM a LEFT JOIN m USING (page, id) LEFT JOIN l USING (page, id) WHERE coalesce(matched, 0) >= 1)
SELECT page, id AS anchor_id, round(x, 9) AS x, round(y, 9) AS y, matched, CAST(edges AS BIGINT) AS edges, round(edges / 5.0::DOUBLE * 0.65::DOUBLE + matched / 3.0::DOUBLE * 0.25::DOUBLE + (1 - least(1, e / edges / 0.125::DOUBLE)) * 0.1::DOUBLE, 9) AS confidence FROM z""")
def area_constellations(spark, sf_dir):
    b = boxes(spark, sf_dir)
    t = b.select("page", "id", F.concat(F.lit("w"), (F.col("id") % 5).cast("string")).alias("norm"), (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"))
    a = rows(spark, "area string, norm string, dx double, dy double, fw double, fh double, tolerance double, least int", [("A", "w0", 0.0625, 0.03125, 0.5, 0.25, 0.125, 1)])
    s = rows(spark, "area string, idx int, norm string, dx double, dy double", [("A", 0, "w1", 0.25, 0.0), ("A", 1, "w2", -0.125, 0.25), ("A", 2, "w3", 0.0, -0.25)])
    links = rows(spark, "area string, a int, b int, dx double, dy double", [("A", 0, 1, -0.375, 0.25)])
    m = layout.area_matches(t, a, s, links, KEY)
    return m.select("page", "anchor_id", r9("x"), r9("y"), "matched", "edges", r9("confidence"))


@query(BOXES + """, k AS (SELECT page, id, id % 4 AS category, 'word ' || (id % 13) AS keyword, x, y, w, h FROM r),
q AS (SELECT page, i AS field, i AS category, 'word ' || i AS text FROM (SELECT DISTINCT page FROM r), range(4) g(i)),
p AS (SELECT q.page, field, k.id, x + 0.0625::DOUBLE AS px, y + 0.03125::DOUBLE AS py, greatest(0, w + 0.03125::DOUBLE) AS pw, greatest(0, h - 0.0625::DOUBLE) AS ph, 1 - levenshtein(text, keyword) / greatest(length(text), length(keyword))::DOUBLE AS alike FROM q JOIN k USING (page, category)),
d AS (SELECT *, CASE WHEN field = 3 THEN 0 ELSE sqrt((px + pw / 2 - 0.5) * (px + pw / 2 - 0.5) + (py + ph / 2 - 0.5) * (py + ph / 2 - 0.5)) END AS d, CASE WHEN field = 3 THEN pw ELSE 0.125::DOUBLE END AS rw FROM p),
s AS (SELECT *, (1 - least(1, d / 0.35)) * 0.7 + alike * 0.25 + (1 - least(1, abs(pw - rw) / rw)) * 0.05 AS score FROM d WHERE d <= 0.35)
SELECT page, field, id, round(d, 9)::DOUBLE AS distance, round(score, 9)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY page, field ORDER BY score DESC, id) AS n FROM s) WHERE n = 1""")
def keyword_choice(spark, sf_dir):
    b = boxes(spark, sf_dir)
    index = b.select("page", "id", (F.col("id") % 4).cast("int").alias("category"), F.concat(F.lit("word "), (F.col("id") % 13).cast("string")).alias("keyword"), *"xywh")
    box = [0.4375, 0.4375, 0.125, 0.125]
    f = rows(spark, "field long, category int, text string, dx double, dy double, dw double, dh double, rx double, ry double, rw double, rh double",
             [(i, i, f"word {i}", 0.0625, 0.03125, 0.03125, -0.0625, *(box if i < 3 else [None] * 4)) for i in range(4)])
    m = layout.keyword_matches(b.select("page").distinct().crossJoin(f), index, KEY)
    return m.select("page", "field", "id", r9("distance"), r9("score"))


@query(PIXELS + """SELECT page, id AS source_id, id // 10 AS target_id, 'token_to_line' AS edge_type, 1.0::DOUBLE AS weight FROM t WHERE id % 7 <> 0
UNION ALL SELECT page, id, id // 100, 'line_to_block', 1.0 FROM t
UNION ALL SELECT a.page, a.id, b.id, 'line_horizontal_neighbor', round(1 - abs((a.x + a.w / 2) - (b.x + b.w / 2)) / 400, 9) FROM t a JOIN t b ON a.page = b.page AND a.id < b.id AND abs((a.y + a.h / 2) - (b.y + b.h / 2)) < 20 AND abs((a.x + a.w / 2) - (b.x + b.w / 2)) < 400""")
def text_graph(spark, sf_dir):
    t = pixels(spark, sf_dir)
    tokens = t.select("page", "id", F.when(F.col("id") % 7 != 0, F.floor(F.col("id") / 10)).alias("line_id"))
    lines = t.withColumn("block_id", F.floor(F.col("id") / 100))
    return layout.text_edges(tokens, lines, KEY).withColumn("weight", half_up(F.col("weight"), 9))


@query(PIXELS + """, q AS (SELECT s_nationkey AS page, s_suppkey AS rid, (s_suppkey * 53 % 800)::DOUBLE AS cx, (s_suppkey * 91 % 800)::DOUBLE AS cy FROM supplier),
p AS (SELECT t.page, t.id, rid, sqrt((x + w / 2 - cx) * (x + w / 2 - cx) + (y + h / 2 - cy) * (y + h / 2 - cy)) AS d FROM t JOIN q USING (page)),
m AS (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY d, rid) AS n FROM p) SELECT t.page, t.id, rid AS region_id, round(d, 9) AS distance FROM t LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (page, id)""")
def nearest_regions(spark, sf_dir):
    k = F.col("s_suppkey")
    q = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), k.alias("id"), (k * 53 % 800).cast("double").alias("x"), (k * 91 % 800).cast("double").alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    return layout.nearest_regions(pixels(spark, sf_dir), q, KEY, 100.0).select("page", "id", "region_id", r9("distance"))


REGIONS = """, q AS (SELECT s_nationkey AS page, s_suppkey AS rid, (s_suppkey * 53 % 700)::DOUBLE AS rx, (s_suppkey * 91 % 700)::DOUBLE AS ry, (50 + s_suppkey * 13 % 150)::DOUBLE AS rw, (50 + s_suppkey * 17 % 150)::DOUBLE AS rh FROM supplier)
"""


@query(PIXELS + REGIONS + """, p AS (SELECT t.page, t.id, rid, rx, ry, rw, rh, x + w / 2 AS cx, y + h / 2 AS cy, greatest(0, least(x + w, rx + rw) - greatest(x, rx)) * greatest(0, least(y + h, ry + rh) - greatest(y, ry)) > 0 AS over_ FROM t JOIN q USING (page)),
s AS (SELECT *, cx BETWEEN rx AND rx + rw AND cy BETWEEN ry AND ry + rh AS around, abs(cx - rx - rw / 2) + abs(cy - ry - rh / 2) AS far FROM p),
m AS (SELECT *, count(*) FILTER (WHERE over_) OVER (PARTITION BY page, id) AS members, row_number() OVER (PARTITION BY page, id ORDER BY around DESC, CASE WHEN around THEN rw * rh ELSE far END, rid) AS n FROM s)
SELECT t.page, t.id, rid AS region_id, coalesce(around, false) AS contained, coalesce(members, 0) AS members, CASE WHEN rid IS NOT NULL THEN round(greatest(0, least(1, (cx - rx) / rw)), 9) END::DOUBLE AS rx, CASE WHEN rid IS NOT NULL THEN round(greatest(0, least(1, (cy - ry) / rh)), 9) END::DOUBLE AS ry FROM t LEFT JOIN (SELECT * FROM m WHERE n = 1) m ON t.page = m.page AND t.id = m.id""")
def located_boxes(spark, sf_dir):
    k = F.col("s_suppkey")
    num = lambda c, name: c.cast("double").alias(name)
    q = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), k.alias("id"), num(k * 53 % 700, "x"), num(k * 91 % 700, "y"), num(50 + k * 13 % 150, "w"), num(50 + k * 17 % 150, "h"))
    found = layout.located(pixels(spark, sf_dir), q.withColumn("share", F.col("w") * F.col("h")), KEY, 100.0)
    return found.select("page", "id", "region_id", "contained", "members", r9("rx"), r9("ry"))


CELLS = """WITH pg AS (SELECT n_nationkey AS page FROM nation), s AS (SELECT s_nationkey AS page, s_suppkey AS k FROM supplier),
ys AS (SELECT page, (k * 97 % 40 * 20)::DOUBLE AS v FROM s UNION SELECT page, 0 FROM pg UNION SELECT page, 800 FROM pg), xs AS (SELECT page, (k * 61 % 20 * 40)::DOUBLE AS v FROM s UNION SELECT page, 0 FROM pg UNION SELECT page, 800 FROM pg),
yr AS (SELECT page, v AS y, lead(v) OVER o - v AS h, (row_number() OVER o - 1)::INT AS "row" FROM ys WINDOW o AS (PARTITION BY page ORDER BY v)), xr AS (SELECT page, v AS x, lead(v) OVER o - v AS w, (row_number() OVER o - 1)::INT AS col FROM xs WINDOW o AS (PARTITION BY page ORDER BY v)),
c AS (SELECT page, "row", col, x, y, w, h FROM yr JOIN xr USING (page) WHERE w >= 5 AND h >= 5 AND w * h >= 800 * 800 * 0.005)
"""


def pages_and_bounds(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "page")
    pages = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("page"), F.lit(800.0).alias("width"), F.lit(800.0).alias("height"))
    ys, xs = (k * 97 % 40 * 20).cast("double"), (k * 61 % 20 * 40).cast("double")
    return pages, s.select("page", ys.alias("y"), (k % 3 * 100).cast("double").alias("x1"), F.lit(800.0).alias("x2")), s.select("page", xs.alias("x"), F.lit(0.0).alias("y1"), (400 + k % 5 * 100).cast("double").alias("y2"))


@query(CELLS + "SELECT * FROM c")
def grid_cells(spark, sf_dir):
    pages, h, v = pages_and_bounds(spark, sf_dir)
    return layout.grid_cells(pages, h, v, KEY)


@query(CELLS.replace("WITH pg", "WITH RECURSIVE pg") + """, hl AS (SELECT page, (k * 97 % 40 * 20)::DOUBLE AS y, (k % 3 * 100)::DOUBLE AS x1, 800.0::DOUBLE AS x2 FROM s), vl AS (SELECT page, (k * 61 % 20 * 40)::DOUBLE AS x, 0.0::DOUBLE AS y1, (400 + k % 5 * 100)::DOUBLE AS y2 FROM s),
n AS (SELECT *, "row" * 1000 + col AS node FROM c),
e0 AS (SELECT a.page, a.node AS a, b.node AS b FROM n a JOIN n b ON a.page = b.page AND b."row" = a."row" + 1 AND a.col = b.col WHERE NOT EXISTS (SELECT 1 FROM hl WHERE hl.page = a.page AND abs(hl.y - a.y - a.h) <= 3 AND x1 <= a.x + 5 AND x2 >= a.x + a.w - 5)
 UNION ALL SELECT a.page, a.node, b.node FROM n a JOIN n b ON a.page = b.page AND b.col = a.col + 1 AND a."row" = b."row" WHERE NOT EXISTS (SELECT 1 FROM vl WHERE vl.page = a.page AND abs(vl.x - a.x - a.w) <= 3 AND y1 <= a.y + 5 AND y2 >= a.y + a.h - 5)),
e AS (SELECT page, a, b FROM e0 UNION ALL SELECT page, b, a FROM e0),
reach AS (SELECT page, node, node AS other FROM n UNION SELECT reach.page, node, b FROM reach JOIN e ON e.page = reach.page AND e.a = reach.other),
g AS (SELECT page, node, min(other) AS root FROM reach GROUP BY 1, 2),
b AS (SELECT n.page, root, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, count(*) AS cells FROM n JOIN g ON n.page = g.page AND n.node = g.node GROUP BY 1, 2)
SELECT page, x, y, w, h, cells FROM b WHERE w * h / 640000 BETWEEN 0.008 AND 0.9""")
def merged_cells(spark, sf_dir):
    pages, h, v = pages_and_bounds(spark, sf_dir)
    return layout.merged_cells(layout.grid_cells(pages, h, v, KEY), h, v, pages, KEY)


@query("""WITH e AS (SELECT user_id % 20 AS page, event_id, user_id AS s, event_id % 37 AS t, event_type FROM events), n AS (SELECT DISTINCT user_id % 20 AS page, user_id AS candidate, node FROM events, LATERAL (SELECT unnest([user_id, event_id % 37]) AS node)),
h AS (SELECT DISTINCT n.page, candidate, event_id, event_type FROM n JOIN e ON n.page = e.page AND (n.node = s OR n.node = t)), k AS (SELECT page, candidate, count(*) AS nodes FROM n GROUP BY 1, 2),
c AS (SELECT page, candidate, count(*) AS edges, count(*) FILTER (WHERE event_type = 'view') / count(*)::DOUBLE AS views FROM h GROUP BY 1, 2), d AS (SELECT k.*, coalesce(edges, 0) AS edges, coalesce(views, 0) AS views, coalesce(edges, 0) / nodes::DOUBLE AS dens FROM k LEFT JOIN c USING (page, candidate))
SELECT page, candidate, nodes AS node_count, edges AS edge_count, round(dens, 9) AS edge_density, round(least(views, 0.5) * 0.7 + greatest(0, 1 - abs(dens - 2) / greatest(2, dens)) * 0.3, 9)::DOUBLE AS similarity FROM d""")
def graph_profiles(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    ev = table(spark, sf_dir, "events").withColumn("page", u % 20)
    edges = ev.select("page", e.alias("edge_id"), u.cast("long").alias("source_id"), (e % 37).cast("long").alias("target_id"), F.col("event_type").alias("edge_type"))
    nodes = ev.select("page", u.alias("candidate"), F.explode(F.array(u.cast("long"), (e % 37).cast("long"))).alias("node"))
    p = layout.graph_profiles(nodes, edges, KEY)
    own = F.struct(F.create_map(F.lit("view"), F.lit(0.5), F.lit("none"), F.lit(0.5)).alias("edge_types"), F.lit(2.0).alias("edge_density"))
    like = layout.profile_similarity(own, F.struct("edge_types", "edge_density"))
    return p.select("page", "candidate", "node_count", "edge_count", r9("edge_density"), F.round(like, 9).alias("similarity"))


@query(PIXELS + """SELECT page, id, round(least(1, greatest(0, 1 - abs(w - 40) / greatest(1, w, 40)) * 0.25 + greatest(0, 1 - abs(h - 30) / greatest(1, h, 30)) * 0.25 + greatest(0, 1 - abs(w / h - 4.0 / 3::DOUBLE) / greatest(1, w / h, 4.0 / 3::DOUBLE)) * 0.2
 + greatest(0, 1 - sqrt(((x + w / 2 - 420) / 800) * ((x + w / 2 - 420) / 800) + ((y + h / 2 - 315) / 800) * ((y + h / 2 - 315) / 800))) * 0.3), 6)::DOUBLE AS geometry,
 round(greatest(0, 1 - sqrt((x + w / 2 - 420) * (x + w / 2 - 420) + (y + h / 2 - 315) * (y + h / 2 - 315)) / sqrt(1280000)), 9)::DOUBLE AS nearness,
 CASE WHEN id % 9 = 0 THEN 0.5 ELSE round(1 - least(abs(id % 360 - 350), 360 - abs(id % 360 - 350)) / 180.0::DOUBLE, 9) END::DOUBLE AS direction FROM t""")
def layout_signals(spark, sf_dir):
    a, b = F.struct(*"xywh"), F.struct(*(F.lit(v).alias(k) for k, v in zip("xywh", (400.0, 300.0, 40.0, 30.0))))
    page, angle = F.lit(800.0), F.when(F.col("id") % 9 != 0, (F.col("id") - 720).cast("double"))
    parts = {"geometry": F.round(layout.geometry_similarity(a, b, page, page), 6), "nearness": F.round(layout.distance_signal(a, b, page, page), 9), "direction": F.round(layout.orientation_signal(angle, F.lit(-10.0)), 9)}
    return pixels(spark, sf_dir).select("page", "id", *(v.alias(k) for k, v in parts.items()))


@query(PIXELS + """, s AS (SELECT a.page, a.id, a.x + a.w / 2 AS cx, a.y + a.h / 2 AS cy, a.w, a.h, b.x + b.w / 2 AS sx, b.y + b.h / 2 AS sy, row_number() OVER (PARTITION BY a.page, a.id ORDER BY b.id) AS n FROM t a JOIN t b ON a.page = b.page AND a.id <> b.id AND a.id % 6 = b.id % 6),
g AS (SELECT page, id, count(*) FILTER (WHERE abs(sy - cy) <= greatest(8, h)) / count(*)::DOUBLE AS r, count(*) FILTER (WHERE abs(sx - cx) <= greatest(20, w * 0.25)) / count(*)::DOUBLE AS c FROM s WHERE n <= 10 GROUP BY 1, 2)
SELECT t.page, t.id AS line_id, coalesce(r, 0)::DOUBLE AS row_tendency, coalesce(c, 0)::DOUBLE AS column_tendency FROM t LEFT JOIN g USING (page, id)""")
def line_tendencies(spark, sf_dir):
    t = pixels(spark, sf_dir)
    return layout.tendencies(t, layout.first_siblings(t.withColumn("b", F.col("id") % 6), KEY, "b"), KEY)


@query(PIXELS + "SELECT page, count(*) AS lines, round(min(h), 9) AS min_height, round(max(h), 9) AS max_height, round(median(h), 9) AS median_height FROM t GROUP BY page")
def line_metrics(spark, sf_dir):
    return layout.line_metrics(pixels(spark, sf_dir), KEY).select("page", "lines", *(r9(f"{k}_height") for k in ("min", "max", "median")))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 < 3 THEN 'c' || (o_custkey % 4) END AS chosen, o_orderstatus || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ',f' END AS guards, o_orderstatus IN ('F', 'O') AS kept
FROM (SELECT o_orderkey, o_custkey, lower(o_orderstatus) AS o_orderstatus0, o_orderstatus FROM orders)""".replace("o_orderstatus || CASE", "lower(o_orderstatus) || CASE"))
def word_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    found = F.array(*(F.struct(F.lit(k).alias("id"), F.lit(f"c{k}").alias("text")) for k in range(3)))
    guards = layout.guard_words(F.array(F.concat(F.lit(" "), "o_orderstatus"), F.lit(""), F.lit("--"), F.lit("F"), F.lower("o_orderstatus")))
    kept = layout.wanted(F.col("o_orderstatus"), ["F", "O"])
    return o.select("o_orderkey", layout.candidate_text(found, (F.col("o_custkey") % 4).cast("int")).alias("chosen"), F.array_join(guards, ",").alias("guards"), kept.alias("kept"))


#: Documents of the summaries: a page per nation and one without regions, boxes as regions, an edge from each to the next.
DOCS = PIXELS + """, d AS (SELECT n_nationkey::BIGINT AS doc_id, 800.0::DOUBLE AS width, CASE WHEN n_nationkey = 24 THEN 0 ELSE 800 END::DOUBLE AS height, (40 + n_nationkey % 4)::BIGINT AS line_count, (9 + n_nationkey % 3)::BIGINT AS block_count, (400 + n_nationkey)::BIGINT AS token_count FROM nation UNION ALL SELECT 99, 800, 800, 1, 1, 1),
g AS (SELECT t.page::BIGINT AS doc_id, id, least(1, x / width) AS nx, least(1, y / h0) AS ny, least(1, w / width) AS nw, least(1, h / h0) AS nh, least(1, w * h / (width * h0)) AS area, w / h AS aspect, (id % 10) / 10.0::DOUBLE AS confidence, (id % 4) / 4.0::DOUBLE AS density, CASE WHEN id % 5 = 0 THEN 'unknown' ELSE 's' || (id % 3) END AS surface,
  least(1, (x + w / 2) / width) AS cx, least(1, (y + h / 2) / h0) AS cy FROM t JOIN (SELECT *, CASE WHEN height = 0 THEN 1 ELSE height END AS h0 FROM d) d ON t.page = d.doc_id),
q AS (SELECT *, (least(3, floor(cy * 4)) * 4 + least(3, floor(cx * 4)))::INT AS cell FROM g),
e0 AS (SELECT page::BIGINT AS doc_id, id AS s, lead(id) OVER (PARTITION BY page ORDER BY id) AS t, CASE id % 4 WHEN 0 THEN 'contains' WHEN 1 THEN 'spatial_adjacency' ELSE 'spatial_proximity' END AS kind, (id % 8) / 8.0::DOUBLE AS weight FROM r), e AS (SELECT * FROM e0 WHERE t IS NOT NULL),
m AS (SELECT d.*, coalesce(rc, 0) AS region_count, coalesce(aa, 0) AS avg_area, coalesce(ad, 0) AS avg_density, coalesce(ec, 0) AS edge_count, coalesce(ew, 0) AS avg_weight, coalesce(p0, 0) AS p0, coalesce(p1, 0) AS p1, coalesce(p2, 0) AS p2,
  CASE WHEN NOT (width > 1 AND height > 1) THEN 'no viewport' WHEN rc IS NULL THEN 'no regions' ELSE '' END AS reason FROM d LEFT JOIN (SELECT doc_id, count(*) AS rc, avg(area) AS aa, avg(density) AS ad FROM q GROUP BY 1) USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS ec, avg(weight) AS ew, avg((kind = 'spatial_proximity')::INT) AS p0, avg((kind = 'contains')::INT) AS p1, avg((kind = 'spatial_adjacency')::INT) AS p2 FROM e GROUP BY 1) USING (doc_id))
"""


def documents(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, k = pixels(spark, sf_dir), F.col("id")
    regions = t.select(F.col("page").cast("long").alias("doc_id"), k.alias("region_id"), *"xywh", (k % 10 / 10.0).alias("confidence"), (k % 4 / 4.0).alias("density"), F.when(k % 5 != 0, F.concat(F.lit("s"), (k % 3).cast("string"))).alias("surface"))
    n = F.col("n_nationkey").cast("long")
    size = F.when(n == 24, 0.0).otherwise(800.0)
    d = table(spark, sf_dir, "nation").select(n.alias("doc_id"), F.lit(800.0).alias("width"), size.alias("height"), (40 + n % 4).alias("line_count"), (9 + n % 3).alias("block_count"), (400 + n).alias("token_count"))
    d = d.unionByName(spark.range(99, 100).select(F.col("id").alias("doc_id"), F.lit(800.0).alias("width"), F.lit(800.0).alias("height"), *(F.lit(1).cast("long").alias(f"{c}_count") for c in ("line", "block", "token"))))
    kind = F.when(k % 4 == 0, "contains").when(k % 4 == 1, "spatial_adjacency").otherwise("spatial_proximity")
    e = t.select(F.col("page").cast("long").alias("doc_id"), k.alias("source_id"), F.lead("id").over(Window.partitionBy("page").orderBy("id")).alias("target_id"), kind.alias("edge_type"), (k % 8 / 8.0).alias("weight"))
    return d, summary.region_descriptors(regions, d), e.where("target_id is not null")


@query(DOCS + """SELECT doc_id, reason, region_count, round(avg_area, 9)::DOUBLE AS avg_area, round(avg_density, 9)::DOUBLE AS avg_density, edge_count, round(avg_weight, 9)::DOUBLE AS avg_weight, round(p0, 9)::DOUBLE AS proximity, round(p1, 9)::DOUBLE AS contains,
 (SELECT count(DISTINCT surface) FROM q WHERE q.doc_id = m.doc_id) AS surfaces, round(coalesce((SELECT sum(area) FILTER (WHERE cell = 5) / sum(area) FROM q WHERE q.doc_id = m.doc_id), 0), 9)::DOUBLE AS cell5 FROM m""")
def document_summaries(spark, sf_dir):
    s = summary.summaries(*documents(spark, sf_dir))
    kinds = F.coalesce(F.cardinality("surfaces"), F.lit(0)).cast("long")
    return s.select("doc_id", "reason", "region_count", r9("avg_area"), r9("avg_density"), "edge_count", r9("avg_weight"), F.round(F.col("edge_types")[0], 9).alias("proximity"), F.round(F.col("edge_types")[1], 9).alias("contains"), kinds.alias("surfaces"), F.round(F.col("distribution")[5], 9).alias("cell5"))


@query(DOCS + """, z AS (SELECT doc_id, s AS id, t AS other, kind, weight FROM e UNION ALL SELECT doc_id, t, s, kind, weight FROM e),
n AS (SELECT z.doc_id, z.id, count(*) AS nb, avg(weight) AS ew, count(*) FILTER (WHERE kind = 'spatial_adjacency') AS adj, count(*) FILTER (WHERE kind = 'contains' AND b.area > a.area) AS depth FROM z JOIN q a ON a.doc_id = z.doc_id AND a.id = z.id LEFT JOIN q b ON b.doc_id = z.doc_id AND b.id = z.other GROUP BY 1, 2)
SELECT doc_id, id AS region_id, cell, 14::INT AS parts, round(nx + 2 * ny + 3 * nw + 4 * nh + 5 * area + 6 * least(10, aspect) + 7 * confidence + 8 * density + 9 * coalesce(nb, 0) / 10.0::DOUBLE + 10 * coalesce(ew, 0) + 11 * coalesce(adj, 0) / 10.0::DOUBLE + 12 * coalesce(depth, 0) / 5.0::DOUBLE + 13 + 14, 6)::DOUBLE AS checksum FROM q LEFT JOIN n USING (doc_id, id)""")
def region_signatures(spark, sf_dir):
    _, regions, e = documents(spark, sf_dir)
    s = summary.signatures(regions, summary.neighbourhoods(regions, e))
    check = F.aggregate(F.zip_with("vector", F.sequence(F.lit(1), F.size("vector")), lambda v, k: v * k), F.lit(0.0), lambda a, x: a + x)
    return s.select("doc_id", "region_id", "cell", F.size("vector").alias("parts"), F.round(check, 6).alias("checksum"))


def _robust(c: str) -> str:
    return f"""(SELECT greatest(0, least(1, 1 - stddev_samp({c}) / avg({c}))) FROM v, (SELECT list_sort(list({c}))[(floor(count(*) * 0.25) + 1)::INT] AS a, list_sort(list({c}))[(floor(count(*) * 0.75) + 1)::INT] AS b FROM v) WHERE {c} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))"""


@query(DOCS + f""", v AS (SELECT * FROM m WHERE reason = ''), j AS (SELECT doc_id, round(p0 * 100) / 100 AS a, round(p1 * 100) / 100 AS b, 1 - round(p0 * 100) / 100 - round(p1 * 100) / 100 AS c FROM v),
pr AS (SELECT [x.a, x.b, x.c] AS p, [y.a, y.b, y.c] AS q FROM j x JOIN j y ON x.doc_id < y.doc_id),
dv AS (SELECT avg((SELECT sum(CASE WHEN p[i] > 1e-9 THEN 0.5 * p[i] * log2(2 * p[i] / (p[i] + q[i])) ELSE 0 END + CASE WHEN q[i] > 1e-9 THEN 0.5 * q[i] * log2(2 * q[i] / (p[i] + q[i])) ELSE 0 END) FROM range(1, 4) g(i))) AS d FROM pr),
cs AS (SELECT doc_id, cell AS dim, sum(area) AS x FROM q GROUP BY 1, 2), cu AS (SELECT doc_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS u FROM cs WHERE doc_id IN (SELECT doc_id FROM v)),
ss AS (SELECT doc_id, surface AS dim, count(*) AS x FROM q GROUP BY 1, 2), su AS (SELECT doc_id, dim, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS u FROM ss WHERE doc_id IN (SELECT doc_id FROM v)),
k AS (SELECT count(*) AS n FROM v)
SELECT 'region_count' AS metric, round({_robust('region_count')}, 6)::DOUBLE AS stability UNION ALL SELECT 'region_area', round({_robust('avg_area')}, 6)::DOUBLE UNION ALL SELECT 'region_density', round({_robust('avg_density')}, 6)::DOUBLE
UNION ALL SELECT 'adjacency_graph', round(0.4 * {_robust('edge_count')} + 0.35 * (1 - (SELECT d FROM dv)) + 0.25 * {_robust('avg_weight')}, 3)::DOUBLE
UNION ALL SELECT 'text_structure', round(0.35 * {_robust('line_count')} + 0.35 * {_robust('block_count')} + 0.3 * {_robust('token_count')}, 3)::DOUBLE
UNION ALL SELECT 'spatial_distribution', round((SELECT sum(s2 - q2) / 2 FROM (SELECT sum(u) * sum(u) AS s2, sum(u * u) AS q2 FROM cu GROUP BY dim)) / (SELECT n * (n - 1) / 2 FROM k), 3)::DOUBLE
UNION ALL SELECT 'surface_type', round((SELECT sum(s2 - q2) / 2 FROM (SELECT sum(u) * sum(u) AS s2, sum(u * u) AS q2 FROM su GROUP BY dim)) / (SELECT n * (n - 1) / 2 FROM k), 3)::DOUBLE""")
def stability_metrics(spark, sf_dir):
    return summary.stability(summary.summaries(*documents(spark, sf_dir))).select("metric", F.round("stability", 6).alias("stability"))


@query(PIXELS + """, g AS (SELECT *, sum(new_) OVER (PARTITION BY page ORDER BY c, id ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, CASE WHEN c - lag(c) OVER (PARTITION BY page ORDER BY c, id) > 8 THEN 1 ELSE 0 END AS new_ FROM (SELECT *, y + h / 2 AS c FROM t))),
m AS (SELECT page, grp, median(h) AS mh, median(w) AS mw FROM g GROUP BY 1, 2), k AS (SELECT g.page, g.grp, count(*) AS members, arg_min(id, (x, id)) AS first, arg_max(id, (x, id)) AS last, any_value(mh) AS mh, any_value(mw) AS mw, bool_and(abs(h - mh) / greatest(1, mh) < 0.3) AS lh, bool_and(abs(w - mw) / greatest(1, mw) < 0.3) AS lw FROM g JOIN m ON g.page = m.page AND g.grp = m.grp GROUP BY 1, 2)
SELECT page, CAST(grp AS BIGINT) AS grp, members, first, last, round(mh, 9) AS cross_, round(CASE WHEN lw THEN mw END, 9) AS along FROM k WHERE members >= 3 AND lh""")
def aligned_groups(spark, sf_dir):
    return layout.aligned_groups(pixels(spark, sf_dir), KEY).select("page", "grp", "members", "first", "last", F.round("cross", 9).alias("cross_"), r9("along"))


@query("""WITH l AS (SELECT s_nationkey AS page, (s_suppkey * 97 % 800)::DOUBLE AS y, (s_suppkey % 3 * 100)::DOUBLE AS x1, (500 + s_suppkey % 4 * 100)::DOUBLE AS x2 FROM supplier),
b AS (SELECT *, sum(new_) OVER (PARTITION BY page ORDER BY y, x1, x2 ROWS UNBOUNDED PRECEDING) AS band FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, x1, x2) > 16 THEN 1 ELSE 0 END AS new_ FROM l))
SELECT page, CAST(band AS BIGINT) AS band, count(*) AS lines, round(avg(y), 9) AS y, min(y) AS y1, max(y) AS y2, (max(x2) - min(x1)) / 800 AS span, (max(x2) - min(x1)) / 800 >= 0.75 AS separator FROM b GROUP BY 1, 2""")
def line_bands(spark, sf_dir):
    pages, _, _ = pages_and_bounds(spark, sf_dir)
    k = F.col("s_suppkey")
    l = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("page"), (k * 97 % 800).cast("double").alias("y"), (k % 3 * 100).cast("double").alias("x1"), (500 + k % 4 * 100).cast("double").alias("x2"))
    return layout.line_bands(l, pages, KEY, 0.75).select("page", "band", "lines", r9("y"), "y1", "y2", "span", "separator")
