"""Column functions, learning and matching over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, geometry, numeric, stats, text
from ..operators import batchstats, dedupe, eventlog, learn, matching, search, spatial, tabular
from .layout_queries import PIXELS, pixels, r9, rows
from .spatial_queries import BOXES, boxes
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


@query(PIXELS + """, c AS (SELECT *, (x + w / 2 - 400) * 0.5 AS dx, (y + h / 2 - 400) * 0.5 AS dy, radians(id % 360) AS a, 1 + id % 3 AS ta, 0.5::DOUBLE AS tb, (id % 5) / 4.0::DOUBLE AS tc, 2.0::DOUBLE AS td FROM t)
SELECT id, x < 600 AND 200 < x + w AND y < 600 AND 200 < y + h AS meets, round(greatest(x - 20, 0) + (w + 40) * 3, 6) AS expanded, round(x + 400 * 2 + (y + 100 * 2) * 3, 6) AS placed,
 round(2 * x + 0.5 * y + 8, 6) AS moved_x, round(-0.25 * (x + w) + 1.5 * y + 4, 6) AS moved_y, round(2 * w + 0.5 * h, 6) AS moved_w, round(0.25 * w + 1.5 * h, 6) AS moved_h,
 round(400 + dx * cos(a) - dy * sin(a) - w * 0.25, 6) AS turned_x, round(400 + dx * sin(a) + dy * cos(a) - h * 0.25, 6) AS turned_y,
 round(sqrt(ta * ta + tc * tc), 9) AS scale_x, round((ta * td - tb * tc) / sqrt(ta * ta + tc * tc), 9) AS scale_y, round(degrees(atan2(tc, ta)), 9) AS rotation, round((ta * tb + tc * td) / (ta * ta + tc * tc), 9) AS skew FROM c""")
def geometry_functions(spark, sf_dir):
    b, k = F.struct(*"xywh"), F.col("id")
    fixed = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for n, x in zip("xywh", v)))
    wide, put = geometry.expanded(b, F.lit(20.0)), geometry.from_anchor(b, fixed(400, 100, 10, 10), F.lit(2.0))
    move = geometry.transformed(F.struct(*(F.lit(v).alias(n) for n, v in {"a": 2.0, "b": 0.5, "c": -0.25, "d": 1.5, "tx": 8.0, "ty": 4.0}.items())), b)
    turn = geometry.scaled_rotated(b, F.lit(0.5), (k % 360).cast("double"), F.lit(800.0), F.lit(800.0))
    parts = geometry.decomposed(F.struct((1 + k % 3).cast("double").alias("a"), F.lit(0.5).alias("b"), (k % 5 / 4.0).alias("c"), F.lit(2.0).alias("d")))
    six = lambda c, n: F.round(c, 6).alias(n)
    return pixels(spark, sf_dir).select(
        "id", geometry.intersects(b, fixed(200, 200, 400, 400)).alias("meets"), six(wide["x"] + wide["w"] * 3, "expanded"), six(put["x"] + put["y"] * 3, "placed"),
        *(six(move[c], f"moved_{c}") for c in "xywh"), six(turn["x"], "turned_x"), six(turn["y"], "turned_y"), *(F.round(parts[n], 9).alias(n) for n in ("scale_x", "scale_y", "rotation", "skew")),
    )


@query("""WITH e AS (SELECT event_id AS id, CAST(floor(value * 100 + 0.5) AS BIGINT) AS c FROM events), s AS (SELECT *, (c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS money, lpad((id % 10000)::VARCHAR, 4, '0') AS code, 2000 + id % 30 || '-0' || (1 + id % 9) || '-1' || (id % 10) AS day FROM e),
l AS (SELECT *, CASE WHEN id % 2 = 0 THEN 0 ELSE length(regexp_replace(substr(code, 1, 2), '[^234689]', '', 'g')) END AS bad, length(regexp_replace(CASE WHEN id % 2 = 0 THEN code ELSE substr(code, 3) END, '[^234689]', '', 'g')) AS good FROM s)
SELECT id, CASE WHEN id % 4 = 0 THEN '-' || money ELSE money END AS number, day, id % 3 = 0 AS dated, CASE id % 5 WHEN 0 THEN CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END WHEN 1 THEN 1 WHEN 4 THEN 0.4 ELSE CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END END::DOUBLE AS fit,
 money AS value, 'pay ' || money AS last2, good::INT AS support, bad::INT AS conflicts, good + bad >= 2 AND good >= 0.8 * (good + bad) AND bad < 2 AS ok FROM l""")
def ocr_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("c"))
    k = F.col("id")
    money = F.concat(F.floor(F.col("c") / 100).cast("string"), F.lit("."), F.lpad((F.col("c") % 100).cast("string"), 2, "0"))
    day = F.concat((2000 + k % 30).cast("string"), F.lit("-0"), (1 + k % 9).cast("string"), F.lit("-1"), (k % 10).cast("string"))
    e = e.withColumns({"money": money, "day": day, "code": F.lpad((k % 10000).cast("string"), 4, "0")})
    read = F.translate("money", "012", "OIZ")
    read = F.when(k % 4 == 0, F.concat(F.lit("("), read, F.lit(")"))).otherwise(F.concat(F.lit("amt "), read))
    some = F.when(k % 3 == 0, F.col("day")).otherwise(F.col("money"))
    kind = F.element_at(F.array(*(F.lit(v) for v in ("invoice_date", "tax_total", "invoice_number", "quantity", "store"))), (k % 5 + 1).cast("int"))
    sure = text.layout_confidence(F.col("code"), F.when(k % 2 == 0, "NNNN").otherwise("LLNN"))
    return e.select(
        "id", numeric.ocr_number(read).alias("number"), dates.ocr_date(F.concat(F.translate("day", "01", "OI"), F.lit(" "))).alias("day"), dates.looks_date(some).alias("dated"), numeric.format_score(kind, some).alias("fit"),
        text.value_after_label(F.concat(F.lit(" Total: "), "money")).alias("value"), text.segments(F.concat(F.lit("to pay  "), "money"))["last2"].alias("last2"), sure["support"].alias("support"), sure["conflicts"].alias("conflicts"), sure["ok"].alias("ok"),
    )


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN 'date' WHEN l_linenumber % 3 = 1 THEN 'numeric' ELSE CASE WHEN l_partkey % 2 = 0 THEN 'text' ELSE 'any' END END AS hint, CAST(l_quantity AS BIGINT)::VARCHAR AS quantity, (u // 100) || '.' || lpad((u % 100)::VARCHAR, 2, '0') AS price,
 CASE WHEN l_linenumber % 2 = 0 THEN '7.50' ELSE ((u * q) // 100) || '.' || lpad(((u * q) % 100)::VARCHAR, 2, '0') END AS amount FROM (SELECT *, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS u FROM lineitem)""")
def typed_cells(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem").withColumns({"q": F.col("l_quantity").cast("long").cast("string"), "u": F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long"), "n": F.col("l_linenumber") % 3})
    shown = F.concat(F.lit("$ "), F.floor(F.col("u") / 100).cast("string"), F.lit("."), F.lpad((F.col("u") % 100).cast("string"), 2, "0"))
    q, p, a = numeric.consistent(F.concat("q", F.lit(" pcs")), shown, F.when(F.col("l_linenumber") % 2 == 0, "$7.5").otherwise("none"))
    magic = F.when((F.col("n") == 2) & (F.col("l_partkey") % 2 == 0), "Text")
    key = F.when(F.col("n") == 0, "due_date").when(F.col("n") == 1, "tax").otherwise("store")
    return item.select("l_orderkey", "l_linenumber", numeric.type_hint(magic, key).alias("hint"), q.alias("quantity"), p.alias("price"), a.alias("amount"))


@query("""WITH v AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events), l AS (SELECT user_id, list({n: n, c: value} ORDER BY n) AS vs FROM v GROUP BY user_id),
a AS (SELECT user_id, degrees(atan2(avg(sin(radians(value))), avg(cos(radians(value))))) AS angle FROM events GROUP BY 1)
SELECT user_id, round(list_reduce(vs, lambda s, x: {n: x.n, c: s.c + (x.c - s.c) / least(x.n, 10)}).c, 6) AS centre, round(angle, 6) AS angle, round(0.5 + user_id * 0.25, 9)::DOUBLE AS score FROM l JOIN a USING (user_id)""")
def running_profiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    values = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda r: r["value"])
    features = F.create_map(F.lit("a"), F.col("user_id").cast("double"), F.lit("b"), F.lit(7.0))
    score = learn.linear_score(features, F.create_map(F.lit("a"), F.lit(0.25), F.lit("c"), F.lit(9.0)), F.lit(0.5))
    g = e.groupBy("user_id").agg(values.alias("vs"), stats.circular_mean(F.col("value")).alias("angle"))
    return g.select("user_id", F.round(learn.moving_centroid(F.col("vs")), 6).alias("centre"), F.round("angle", 6).alias("angle"), F.round(score, 9).alias("score"))


@query("""WITH RECURSIVE d AS (SELECT value / 500 AS f1, (event_id % 7) / 7.0::DOUBLE AS f2, CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END::DOUBLE AS y FROM events),
s(step, w1, w2) AS (SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE UNION ALL SELECT any_value(step) + 1, any_value(w1) - 0.5 * avg((1 / (1 + exp(-(w1 * f1 + w2 * f2))) - y) * f1), any_value(w2) - 0.5 * avg((1 / (1 + exp(-(w1 * f1 + w2 * f2))) - y) * f2) FROM s, d WHERE step < 8 HAVING count(*) > 0)
SELECT event_id AS id, round(1 / (1 + exp(-(w1 * value / 500 + w2 * ((event_id % 7) / 7.0::DOUBLE)))), 7) AS p FROM events, s WHERE step = 8""")
def logistic_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") / 500).alias("f1"), (F.col("event_id") % 7 / 7.0).alias("f2"), (F.col("value") > 100).alias("y"))
    w = learn.fit_logistic(e, ["f1", "f2"], "y", 0.5, 8)
    return e.select("id", F.round(learn.logistic(w), 7).alias("p"))


@query("""WITH m AS (SELECT event_id % 50 AS ref, user_id AS doc, value / 500 AS s FROM events), d AS (SELECT count(DISTINCT user_id) AS n FROM events), a AS (SELECT ref, count(DISTINCT doc) AS docs, avg(s) AS s FROM m GROUP BY ref),
g AS (SELECT (event_id % 11) / 10.0::DOUBLE AS x FROM events)
SELECT 'anchor ' || ref AS name, round(docs / n::DOUBLE * s, 9) AS value FROM a, d WHERE docs >= 0.25 * n UNION ALL SELECT 'mean', round(avg(x), 9) FROM g UNION ALL SELECT 'cv', round(stddev_pop(x) / avg(x), 9) FROM g UNION ALL SELECT 'median', median(x) FROM g
UNION ALL SELECT 'bin' || k, count(x)::DOUBLE FROM range(5) b(k) LEFT JOIN g ON least(4, floor(x * 5 + 1e-12)) = k GROUP BY k
UNION ALL SELECT metric, place FROM (VALUES ('weak', 3.0::DOUBLE), ('fair', 1.0), ('good', 2.0)) v(metric, place)""")
def batch_reports(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = e.agg(F.count_distinct("user_id")).first()[0]
    a = batchstats.anchors(e.select((F.col("event_id") % 50).alias("ref_region"), F.col("user_id").alias("doc_id"), (F.col("value") / 500).alias("similarity")), n)
    a = a.select(F.concat(F.lit("anchor "), F.col("ref_region").cast("string")).alias("name"), F.round("confidence", 9).alias("value"))
    g = batchstats.graph_stats(e.select((F.col("event_id") % 11 / 10.0).alias("degree")))
    names = ["mean", "cv", "median", *(f"bin{k}" for k in range(5))]
    g = g.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.round(F.col(c).cast("double"), 9).alias("value")) for c in names))).alias("r")).select("r.*")
    d = batchstats.diagnoses(rows(spark, "metric string, stability double", [("weak", 0.2), ("fair", 0.6), ("good", 0.8), ("best", 0.9)]))
    return a.unionByName(g).unionByName(d.select(F.col("metric").alias("name"), F.col("place").cast("double").alias("value")))


@query(BOXES + """, s AS (SELECT page, id, 0.26 * (id % 3) / 2 + 0.2 * (id % 5) / 4 + 0.14 * (id % 2) AS score FROM r), k AS (SELECT * FROM s WHERE round(score, 9) >= 0.22), e AS (SELECT page, id AS a, lead(id) OVER (PARTITION BY page ORDER BY id) AS b FROM r)
SELECT page, count(*) AS nodes, any_value(n) AS edges FROM k JOIN (SELECT page, count(*) AS n FROM e WHERE b IS NOT NULL AND ((page, a) IN (SELECT page, id FROM k) OR (page, b) IN (SELECT page, id FROM k)) GROUP BY page) USING (page) GROUP BY page""")
def relevant_subgraphs(spark, sf_dir):
    from pyspark.sql import Window

    b, k = boxes(spark, sf_dir).select("page", "id"), F.col("id")
    signals = {c: F.lit(0.0) for c in matching.RELEVANCE} | {"overlap": k % 3 / 2, "distance": k % 5 / 4, "topology": (k % 2).cast("double")}
    scored = matching.relevance(b.select("page", "id", *(v.alias(c) for c, v in signals.items())))
    edges = b.select("page", k.alias("source_id"), F.lead("id").over(Window.partitionBy("page").orderBy("id")).alias("target_id")).where("target_id is not null")
    nodes, kept = matching.local_subgraph(b, edges, scored.where(F.round("score", 9) >= matching.RETAINED), ["page"])
    return nodes.groupBy("page").agg(F.count("*").alias("nodes")).join(kept.groupBy("page").agg(F.count("*").alias("edges")), "page")


@query(BOXES + """, c AS (SELECT *, 0.5::DOUBLE + (id % 5) / 10.0::DOUBLE AS c, 0.25::DOUBLE + (id % 3) / 4.0::DOUBLE AS l FROM r)
SELECT page, id, round(CASE WHEN c < 0.7 AND id % 4 <> 0 THEN (x * c + (x + 0.125) * l) / (c + l) ELSE x END, 9) AS x, CASE WHEN c < 0.7 AND id % 4 <> 0 THEN greatest(c, l) ELSE c END AS confidence, CASE WHEN c < 0.7 AND id % 4 <> 0 THEN 'blended' ELSE 'structure' END AS method,
 CASE WHEN c > 0.3 AND c < 0.8 THEN greatest(c, l) ELSE c END AS boosted, round(CASE WHEN id % 4 = 0 OR x > 0.35 THEN 1 ELSE least(greatest(1 + (0.6 * (1 - x / 0.35) + 0.2 * (w + h) - 0.5) * 0.4, 0.8), 1.2) END, 9)::DOUBLE AS weight FROM c""")
def blended_boxes(spark, sf_dir):
    k = F.col("id")
    b = boxes(spark, sf_dir).withColumn("confidence", 0.5 + k % 5 / 10.0)
    other = b.where(k % 4 != 0).select("page", "id", (F.col("x") + 0.125).alias("x"), "y", "w", "h", (0.25 + k % 3 / 4.0).alias("confidence"))
    both = matching.blended(b, other, ["page", "id"]).select("page", "id", r9("x"), "confidence", "method")
    near = F.when(k % 4 != 0, F.col("x"))
    extra = b.select("page", "id", matching.boosted(F.col("confidence"), 0.25 + k % 3 / 4.0).alias("boosted"), F.round(search.keyword_weight(near, F.col("w"), F.col("h")), 9).alias("weight"))
    return both.join(extra, ["page", "id"])


@query(BOXES + """, p AS (SELECT f.page, f.id AS field_id, m.id, sqrt((m.x - f.x) * (m.x - f.x) + (m.y - f.y) * (m.y - f.y)) AS d FROM r f JOIN r m ON f.page = m.page WHERE f.id <> m.id), n AS (SELECT *, row_number() OVER (PARTITION BY page, field_id ORDER BY d, id) AS k FROM p WHERE d <= 0.4)
SELECT page, field_id, count(*) AS landmarks, round(sum(d), 8) AS total FROM n WHERE k <= 10 GROUP BY 1, 2""")
def field_context(spark, sf_dir):
    b = boxes(spark, sf_dir)
    pairs = matching.context(b, b.select("page", "id", "x", "y"), ["page"], k=11).where("id <> field_id")
    ten = dedupe.first_by(pairs, ["page", "field_id"], ["distance", "id"], 10)
    return ten.groupBy("page", "field_id").agg(F.count("*").alias("landmarks"), F.round(F.sum("distance"), 8).alias("total"))


@query(BOXES + """, t AS (SELECT page, id, 'w' || (id % 4) AS norm, x + w / 2 AS cx, y + h / 2 AS cy FROM r), p AS (SELECT a.page, a.id AS anchor_id, s.idx, b.id, sqrt((b.cx - a.cx - s.dx) * (b.cx - a.cx - s.dx) + (b.cy - a.cy) * (b.cy - a.cy)) AS e
 FROM t a JOIN (VALUES (0, 'w1', 0.25::DOUBLE), (1, 'w2', -0.25::DOUBLE)) s(idx, norm, dx) ON a.norm = 'w0' JOIN t b ON b.page = a.page AND b.norm = s.norm WHERE abs(b.cx - a.cx - s.dx) <= 0.1 AND abs(b.cy - a.cy) <= 0.1),
n AS (SELECT *, row_number() OVER (PARTITION BY page, anchor_id, idx ORDER BY e, id) AS k FROM p) SELECT page, anchor_id, count(*) AS matched, round(sum(e), 9) AS total_error FROM n WHERE k = 1 GROUP BY 1, 2""")
def constellation_matches(spark, sf_dir):
    t = boxes(spark, sf_dir).withColumn("text", F.concat(F.lit("W"), (F.col("id") % 4).cast("string"), F.lit(":")))
    pattern = rows(spark, "pattern_id int, role string, idx int, norm_text string, dx double, dy double", [(1, "anchor", None, "w0", 0.0, 0.0), (1, "support", 0, "w1", 0.25, 0.0), (1, "support", 1, "w2", -0.25, 0.0)])
    return spatial.constellation(t, pattern, ["page"], 0.1).select("page", "anchor_id", "matched", r9("total_error"))


@query("""WITH c AS (SELECT user_id, event_id AS id, (event_id % 17) / 8.0::DOUBLE AS s, event_id % 13 = 0 AS cur, event_id % 3 = 0 AS fp, (event_id % 19) / 20.0::DOUBLE AS d, event_id % 4 AS ld FROM events WHERE user_id IS NOT NULL),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, cur ORDER BY id) AS k FROM c) WHERE NOT cur OR k = 1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, id) AS n FROM u) WHERE n = 1),
j AS (SELECT b.user_id, b.id AS best_id, r.id AS current_id, b.s, b.fp, b.d, b.ld, coalesce(r.s, 0) AS rs, coalesce(r.fp, false) AS rfp, coalesce(r.d, 0) AS rd FROM b LEFT JOIN (SELECT * FROM u WHERE cur) r USING (user_id))
SELECT user_id, best_id, current_id, best_id IS DISTINCT FROM current_id AND (s > 1.05 * rs OR (NOT rfp AND fp AND d > rd)) AND (ld <= 1 OR fp) AND s >= 0.5 AS prefer_best FROM j""")
def static_choice(spark, sf_dir):
    k = F.col("event_id")
    c = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", k.alias("id"), (k % 17 / 8.0).alias("total_score"), (k % 13 == 0).alias("is_current"), (k % 3 == 0).alias("fp_ok"), (k % 19 / 20.0).alias("distance_score"), (k % 4).cast("int").alias("line_diff"))
    one = c.where("not is_current").unionByName(dedupe.first_by(c.where("is_current"), ["user_id"], ["id"]))
    return matching.pick_static(one, ["user_id"], 5, 0.5)


@query("""WITH n AS (SELECT o_custkey AS id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) SELECT c_custkey AS id, 'store' AS origin, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'a' || c_custkey END, ''), c_name) AS name FROM customer WHERE c_custkey % 2 = 1 OR c_name = ''
UNION ALL SELECT id, 'import ' || k, 'o' || k FROM n WHERE r = 1 AND id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 1)""")
def imported_records(spark, sf_dir):
    k = F.col("c_custkey")
    name = tabular.first_non_blank(F.when(k % 2 == 0, " ").otherwise(F.concat(F.lit(" a"), k.cast("string"))), F.col("c_name"))
    store = table(spark, sf_dir, "customer").where(k % 2 == 1).select(k.alias("id"), F.lit("store").alias("origin"), name.alias("name"), F.lit(0).cast("long").alias("seq"))
    key = F.col("o_orderkey")
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("import "), key.cast("string")).alias("origin"), F.concat(F.lit("o"), key.cast("string")).alias("name"), key.cast("long").alias("seq"))
    return dedupe.import_new(store, new, "id", "seq").drop("seq")


@query("""WITH e AS (SELECT event_id AS id, 'd' || (user_id % 3) AS doc_id, 'f' || (user_id % 2) AS field_key, event_type AS stage, event_id % 4 AS k FROM events)
SELECT id, CASE k WHEN 0 THEN 'n/a' WHEN 1 THEN '{x:1.5, y:2, w:' || id || '}' WHEN 2 THEN '{x:0.13, y:0, w:0, h:0}' ELSE '{x:1.5, y:2, w:' || id || '} | {x:0.13, y:0, w:0, h:0}' END AS shown_box, CASE WHEN k = 0 THEN 'n/a' ELSE 'tokens:' || k || ', scans:2' END AS shown_counts, CASE WHEN k = 2 THEN 'n/a' ELSE 'v' || k END AS shown_value, k > 1 AS expanded,
 (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM e UNION ALL SELECT DISTINCT field_key FROM e UNION ALL SELECT DISTINCT stage FROM e)) AS options FROM e WHERE doc_id = 'd1' AND stage = 'view'""")
def shown_events(spark, sf_dir):
    u, i = F.col("user_id"), F.col("event_id")
    box = lambda *v: F.struct(*(x.cast("double").alias(n) for n, x in zip("xywh", v)))
    k = i % 4
    e = table(spark, sf_dir, "events").select(
        i.alias("id"), F.concat(F.lit("d"), (u % 3).cast("string")).alias("doc_id"), F.concat(F.lit("f"), (u % 2).cast("string")).alias("field_key"), F.col("event_type").alias("stage"),
        F.when(k.isin(1, 3), box(F.lit(1.5), F.lit(2), i, F.lit(None))).alias("pixel_box"), F.when(k > 1, box(F.lit(0.125), F.lit(0), F.lit(0), F.lit(0))).alias("unit_box"),
        F.when(k > 0, k).alias("tokens"), F.lit(None).cast("int").alias("anchors"), F.when(k > 0, 2).alias("scans"), F.when(k != 2, F.concat(F.lit("v"), k.cast("string"))).alias("output"), F.when(k > 0, k - 1).alias("expansion"),
    )
    n = eventlog.filter_options(e).agg(F.count("*").alias("options"))
    shown = eventlog.event_summaries(eventlog.filtered(e, doc="d1", stage="view"))
    return shown.select("id", "shown_box", "shown_counts", "shown_value", "expanded").crossJoin(n)
