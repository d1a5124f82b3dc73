"""Candidates, signals and supervision over the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, pixels, runs
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


@query("""WITH s AS (SELECT event_id AS id, user_id, (event_id % 11) / 10.0::DOUBLE AS a, (event_id % 7) / 6.0::DOUBLE AS b, (event_id % 5) / 4.0::DOUBLE AS c FROM events),
t AS (SELECT user_id, id, 0.2 * a + 0.17 * b + 0.14 * c + 0.1 * a + 0.1 * b + 0.17 * c + 0.12 * a AS score FROM s)
SELECT user_id, id, round(score, 9) AS score, round(least(greatest(0.92 * score + 0.05, 0), 1), 9) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, id) AS r FROM t) WHERE r <= 3""")
def signal_ranking(spark, sf_dir):
    e = F.col("event_id")
    a, b, c = e % 11 / 10.0, e % 7 / 6.0, e % 5 / 4.0
    names = dict(zip(matching.SIGNALS, (a, b, c, a, b, c, a)))
    s = table(spark, sf_dir, "events").select(e.alias("id"), "user_id", *(v.alias(k) for k, v in names.items()))
    r = matching.rank_candidates(s, ["user_id"]).withColumn("score", F.round("score", 9))
    from ..operators.dedupe import first_by

    return first_by(r, ["user_id"], [F.desc("score"), "id"], 3).select("user_id", "id", "score", F.round("confidence", 9).alias("confidence"))


@query("""SELECT event_id AS id, round(CASE WHEN x > 0.35 THEN 0 ELSE 1 - x / 0.35 END * CASE WHEN event_id % 4 = 0 THEN 1.0 ELSE greatest(0.65, 1 - least(1.0, y / 0.35)) END * CASE WHEN event_id % 6 = 0 THEN 0.6 ELSE 1.0 END, 9)::DOUBLE AS distance_score
FROM (SELECT event_id, value / 500 AS x, value / 1000 AS y FROM events)""")
def static_distance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = matching.distance_score(F.col("value") / 500, F.when(F.col("event_id") % 4 != 0, F.col("value") / 1000), F.col("event_id") % 6 == 0)
    return e.select(F.col("event_id").alias("id"), F.round(d, 9).alias("distance_score"))


@query("""WITH r AS (SELECT user_id AS page, event_id AS idx, event_id % 4 AS hits, event_id % 9 AS tokens, event_id % 3 AS anchors FROM events),
t AS (SELECT page, CASE WHEN count(*) >= 3 THEN (sum(tokens) - min(tokens) - max(tokens)) / (count(*) - 2)::DOUBLE ELSE avg(tokens) END AS m FROM r GROUP BY page)
SELECT page, idx FROM (SELECT r.*, floor(m + 0.5) AS target, row_number() OVER (PARTITION BY page ORDER BY hits DESC, tokens DESC, anchors DESC, idx) AS k FROM r JOIN t USING (page)) WHERE k <= target""")
def row_pruning(spark, sf_dir):
    e = F.col("event_id")
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), e.alias("idx"), (e % 4).alias("hits"), (e % 9).alias("tokens"), (e % 3).alias("anchors"))
    return matching.prune_rows(r.join(matching.row_target(r, ["page"], "tokens"), "page"), ["page"]).select("page", "idx")


@query("""WITH d AS (SELECT user_id AS page, event_id AS id, event_type, CAST(floor(value * 100) AS BIGINT) * 7919 AS w FROM events),
p AS (SELECT q.page, q.id AS query_id, t.id AS train_id, bit_count(xor(q.w, t.w))::INT AS distance FROM d q JOIN d t ON q.page = t.page AND q.event_type = 'view' AND t.event_type <> 'view'),
k AS (SELECT *, row_number() OVER (PARTITION BY page, query_id ORDER BY distance, train_id) AS n, lead(distance) OVER (PARTITION BY page, query_id ORDER BY distance, train_id) AS second FROM p)
SELECT page, query_id, train_id, distance FROM k WHERE n = 1 AND distance < 0.78 * second""")
def descriptor_matches(spark, sf_dir):
    d = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("id"), "event_type", F.array(F.floor(F.col("value") * 100).cast("long") * 7919).alias("words"))
    return matching.hamming_matches(d.where("event_type = 'view'"), d.where("event_type <> 'view'"))


@query("""WITH s AS (SELECT user_id AS a, event_id % 40 AS b, avg(value) / 500 AS score FROM events GROUP BY 1, 2), p0 AS (SELECT least(n_nationkey, (n_nationkey * 3) % 40) AS low, greatest(n_nationkey, (n_nationkey * 3) % 40) AS high, n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN 0.4 ELSE -0.4 END AS shift FROM nation), p AS (SELECT low, high, arg_max(shift, n) AS shift FROM p0 GROUP BY low, high)
SELECT a, b, round(least(greatest(score + coalesce(shift, 0), 0), 1), 9)::DOUBLE AS score FROM s LEFT JOIN p ON least(a, b) = low AND greatest(a, b) = high""")
def supervised_scores(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("a"), (F.col("event_id") % 40).alias("b")).agg((F.avg("value") / 500).alias("score"))
    n = F.col("n_nationkey").cast("long")
    labels = table(spark, sf_dir, "nation").select(n.alias("a"), (n * 3 % 40).alias("b"), F.when(n % 2 == 0, "merge").otherwise("keep").alias("label"), n.alias("seq"))
    return matching.overridden(s, labels).select("a", "b", F.round("score", 9).alias("score"))


@query("""WITH e AS (SELECT o_custkey AS edit_id, list_sort(list_distinct(list(o_orderkey % 50))) AS m FROM orders GROUP BY 1), p AS (SELECT edit_id, unnest(m) AS a, m FROM e), q AS (SELECT edit_id, a, unnest(m) AS b FROM p) SELECT edit_id, a, b FROM q WHERE a < b""")
def supervision_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("edit_id")).agg(F.collect_set(F.col("o_orderkey") % 50).alias("members")).withColumn("label", F.lit("merge"))
    return runs.supervised_pairs(e).select("edit_id", "a", "b")


@query("""SELECT c_custkey AS wizard_id, CASE WHEN c_custkey % 3 <> 0 THEN 'l' || c_nationkey END AS layout, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS field FROM customer""")
def hydrated_bundle(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    w = c.select(F.col("c_custkey").alias("wizard_id"))
    layout = c.select(F.col("c_custkey").alias("wizard_id"), F.concat(F.lit("l"), F.col("c_nationkey").cast("string")).alias("value"), F.when(F.col("c_custkey") % 3 == 0, "deleted").otherwise("active").alias("status"))
    field = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("wizard_id"), F.col("c_name").alias("value"), F.lit(None).cast("string").alias("status"))
    return runs.hydrate(w, {"layout": layout, "field": field})


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'rejected: geometry' WHEN o_totalprice < 100000 THEN 'rejected: check' ELSE 'ok' END AS status FROM orders""")
def staged_extraction(spark, sf_dir):
    stages = [("geometry", lambda d: d.withColumn("reject", F.col("o_orderstatus") == "P")), ("engine", runs.engine("unknown")), ("check", lambda d: d.withColumn("reject", F.col("o_totalprice") < 100000))]
    return runs.staged(table(spark, sf_dir, "orders"), stages).select("o_orderkey", "status")


@query("""SELECT count(*) AS records, CAST(sum(1 + c_custkey % 3) AS BIGINT) AS boxes, CASE WHEN count(*) < 5 THEN 'insufficient' WHEN count(*) < 15 THEN 'preliminary' ELSE 'reliable' END AS status FROM customer""")
def evidence_level(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return runs.evidence(c.select(F.sequence(F.lit(0), F.col("c_custkey") % 3).alias("annotations")))


@query()
def page_features(spark, sf_dir):
    k = F.col("s_suppkey")
    image = table(spark, sf_dir, "supplier").select(k.alias("id"), F.lit(16).alias("width"), F.lit(16).alias("height"), F.unhex(F.concat(*([F.md5(k.cast("string"))] * 16))).alias("pixels"))
    return pixels.page_features(image)


@query()
def page_segments(spark, sf_dir):
    k = F.col("s_suppkey")
    image = table(spark, sf_dir, "supplier").select(k.alias("id"), F.lit(16).alias("width"), F.lit(16).alias("height"), F.unhex(F.concat(*([F.md5(k.cast("string"))] * 16))).alias("pixels"))
    return pixels.segments(image)
