"""Log analytics and learning over the events table and text tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric, stats, text
from ..operators import batchstats, eventlog, learn, search
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


#: A trace of text changes: amounts with a digit read as a letter, by user as field and event type as stage.
TRACE = """WITH t0 AS (SELECT event_id AS seq, 'field-' || (user_id % 20) AS field_key, event_type AS stage, 'rule-' || (event_id % 29) AS rule, CAST(CAST(floor(value * 100 + 0.5) AS BIGINT) AS VARCHAR) AS after_, value / 500 AS conf FROM events),
t1 AS (SELECT *, CASE WHEN seq % 3 = 0 THEN replace(after_, '0', 'O') WHEN seq % 3 = 1 THEN replace(after_, '1', 'l') ELSE after_ END AS before_ FROM t0),
t2 AS (SELECT *, before_ <> after_ AS changed, length(after_) - length(replace(replace(CASE WHEN seq % 3 = 2 THEN '' ELSE before_ END, 'O', ''), 'l', '')) AS d0,
  CASE WHEN seq % 3 = 2 THEN 0 ELSE length(before_) - length(replace(replace(before_, 'O', ''), 'l', '')) END AS delta FROM t1),
t AS (SELECT *, changed AND coalesce(max(changed) OVER (PARTITION BY field_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overridden FROM t2)
"""


def trace_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    after = F.floor(F.col("value") * 100 + 0.5).cast("long").cast("string")
    s = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("field-"), (F.col("user_id") % 20).cast("string")).alias("field_key"), F.col("event_type").alias("stage"), F.concat(F.lit("rule-"), (F.col("event_id") % 29).cast("string")).alias("rule"), after.alias("after"), (F.col("value") / 500).alias("confidence_after"), F.lit(None).cast("int").alias("char_delta"))
    before = F.when(F.col("seq") % 3 == 0, F.replace("after", F.lit("0"), F.lit("O"))).when(F.col("seq") % 3 == 1, F.replace("after", F.lit("1"), F.lit("l"))).otherwise(F.col("after"))
    return eventlog.traced(s.withColumn("before", before))


@query(TRACE + "SELECT rule, count(*) AS events, count(*) FILTER (WHERE changed) AS changes, CAST(sum(delta) AS BIGINT) AS char_delta FROM t GROUP BY rule ORDER BY changes DESC, char_delta DESC, rule LIMIT 20")
def trace_rules(spark, sf_dir):
    return eventlog.rule_stats(trace_events(spark, sf_dir))


@query(TRACE + "SELECT stage, count(*) AS events, count(*) FILTER (WHERE changed) AS changes, count(*) FILTER (WHERE overridden) AS overrides FROM t GROUP BY stage")
def trace_stages(spark, sf_dir):
    return eventlog.stage_stats(trace_events(spark, sf_dir))


@query(TRACE + "SELECT field_key, CAST(sum(n) AS BIGINT) AS events, CAST(sum(c) AS BIGINT) AS changes, string_agg(stage || '=' || n, ',' ORDER BY stage) AS stages FROM (SELECT field_key, stage, count(*) AS n, count(*) FILTER (WHERE changed) AS c FROM t GROUP BY 1, 2) GROUP BY field_key")
def trace_fields(spark, sf_dir):
    f = eventlog.field_stats(trace_events(spark, sf_dir))
    return f.select("field_key", "events", "changes", F.array_join(F.transform(F.array_sort(F.map_entries("stages")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("stages"))


@query(TRACE + "SELECT count(*) FILTER (WHERE stage = 'purchase') AS runs, count(*) FILTER (WHERE stage = 'purchase' AND changed) AS patched, avg(conf) FILTER (WHERE stage = 'purchase') AS avg_confidence, min(conf) FILTER (WHERE stage = 'purchase') AS min_confidence, max(conf) FILTER (WHERE stage = 'purchase') AS max_confidence FROM t")
def trace_verifier(spark, sf_dir):
    return eventlog.verifier_stats(trace_events(spark, sf_dir), "purchase")


@query(TRACE + "SELECT count(*) AS events, count(*) FILTER (WHERE changed) AS changes, CAST(sum(delta) AS BIGINT) AS char_delta FROM t")
def trace_totals(spark, sf_dir):
    return eventlog.totals(trace_events(spark, sf_dir))


@query(TRACE + "SELECT CASE WHEN seq % 3 = 0 THEN 'O->0' ELSE 'l->1' END AS pair, CAST(sum(delta) AS BIGINT) AS n FROM t WHERE changed GROUP BY 1")
def trace_confusions(spark, sf_dir):
    return eventlog.confusions(trace_events(spark, sf_dir))


LOG = """WITH g0 AS (SELECT event_id AS line_no, 'f' || (user_id % 15) AS field_key, event_type, CAST(floor(value * 100 + 0.5) AS BIGINT)::VARCHAR AS raw FROM events),
p AS (SELECT *, event_type IN ('view', 'purchase') AS applies, CASE WHEN line_no % 2 = 0 THEN replace(raw, '0', 'O') ELSE raw END AS applied FROM g0),
r AS (SELECT *, sum(CAST(applies AS INT)) OVER (PARTITION BY field_key ORDER BY line_no) AS run FROM p WHERE event_type <> 'error'),
a AS (SELECT field_key, run, max(CASE WHEN applies THEN line_no END) AS line_no, max(CASE WHEN applies THEN raw END) AS raw, max(CASE WHEN applies THEN applied END) AS applied,
  arg_max(raw, line_no) FILTER (WHERE event_type = 'click' AND line_no % 2 = 0) AS verified, bool_or(event_type = 'signup') AS skip_ FROM r WHERE run > 0 GROUP BY field_key, run),
o AS (SELECT field_key, line_no, raw, coalesce(verified, applied) AS cleaned, verified IS NOT NULL AS was, raw <> applied AS touched, skip_ AS align_fail,
  coalesce(verified IS NOT NULL AND raw <> applied AND verified = raw, false) AS introduced_error FROM a),
rows_ AS (SELECT *, raw <> cleaned AS changed, CASE WHEN raw = cleaned THEN 'none' WHEN was THEN 'tesseract' WHEN touched THEN 'ocrmagic' ELSE 'none' END AS corrected_by FROM o)
"""


def accuracy_log(spark, sf_dir, field: Column | None = None, document: Column | None = None) -> DataFrame:
    """Log lines made of the events: apply (view, purchase), verify done (click), verify skip (signup), noise (error)."""
    field = F.col("user_id") % 15 if field is None else field
    e = table(spark, sf_dir, "events")
    raw = F.floor(F.col("value") * 100 + 0.5).cast("long").cast("string")
    e = e.select(F.col("event_id").alias("line_no"), F.concat(F.lit("f"), field.cast("string")).alias("fieldKey"), "event_type", raw.alias("raw"), *([] if document is None else [document.alias("document")]))
    label = F.when(F.col("event_type").isin("view", "purchase"), "ocr.apply").when(F.col("event_type") == "click", "ocr.verify.done").when(F.col("event_type") == "signup", "ocr.verify.skip").otherwise("noise")
    apply_, even = F.col("event_type").isin("view", "purchase"), F.col("line_no") % 2 == 0
    cleaned = F.when(apply_ & even, F.replace("raw", F.lit("0"), F.lit("O"))).otherwise(F.col("raw"))
    j = F.to_json(F.struct("fieldKey", F.when(apply_, F.col("raw")).alias("raw"), F.when(apply_ | ((F.col("event_type") == "click") & even), cleaned).alias("cleaned"), F.when(apply_, "any").alias("magicDataType"), F.when(F.col("event_type") == "click", even).alias("changed"), F.when(F.col("event_type") == "signup", "alignFail").alias("reason")))
    return e.select(*([] if document is None else ["document"]), "line_no", F.concat(F.lit("[12:00] "), label, F.lit(" "), j).alias("value"))


@query(LOG + "SELECT field_key, line_no, raw, cleaned, changed, corrected_by, introduced_error, align_fail FROM rows_")
def accuracy_rows(spark, sf_dir):
    return eventlog.accuracy_rows(eventlog.log_lines(accuracy_log(spark, sf_dir)))


#: The same log, of 250 events to a document.
LOG_PARTS = LOG.replace("SELECT event_id AS line_no, 'f' || (user_id % 15) AS field_key", "SELECT event_id // 250 AS document, event_id AS line_no, 'f' || (event_id % 7) AS field_key").replace("PARTITION BY field_key", "PARTITION BY document, field_key").replace("SELECT field_key,", "SELECT document, field_key,").replace("GROUP BY field_key, run", "GROUP BY document, field_key, run")


@query(LOG_PARTS + "SELECT document, field_key, line_no, raw, cleaned, changed, corrected_by, introduced_error, align_fail FROM rows_")
def accuracy_rows_by_document(spark, sf_dir):
    log = accuracy_log(spark, sf_dir, F.col("event_id") % 7, F.floor(F.col("event_id") / 250))
    return eventlog.accuracy_rows(eventlog.log_lines(log, ("document",)), ("document",))


@query(LOG + """SELECT field_key, count(*) AS total, count(*) FILTER (WHERE changed) AS changed, count(*) FILTER (WHERE corrected_by = 'none') AS none, count(*) FILTER (WHERE corrected_by = 'ocrmagic') AS ocrmagic,
  count(*) FILTER (WHERE corrected_by = 'tesseract') AS tesseract, count(*) FILTER (WHERE corrected_by = 'upstream/pdf.js') AS upstream_pdf_js FROM rows_ GROUP BY GROUPING SETS ((field_key), ())""")
def accuracy_by_field(spark, sf_dir):
    return eventlog.accuracy_stats(eventlog.accuracy_rows(eventlog.log_lines(accuracy_log(spark, sf_dir))))


INSIGHT = """WITH n0 AS (SELECT event_id AS id, 'd' || (event_id % 700) AS document_id, (event_id % 3)::INT AS page, event_type AS query, CASE WHEN event_id % 4 < 2 THEN 'pdfjs' WHEN event_id % 4 = 2 THEN 'tesseract' END AS source,
  CASE WHEN event_id % 5 < 2 THEN 'good' WHEN event_id % 5 < 4 THEN 'bad' END AS label, CASE WHEN event_id % 11 = 0 THEN 'shifted' ELSE 'ok' END AS geometry_label, CASE WHEN event_id % 13 = 0 THEN 'wrong' END AS candidate_label,
  CASE WHEN event_id % 17 = 0 THEN 'cut' END AS crop_label, 'c' || (event_id % 6) AS chosen_id, CASE WHEN event_id % 9 = 0 THEN 'c' || (event_id % 7) END AS corrected_id,
  CASE WHEN event_id % 8 = 0 THEN 'abc' END AS expected_text, CASE WHEN event_id % 16 = 0 THEN 'abd' ELSE 'abc' END AS preview_text, (event_id % 4)::INT AS candidates, value FROM events),
b AS (SELECT *, CASE WHEN geometry_label <> 'ok' THEN 'geometry' WHEN candidate_label IS NOT NULL OR (label = 'bad' AND corrected_id IS NOT NULL AND corrected_id <> chosen_id) THEN 'candidate'
  WHEN crop_label IS NOT NULL OR (expected_text IS NOT NULL AND preview_text <> expected_text) THEN 'cropText' WHEN label IS NOT NULL AND candidates = 0 THEN 'miss' WHEN label = 'good' THEN 'good' ELSE 'unlabeled' END AS bucket FROM n0)
"""


def search_log(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    c = lambda k: F.concat(F.lit("c"), (i % k).cast("string"))
    scores = F.slice(F.array(F.col("value"), F.col("value") / 2, F.col("value") / 4), 1, (i % 4).cast("int"))
    return e.select(i.alias("id"), F.concat(F.lit("d"), (i % 700).cast("string")).alias("document_id"), (i % 3).cast("int").alias("page"), F.col("event_type").alias("query"), F.when(i % 4 < 2, "pdfjs").when(i % 4 == 2, "tesseract").alias("source"), F.when(i % 5 < 2, "good").when(i % 5 < 4, "bad").alias("label"), F.when(i % 11 == 0, "shifted").otherwise("ok").alias("geometry_label"), F.when(i % 13 == 0, "wrong").alias("candidate_label"), F.when(i % 17 == 0, "cut").alias("crop_label"), c(6).alias("chosen_id"), F.when(i % 9 == 0, c(7)).alias("corrected_id"), F.when(i % 8 == 0, "abc").alias("expected_text"), F.when(i % 16 == 0, "abd").otherwise("abc").alias("preview_text"), scores.alias("candidates"))


@query(INSIGHT + """, d AS (SELECT document_id, page, query FROM n0 GROUP BY 1, 2, 3 HAVING bool_or(source = 'pdfjs' AND label = 'good') AND bool_or(source = 'tesseract' AND label = 'bad')),
u AS (SELECT bucket FROM b UNION ALL SELECT 'sourceDisagreement' FROM n0 SEMI JOIN d USING (document_id, page, query))
SELECT bucket, count(*) AS n, floor(1000 * count(*) / (SELECT count(label) FROM n0)::DOUBLE + 0.5) / 10 AS pct_of_labeled FROM u GROUP BY bucket""")
def insight_buckets(spark, sf_dir):
    return eventlog.bucket_summary(search_log(spark, sf_dir))


@query(INSIGHT + "SELECT bucket, query, n FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, query) AS r FROM (SELECT bucket, query, count(*) AS n FROM b GROUP BY 1, 2)) WHERE r <= 2")
def insight_top_queries(spark, sf_dir):
    return eventlog.top_queries(search_log(spark, sf_dir), 2)


@query(INSIGHT + "SELECT chosen_id, corrected_id, count(*) AS n FROM n0 WHERE label = 'bad' AND corrected_id <> chosen_id GROUP BY 1, 2 ORDER BY n DESC, chosen_id, corrected_id LIMIT 10")
def insight_confusions(spark, sf_dir):
    return eventlog.confusion_pairs(search_log(spark, sf_dir))


@query(INSIGHT + "SELECT coalesce(source, 'unknown') AS source, count(*) AS total, count(*) FILTER (WHERE label = 'good') AS good, count(*) FILTER (WHERE label = 'bad') AS bad FROM n0 GROUP BY 1")
def insight_sources(spark, sf_dir):
    return eventlog.source_counts(search_log(spark, sf_dir))


@query(INSIGHT + "SELECT label, avg(value / 2) AS avg_margin, count(*) AS n FROM n0 WHERE label IS NOT NULL AND candidates >= 2 GROUP BY label")
def insight_margins(spark, sf_dir):
    m = search_log(spark, sf_dir).where("label is not null").withColumn("m", eventlog.score_margin(F.col("candidates"))).where("m is not null")
    return m.groupBy("label").agg(F.avg("m").alias("avg_margin"), F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (WHERE contains(text, '@')) AS email_like, count(*) FILTER (WHERE regexp_matches(text, '(?i)\\bhttps?://|www\\.')) AS url_like,
  count(*) FILTER (WHERE regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Za-z]')) AS mixed_alnum, count(*) FILTER (WHERE regexp_matches(trim(text), '^[0-9.,-]+$')) AS numeric_only FROM documents""")
def text_flags(spark, sf_dir):
    return eventlog.feature_flags(table(spark, sf_dir, "documents"), "text")


@query("""WITH s AS (SELECT doc_id, toxic = 1 AS y, n_chars / 20000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8])::DOUBLE AS threshold)
SELECT threshold, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1 FROM (
SELECT threshold, count(*) FILTER (WHERE score >= threshold AND y) AS tp, count(*) FILTER (WHERE score >= threshold AND NOT y) AS fp, count(*) FILTER (WHERE score < threshold AND y) AS fn, count(*) FILTER (WHERE score < threshold AND NOT y) AS tn FROM s CROSS JOIN t GROUP BY threshold)""")
def threshold_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("toxic") == 1).alias("y"), (F.col("n_chars") / 20000.0).alias("score"))
    return learn.threshold_sweep(rows, "score", "y", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8])


@query("""SELECT avg(tp / nullif(p, 0)::DOUBLE) AS precision, avg(tp / nullif(a, 0)::DOUBLE) AS recall FROM (SELECT source, count(*) FILTER (WHERE n_chars > 1500 AND quality = 1) AS tp, count(*) FILTER (WHERE n_chars > 1500) AS p, count(*) FILTER (WHERE quality = 1) AS a FROM labels JOIN documents USING (doc_id) GROUP BY source)""")
def precision_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), "doc_id").select("source", (F.col("n_chars") > 1500).alias("p"), (F.col("quality") == 1).alias("a"))
    return learn.precision_recall(rows, "source", "p", "a")


SLOTS = """WITH s AS (SELECT user_id % 30 AS key, CAST(floor(value * 100 + 0.5) AS BIGINT)::VARCHAR || upper(left(event_type, 2)) AS slots FROM events),
c AS (SELECT key, unnest(range(length(slots))) AS pos, unnest(string_split(slots, '')) AS c FROM s),
g AS (SELECT key, pos, sum(CASE WHEN c NOT IN ('0','1','5','7','O','I','l','S','T') AND regexp_matches(c, '[A-Za-z]') THEN 5 ELSE 0 END) AS letter, sum(CASE WHEN c NOT IN ('0','1','5','7') AND regexp_matches(c, '[0-9]') THEN 5 ELSE 0 END) AS number FROM c GROUP BY key, pos),
l AS (SELECT *, CASE WHEN letter + number >= 20 AND abs(letter - number) >= 15 THEN CASE WHEN letter > number THEN 'L' ELSE 'N' END ELSE '?' END AS l FROM g)
"""


def slot_events(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 30).alias("key"), "event_id", F.concat(F.floor(F.col("value") * 100 + 0.5).cast("long").cast("string"), F.upper(F.left("event_type", F.lit(2)))).alias("slots"))


@query(SLOTS + "SELECT key, pos::INT AS pos, CAST(letter AS BIGINT) AS letter, CAST(number AS BIGINT) AS number FROM g")
def slot_scores(spark, sf_dir):
    return learn.slot_scores(slot_events(spark, sf_dir), ["key"])


@query(SLOTS + """, e AS (SELECT *, lag(l) OVER (PARTITION BY key ORDER BY pos) || l AS pair FROM l)
SELECT key, string_agg(l, '' ORDER BY pos) AS layout, avg(CASE WHEN l = '?' THEN 0 ELSE 1 END) AS coverage, coalesce(bool_or(pair IN ('LN', 'NL')), false) AS mixed, avg(CASE WHEN l = '?' THEN 0 ELSE 1 END) >= 0.6 AND coalesce(bool_or(pair IN ('LN', 'NL')), false) AS violation FROM e GROUP BY key""")
def learned_layouts(spark, sf_dir):
    return learn.layouts(learn.slot_scores(slot_events(spark, sf_dir), ["key"]), ["key"])


@query("""SELECT user_id % 100 AS key, avg(value) AS mean, coalesce(stddev_samp(value), 0) AS sd, median(value) AS median, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90,
  CASE WHEN count(*) >= 3 THEN (sum(value) - min(value) - max(value)) / (count(*) - 2) ELSE avg(value) END AS trimmed, coalesce(stddev_samp(value), 0) / avg(value) AS cv, coalesce(stddev_pop(value), 0) AS sd_pop FROM events GROUP BY 1""")
def value_statistics(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("key")).agg(F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.median(v).alias("median"), F.percentile(v, 0.1).alias("p10"), F.percentile(v, 0.9).alias("p90"), stats.trimmed_mean(v).alias("trimmed"), stats.variation(v).alias("cv"), F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("sd_pop"))


@query("""WITH l AS (SELECT user_id, list_sort(list(value)) AS s FROM events GROUP BY user_id), q AS (SELECT *, s[least(len(s) // 4 + 1, len(s))] AS q1, s[least(3 * len(s) // 4 + 1, len(s))] AS q3 FROM l),
k AS (SELECT *, list_filter(s, lambda x: x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS kept FROM q)
SELECT user_id, q1, q3, len(CASE WHEN len(s) < 4 OR len(kept) < 2 THEN s ELSE kept END)::INT AS kept FROM k""")
def outlier_filter(spark, sf_dir):
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))  # one user's values
    return lists.select("user_id", stats.floor_percentile(F.col("v"), 0.25).alias("q1"), stats.floor_percentile(F.col("v"), 0.75).alias("q3"), F.size(stats.without_outliers(F.col("v"))).alias("kept"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, ts, value, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signup FROM events)
SELECT event_id, user_id, value, signup FROM r WHERE event_type = 'purchase'""")
def as_of_last_event(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").withColumn("signup", F.last(F.when(F.col("event_type") == "signup", F.col("value")), ignorenulls=True).over(w))
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "value", "signup")


@query("""WITH s AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new_ FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, ts, sum(new_) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM s)
SELECT user_id, burst::BIGINT AS burst, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY 1, 2""")
def bursts_by_gap(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts").cast("timestamp").cast("double") - F.lag(F.col("ts").cast("timestamp").cast("double")).over(w)
    e = table(spark, sf_dir, "events").withColumn("new", F.when(gap > 6 * 3600, 1).otherwise(0)).withColumn("burst", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "burst").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""SELECT user_id, arg_max(value, event_id) AS data, count(*) AS n, max(event_id) AS seq FROM events GROUP BY user_id""")
def coalesced_writes(spark, sf_dir):
    from ..streaming.stateful import latest_per_path

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("value").alias("data"), F.col("event_id").alias("enqueued_at"), F.col("event_id").alias("seq"))
    n = e.groupBy("path").agg(F.count("*").alias("n"))
    return latest_per_path(e).join(n, "path").select(F.col("path").alias("user_id"), "data", "n", "seq")


@query("""WITH d AS (SELECT vec_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS u FROM d), n AS (SELECT count(DISTINCT vec_id) AS n FROM d), s AS (SELECT dim, sum(u) AS s, sum(u * u) AS q FROM u GROUP BY dim)
SELECT CAST(n * (n - 1) / 2 AS BIGINT) AS pairs, round((sum(s * s) - sum(q)) / 2 / (n * (n - 1) / 2), 9) AS mean_cosine FROM s CROSS JOIN n GROUP BY n""")
def mean_pairwise_cosine(spark, sf_dir):
    return batchstats.mean_pairwise_cosine(vector_rows(spark, sf_dir), "vec_id", "dim", "v").select("pairs", F.round("mean_cosine", 9).alias("mean_cosine"))


def vector_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", F.posexplode("embedding").alias("dim", "f")).select("vec_id", "label", "dim", F.col("f").cast("double").alias("v"))


@query("""WITH d AS (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE embedding IS NOT NULL), u AS (SELECT *, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS u FROM d),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, sum(a.u * b.u) AS c FROM u a JOIN u b ON a.dim = b.dim AND a.vec_id <> b.vec_id GROUP BY 1, 2) SELECT a AS vec_id, round(avg(c), 9) AS mean_similarity FROM p GROUP BY a""")
def document_centrality(spark, sf_dir):
    return batchstats.centrality(vector_rows(spark, sf_dir), "vec_id", "dim", "v").select("vec_id", F.round("mean_similarity", 9).alias("mean_similarity"))


@query("""WITH d AS (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE embedding IS NOT NULL), m AS (SELECT label, dim, avg(abs(v)) AS m FROM d GROUP BY 1, 2),
p AS (SELECT label, list(m / t ORDER BY dim) AS p, list(m ORDER BY dim) AS v FROM (SELECT *, sum(m) OVER (PARTITION BY label) AS t FROM m) GROUP BY label)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 9) AS cosine,
  round(list_sum([0.5 * x * log2(x / ((x + y) / 2)) + 0.5 * y * log2(y / ((x + y) / 2)) for x, y in list_zip(a.p, b.p)]), 9) AS divergence FROM p a JOIN p b ON a.label < b.label""".replace("list_sum([0.5 * x * log2(x / ((x + y) / 2)) + 0.5 * y * log2(y / ((x + y) / 2)) for x, y in list_zip(a.p, b.p)])", "list_sum(list_transform(list_zip(a.p, b.p), lambda z: 0.5 * z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) + 0.5 * z[2] * log2(z[2] / ((z[1] + z[2]) / 2))))"))
def label_profiles(spark, sf_dir):
    m = vector_rows(spark, sf_dir).groupBy("label", "dim").agg(F.avg(F.abs("v")).alias("m")).withColumn("p", F.col("m") / F.sum("m").over(Window.partitionBy("label")))
    lists = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "m", "p"))).alias("r")).select("label", F.transform("r", lambda x: x["m"]).alias("v"), F.transform("r", lambda x: x["p"]).alias("p"))
    a, b = lists.select(*(F.col(c).alias(f"a_{c}") for c in lists.columns)), lists.select(*(F.col(c).alias(f"b_{c}") for c in lists.columns))
    j = a.join(b, F.col("a_label") < F.col("b_label"))
    return j.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"), F.round(stats.cosine(F.col("a_v"), F.col("b_v")), 9).alias("cosine"), F.round(stats.divergence(F.col("a_p"), F.col("b_p")), 9).alias("divergence"))


@query("""SELECT 'n_chars' AS metric, count(*) AS n, avg(n_chars) AS mean, stddev_samp(n_chars) AS stddev, stddev_samp(n_chars) / avg(n_chars) AS cv, greatest(0, least(1, 1 - stddev_samp(n_chars) / avg(n_chars))) AS stability FROM documents""")
def scalar_stability(spark, sf_dir):
    return batchstats.scalar_stability(table(spark, sf_dir, "documents"), "n_chars")


@query("""WITH s AS (SELECT list_sort(list(n_chars)) AS s FROM documents WHERE n_chars IS NOT NULL), q AS (SELECT *, s[least(len(s) // 4 + 1, len(s))] AS q1, s[least(3 * len(s) // 4 + 1, len(s))] AS q3 FROM s),
k AS (SELECT stddev_samp(n_chars) / avg(n_chars) AS cv FROM documents CROSS JOIN q WHERE n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) SELECT 'n_chars' AS metric, cv AS robust_cv, greatest(0, least(1, 1 - cv)) AS stability FROM k""")
def robust_stability(spark, sf_dir):
    return batchstats.robust_stability(table(spark, sf_dir, "documents"), "n_chars")


@query("""WITH m AS (SELECT user_id % 7 AS g, avg(value) / 500 AS s FROM events GROUP BY 1), n AS (SELECT CASE g WHEN 0 THEN 'region_count' WHEN 1 THEN 'region_area' WHEN 2 THEN 'region_density' WHEN 3 THEN 'adjacency_graph' WHEN 4 THEN 'spatial_distribution' WHEN 5 THEN 'text_structure' ELSE 'surface_type' END AS metric, s FROM m),
o AS (SELECT sum(s * CASE metric WHEN 'region_count' THEN 0.20 WHEN 'region_area' THEN 0.15 WHEN 'region_density' THEN 0.10 WHEN 'adjacency_graph' THEN 0.20 WHEN 'spatial_distribution' THEN 0.15 WHEN 'text_structure' THEN 0.10 ELSE 0.10 END) AS x FROM n)
SELECT x AS overall_stability, CASE WHEN x >= 0.85 THEN 'stable' WHEN x >= 0.7 THEN 'mostly_stable' WHEN x >= 0.5 THEN 'moderately_stable' ELSE 'unstable' END AS status FROM o""")
def overall_stability(spark, sf_dir):
    names = F.array(*map(F.lit, batchstats.WEIGHTS))
    m = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("g")).agg((F.avg("value") / 500).alias("stability"))
    return batchstats.overall(m.select(F.element_at(names, (F.col("g") + 1).cast("int")).alias("metric"), "stability"))


@query("""SELECT l_suppkey % 50 AS key, round(regr_slope(u, x), 6) AS slope_check, count(*) AS pairs FROM (SELECT l_suppkey, l_quantity AS x, 3 * l_quantity + 2 AS u FROM lineitem) GROUP BY 1""")
def affine_fit(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem")
    p = i.select((F.col("l_suppkey") % 50).alias("key"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (3 * F.col("l_quantity") + 2).alias("u"), (F.col("l_discount") * 50 - 1).alias("v"), F.lit(1.0).alias("weight"))
    return learn.affine(p, ["key"]).select("key", F.round("a", 6).alias("slope_check"), "pairs")


@query("""SELECT user_id, sum(value * k) / sum(k) AS value, sum(event_id * k) / sum(k) AS event_id, count(*) AS n FROM (SELECT *, (event_id % 5 + 1)::DOUBLE AS k FROM events) GROUP BY user_id""")
def weighted_profile(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("confidence", (F.col("event_id") % 5 + 1).cast("double"))
    return learn.weighted_profile(e, "user_id", ["value", "event_id"])


@query("""WITH g AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(length(text)) OVER w AS next_len, lag(role) OVER w AS prev_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, next_role, next_len, prev_role FROM g""")
def cross_links(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.lead(F.length("text")).over(w).cast("long").alias("next_len"), F.lag("role").over(w).alias("prev_role"))


@query("""SELECT item_id, CASE WHEN contains(text, '@') THEN -2.0 ELSE 0.0 END::DOUBLE + CASE WHEN regexp_matches(text, '(?i)\\bhttps?://|www\\.') THEN -1.0 ELSE 0.0 END::DOUBLE + CASE WHEN regexp_matches(text, '[0-9]') AND regexp_matches(text, '[A-Za-z]') THEN -0.5 ELSE 0.0 END::DOUBLE AS penalty FROM benchmark""")
def candidate_penalties(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.form_penalty(F.col("text")).alias("penalty"))


@query("""WITH c AS (SELECT DISTINCT c_name AS term, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS t FROM customer
  UNION SELECT DISTINCT p_name, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) FROM part),
q AS (SELECT DISTINCT 'x' || p_name || 's' AS query_id, trim(regexp_replace(lower('x' || p_name || 's'), '[^a-z0-9]+', ' ', 'g')) AS q FROM part),
d AS (SELECT query_id, term, levenshtein(q, t) / greatest(length(q), length(t))::DOUBLE AS distance FROM q CROSS JOIN c)
SELECT query_id, term, round(distance, 9) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, term) AS n FROM d WHERE distance <= 0.3) WHERE n = 1""")
def nearest_names(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    terms = p.union(table(spark, sf_dir, "customer").select("c_name")).withColumnRenamed("p_name", "term")
    q = p.select(F.concat(F.lit("x"), F.col("p_name"), F.lit("s")).alias("query")).withColumn("query_id", F.col("query"))
    return search.nearest_text(q, terms).select("query_id", "term", F.round("distance", 9).alias("distance"))


@query("""WITH s AS (SELECT c_custkey, c_acctbal, c_nationkey, exp(-abs(c_acctbal - 1000) / 500.0) / 2 + exp(-abs(c_nationkey - 7) / 5.0) / 2 AS similarity FROM customer) SELECT c_custkey AS id, round(similarity, 9) AS similarity FROM s ORDER BY similarity DESC, c_custkey LIMIT 10""")
def similar_examples(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    return learn.similar(c, {"c_acctbal": 1000, "c_nationkey": 7}, {"c_acctbal": 500, "c_nationkey": 5}, 10).select("id", F.round("similarity", 9).alias("similarity"))


@query("""WITH a AS (SELECT event_id // 4 AS key, event_id % 4 AS pad, value / 300 AS score, CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END AS text FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN score >= 0.65 THEN 0 ELSE 1 END, CASE WHEN score >= 0.65 THEN pad ELSE -pad END) AS r FROM a WHERE text <> '') SELECT key, pad, score, text FROM r WHERE r = 1""")
def progressive_expansion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("key"), (F.col("event_id") % 4).alias("pad"), (F.col("value") / 300).alias("score"), F.when(F.col("event_id") % 6 == 0, "").otherwise(F.col("event_type")).alias("text"))
    return search.first_passing(e, ["key"], "pad", "score")


@query("""SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) // 100) || '.' || lpad((CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 100)::VARCHAR, 2, '0') AS shown FROM orders""")
def money_format(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", numeric.money(F.concat(F.lit("$ "), numeric.fixed2(F.col("o_totalprice")))).alias("shown"))
