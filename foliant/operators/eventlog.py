"""Analytics over event logs: traces of text changes, accuracy logs, labelled search logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .dedupe import first_by

#: Stage whose confidences are summarised, and the confusions that count.
VERIFY_STAGE = "any_field_tesseract_patch"
CONFUSIONS = ("0->O", "O->0", "1->I", "I->1", "1->l", "l->1", "5->S", "S->5", "7->T", "T->7")
CORRECTORS = ("none", "ocrmagic", "tesseract", "upstream/pdf.js")


def char_delta(before: Column, after: Column) -> Column:
    """Positions that differ, the longer text's rest included."""
    a, b = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    pairs = F.zip_with(T.chars(a), T.chars(b), lambda x, y: F.when(x.isNotNull() & y.isNotNull() & (x == y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda s, d: s + d)


def traced(events: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Events with defaults, changed, delta and overridden (the field was changed before).

    A log is one session, so a field's events are in one order; `within` names the columns (document, session) that part several
    logs in one table, which also spreads a frequent field over tasks."""
    named = events.withColumns({"rule": F.coalesce(F.nullif("rule", F.lit("")), F.lit("unspecified")), "stage": F.coalesce(F.nullif("stage", F.lit("")), F.lit("other")), "field_key": F.coalesce(F.nullif("field_key", F.lit("")), F.lit("__unknown__"))})
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    before = Window.partitionBy(*within, "field_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    named = named.withColumn("changed", changed).withColumn("delta", F.when(changed, F.coalesce("char_delta", char_delta(F.col("before"), F.col("after")))).otherwise(0))
    return named.withColumn("overridden", F.col("changed") & F.coalesce(F.max("changed").over(before), F.lit(False)))


def rule_stats(t: DataFrame, top: int = 20) -> DataFrame:
    """The rules that change most."""
    s = t.groupBy("rule").agg(F.count("*").alias("events"), F.count_if("changed").alias("changes"), F.sum("delta").alias("char_delta"))
    return s.orderBy(F.desc("changes"), F.desc("char_delta"), "rule").limit(top)


def stage_stats(t: DataFrame) -> DataFrame:
    return t.groupBy("stage").agg(F.count("*").alias("events"), F.count_if("changed").alias("changes"), F.count_if("overridden").alias("overrides"))


def field_stats(t: DataFrame) -> DataFrame:
    """Per field events, changes and a map of events by stage."""
    by = t.groupBy("field_key", "stage").agg(F.count("*").alias("n"), F.count_if("changed").alias("c"))
    return by.groupBy("field_key").agg(F.sum("n").alias("events"), F.sum("c").alias("changes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("stages"))


def verifier_stats(t: DataFrame, stage: str = VERIFY_STAGE) -> DataFrame:
    at = F.col("stage") == stage
    c = F.when(at, F.col("confidence_after"))
    return t.agg(F.count_if(at).alias("runs"), F.count_if(at & F.col("changed")).alias("patched"), F.avg(c).alias("avg_confidence"), F.min(c).alias("min_confidence"), F.max(c).alias("max_confidence"))


def totals(t: DataFrame) -> DataFrame:
    return t.agg(F.count("*").alias("events"), F.count_if("changed").alias("changes"), F.sum("delta").alias("char_delta"))


def confusions(t: DataFrame, pairs: tuple[str, ...] | None = CONFUSIONS) -> DataFrame:
    """pair, n: character substitutions at equal positions of changed texts; pairs=None keeps all."""
    both = F.arrays_zip(T.chars(F.col("before")).alias("a"), T.chars(F.col("after")).alias("b"))
    rows = t.where("changed").select(F.explode(both).alias("p")).where("p.a is not null and p.b is not null and p.a <> p.b").select(F.concat("p.a", F.lit("->"), "p.b").alias("pair"))
    return (rows.where(F.col("pair").isin(*pairs)) if pairs else rows).groupBy("pair").agg(F.count("*").alias("n"))


# accuracy logs

def log_lines(lines: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """within, line_no, label (before the JSON, its [prefix] dropped), details (from the first brace to the last)."""
    bare = F.regexp_replace("value", r"^\[[^\]]*\]\s*", "")
    return lines.select(*within, "line_no", bare.alias("line"), F.trim(F.regexp_extract(bare, r"^([^{]*)", 1)).alias("label"), F.regexp_extract(bare, r"(\{.*\})", 1).alias("details"))


def accuracy_rows(lines: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """One row per apply event of an `any` field, after the verify events that follow it before the field's next apply.

    `within` names the columns (document, session) that part several logs in one table; a field's events are then in one order only
    within its log, and a frequent field is spread over tasks."""
    get = lambda *paths: F.coalesce(*(F.get_json_object("details", f"$.{p}") for p in paths))
    low = F.lower("label")
    kind = F.when(F.contains(low, F.lit("verify.done")), "done").when(F.contains(low, F.lit("verify.skip")), "skip").when(F.contains(low, F.lit("magic_type")), "type").when(F.contains(low, F.lit("apply")), "apply").when(F.contains(low, F.lit("static-debug resolve")), "preview")
    p = lines.select(*within, "line_no", "details", kind.alias("kind"), get("fieldKey", "field").alias("field_key"), get("magicTypeResolved", "magicDataType", "magicType").alias("magic"), get("raw").alias("raw"), get("cleaned").alias("cleaned"), get("changed").alias("changed"), get("reason").alias("reason"), get("preview").alias("preview"), get("confidence").cast("double").alias("confidence")).where("kind is not null and field_key is not null")
    w = Window.partitionBy(*within, "field_key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("known", F.last(F.when(F.col("kind").isin("type", "apply"), F.col("magic")), ignorenulls=True).over(w))
    p = p.withColumn("applies", (F.col("kind") == "apply") & (F.lower("known") == "any"))
    p = p.withColumn("run", F.sum(F.col("applies").cast("int")).over(w))
    early = Window.partitionBy(*within, "field_key", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    shown = p.withColumn("seen", F.last(F.when(F.col("kind") == "preview", F.col("preview")), ignorenulls=True).over(early))
    lagged = shown.withColumn("last_seen", F.lag(F.coalesce(F.when(F.col("kind") == "preview", F.col("preview")), F.col("seen"))).over(Window.partitionBy(*within, "field_key").orderBy("line_no")))
    at = lambda cond, c: F.max_by(F.when(cond, c), F.when(cond, F.col("line_no")))
    own, done = F.col("applies"), (F.col("kind") == "done") & (F.col("changed") == "true")
    rows = lagged.where("run > 0").groupBy(*within, "field_key", "run").agg(at(own, F.col("line_no")).alias("line_no"), at(own, F.coalesce("raw", F.lit(""))).alias("raw"), at(own, F.coalesce("cleaned", "raw", F.lit(""))).alias("applied"), at(done, F.col("cleaned")).alias("verified"), F.max(done).alias("was_verified"), at(own, F.col("last_seen")).alias("preview"), F.max((F.col("kind") == "skip") & (F.col("reason") == "alignFail")).alias("align_fail"), F.last("confidence", ignorenulls=True).alias("confidence"))
    final = F.coalesce("verified", "applied")
    rows = rows.withColumn("cleaned", final).withColumn("changed", F.col("raw") != F.col("cleaned"))
    by = F.when(~F.col("changed"), "none").when(F.col("was_verified"), "tesseract").when(F.col("raw") != F.col("applied"), "ocrmagic").when(F.col("preview").isNotNull() & (F.col("preview") != F.col("cleaned")), "upstream/pdf.js").otherwise("none")
    return rows.select(*within, "field_key", "line_no", "raw", "cleaned", "changed", by.alias("corrected_by"), F.coalesce(F.col("was_verified") & (F.col("raw") != F.col("applied")) & (F.col("verified") == F.col("raw")), F.lit(False)).alias("introduced_error"), "align_fail")


def accuracy_stats(rows: DataFrame) -> DataFrame:
    """Per field and in all (field_key null): rows, changed, and counts by corrector."""
    return rows.cube("field_key").agg(F.count("*").alias("total"), F.count_if("changed").alias("changed"), *(F.count_if(F.col("corrected_by") == c).alias(c.replace("/", "_").replace(".", "_")) for c in CORRECTORS))


# labelled search logs

def bucket(e: DataFrame) -> Column:
    """The failure bucket of a log entry, by priority."""
    set_ = lambda c: (F.coalesce(F.col(c), F.lit("ok")) != "ok") & (F.coalesce(F.col(c), F.lit("")) != "")
    pair = (F.coalesce("preview_text", F.lit("")) != "") & (F.coalesce("expected_text", F.lit("")) != "")
    wrong = (F.col("label") == "bad") & F.col("corrected_id").isNotNull() & ~F.col("corrected_id").eqNullSafe(F.col("chosen_id"))
    return F.when(set_("geometry_label"), "geometry").when(set_("candidate_label") | wrong, "candidate").when(set_("crop_label") | (pair & (F.col("preview_text") != F.col("expected_text"))), "cropText").when(F.col("label").isin("good", "bad") & (F.coalesce(F.size("candidates"), F.lit(0)) <= 0), "miss").otherwise(F.when(F.col("label") == "good", "good").otherwise("unlabeled"))


def disagreements(entries: DataFrame) -> DataFrame:
    """All entries of groups (document, page, query) that are good in one source and bad in another."""
    keys = ["document_id", "page", "query"]
    bad = (F.coalesce("source", F.lit("")) != "") & (F.col("source") != "pdfjs") & (F.col("label") == "bad")
    groups = entries.groupBy(*keys).agg(F.bool_or((F.col("source") == "pdfjs") & (F.col("label") == "good")).alias("g"), F.bool_or(bad).alias("b")).where("g and b")
    cond = [entries[k].eqNullSafe(groups[k]) for k in keys]
    return entries.join(groups, cond, "left_semi")


def bucket_summary(entries: DataFrame) -> DataFrame:
    """bucket, n, pct_of_labeled (one decimal; of labelled entries, so it may exceed 100)."""
    rows = entries.select(bucket(entries).alias("bucket")).unionAll(disagreements(entries).select(F.lit("sourceDisagreement").alias("bucket")))
    labelled = entries.agg(F.count_if(F.col("label").isin("good", "bad")).alias("labelled"))
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).crossJoin(labelled).select("bucket", "n", F.when(F.col("labelled") > 0, F.floor(1000 * F.col("n") / F.col("labelled") + 0.5) / 10).otherwise(0.0).alias("pct_of_labeled"))


def top_queries(entries: DataFrame, k: int = 5) -> DataFrame:
    n = entries.groupBy(bucket(entries).alias("bucket"), F.coalesce(F.nullif("query", F.lit("")), F.lit("<empty>")).alias("query")).agg(F.count("*").alias("n"))
    return first_by(n, ["bucket"], [F.desc("n"), "query"], k)


def confusion_pairs(entries: DataFrame, k: int = 10) -> DataFrame:
    """chosen_id, corrected_id, n of bad choices, the commonest first."""
    rows = entries.where("label = 'bad' and corrected_id is not null and chosen_id is not null and corrected_id <> chosen_id")
    return rows.groupBy("chosen_id", "corrected_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "chosen_id", "corrected_id").limit(k)


def score_margin(scores: Column) -> Column:
    s = F.array_sort(scores)
    return F.when(F.size(s) >= 2, F.element_at(s, -1) - F.element_at(s, -2))


def source_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("total"), F.count_if(F.col("label") == "good").alias("good"), F.count_if(F.col("label") == "bad").alias("bad"))


def feature_flags(entries: DataFrame, column: str = "query") -> DataFrame:
    c = F.coalesce(F.col(column), F.lit(""))
    return entries.agg(F.count_if(T.is_email(c)).alias("email_like"), F.count_if(T.is_url(c)).alias("url_like"), F.count_if(T.is_mixed(c)).alias("mixed_alnum"), F.count_if(T.is_numeric_only(c)).alias("numeric_only"))


def filtered(t: DataFrame, doc: str | None = None, field: str | None = None, stage: str | None = None) -> DataFrame:
    """Events of a document, a field and a stage; a filter left out passes all."""
    for column, value in (("doc_id", doc), ("field_key", field), ("stage", stage)):
        if value:
            t = t.where(F.col(column) == value)
    return t


def filter_options(t: DataFrame) -> DataFrame:
    """column, value: what each filter may be set to."""
    one = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in ("doc_id", "field_key", "stage")))).alias("o")
    return t.select(one).select("o.*").where("value is not null").distinct()


def shown_box(box: Column) -> Column:
    """A box as {x:1, y:2, w:3, h:4} to two places, halves up, sides that are null left out; null for no box."""
    two = lambda c: F.regexp_replace((F.floor(c * 100 + 0.5) / 100).cast("decimal(20,2)").cast("string"), r"\.?0+$", "")
    parts = F.concat_ws(", ", *(F.concat(F.lit(f"{k}:"), two(box[k])) for k in "xywh"))
    return F.when(box.isNotNull(), F.concat(F.lit("{"), parts, F.lit("}")))


def event_summaries(t: DataFrame) -> DataFrame:
    """shown_box, shown_counts, shown_value and expanded of events with pixel_box, unit_box, tokens, anchors, scans, output, expansion."""
    named = lambda c: F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))
    blank = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("n/a"))
    return t.withColumns({
        "shown_box": blank(F.concat_ws(" | ", shown_box(F.col("pixel_box")), shown_box(F.col("unit_box")))),
        "shown_counts": blank(F.concat_ws(", ", named("tokens"), named("anchors"), named("scans"))),
        "shown_value": F.coalesce("output", F.lit("n/a")), "expanded": F.coalesce(F.col("expansion") > 0, F.lit(False)),
    })
