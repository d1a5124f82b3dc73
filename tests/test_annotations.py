from pyspark.sql import functions as F

from foliant.functions import numeric
from foliant.operators import annotations, batchstats, eventlog, spatial
from foliant.sources import readers, writers


def test_snapshots_of_incomplete_regions(spark):
    box = "struct<x:double,y:double,w:double,h:double>"
    schema = f"p long, id long, bbox {box}, x double, y double, w double, h double, nx double, ny double, nw double, nh double, page_w long, page_h long, confidence double, text_density double, surface string"
    none = [None] * 4
    rows = [(1, 1, (1.0, 2.0, 3.0, 4.0), *none, *none, 10, 10, 0.5, None, "s"), (1, 2, (1.0, None, 3.0, 4.0), 5.0, 6.0, 7.0, 80.0, *none, 10, 10, None, None, None), (1, 3, None, *none, 0.1, 0.2, 0.3, 0.4, None, 100, None, None, None), (1, 4, None, 9.0, None, -1.0, None, *none, 0, 0, None, None, None)]
    got = {r.id: r for r in annotations.region_snapshots(spark.createDataFrame(rows, schema), ["p"]).collect()}
    assert tuple(got[1].box) == (1, 2, 3, 4) and tuple(got[1].norm) == (0.1, 0.2, 0.3, 0.4) and got[1].surface == "s"
    assert tuple(got[2].box) == (5, 6, 7, 80) and got[2].norm.h == 1.0 and got[2].surface == "unknown"
    assert tuple(got[3].box) == (0.1, 20.0, 0.3, 40.0) and tuple(got[4].box) == (9.0, 0.0, 0.0, 0.0)


def test_weights_stay_below_ten_pairs_and_for_no_boxes(spark):
    schema = "record_id long, id long, category string, x double, y double, w double, h double"
    few = spark.createDataFrame([(1, 1, "label", 0.1, 0.1, 0.1, 0.1), (1, 2, "field_value", 0.1, 0.1, 0.1, 0.1), (2, 3, "field_value", 0.1, 0.1, 0.1, 0.1)], schema)
    for df in (few, few.limit(0)):
        got = {r.weight: r.suggested for r in annotations.ranking_weights(df).collect()}
        assert got == annotations.WEIGHTS
    many = spark.createDataFrame([(1, k, c, 0.1, 0.1, 0.1, 0.1) for k in range(12) for c in ("label", "field_value", "visual_region")], schema)
    got = {r.weight: r for r in annotations.ranking_weights(many).collect()}
    assert got["local_geometry"].suggested == round(0.22 / 1.08, 2) and got["containing_region"].enclosure == 1.0


def test_manifest_pages_are_capped_and_replaced(spark):
    rows = [("f", p, s, d, None) for p, s, d in ((3, 1, "A" * 8), (1, 2, "AAAA"), (2, 3, "AAAA"), (3, 4, None), (3, 5, "A" * 400), (0, 6, "AAAA"), (None, 7, "AAAA"))]
    got = {r.page: r for r in annotations.page_manifests(spark.createDataFrame(rows, "file_id string, page long, seq long, data string, thumb string"), most=2, size=100).collect()}
    assert set(got) == {3, 1} and got[3].too_large and got[3].data is None and got[3].bytes == 300 and got[1].bytes == 3


def test_entries_of_any_form(spark):
    rows = [("a", '{"query": {"raw": "X", "normalized": "x"}, "page": "2", "candidates": {"no": 1}}'), ("b", '{"query": "Y", "normalized": "y", "tokenSource": "ocr"}'), ("c", "not json"), ("d", None), ("e", '{"query": {}, "label": ""}')]
    got = {r.k: r for r in annotations.normalised_entries(spark.createDataFrame(rows, "k string, value string")).collect()}
    assert (got["a"].query_raw, got["a"].query_normalized, got["a"].page, got["a"].candidates) == ("X", "x", 2.0, [])
    assert (got["b"].query_raw, got["b"].query_normalized, got["b"].source) == ("Y", "y", "ocr")
    assert all((got[k].query_raw, got[k].candidates, got[k].label) == ("", [], None) for k in "cde")


def test_selection_without_neighbours(spark):
    schema = "p long, id long, kind string, x double, y double, w double, h double, orientation double"
    nodes = spark.createDataFrame([(1, 1, "region", 0.0, 0.0, 100.0, 100.0, None), (1, 2, "token", 500.0, 500.0, 5.0, 5.0, None), (2, 3, "line", 0.0, 0.0, 5.0, 5.0, 90.0)], schema)
    seeds = spark.createDataFrame([(1, 9, 10.0, 10.0, 5.0, 5.0), (3, 9, 0.0, 0.0, 5.0, 5.0)], "p long, id long, x double, y double, w double, h double")
    got = annotations.associated(seeds, nodes, ["p"], F.lit(1000.0), F.lit(800.0)).collect()
    assert sorted((r.role, r.node_id) for r in got) == [("containing", 1), ("intersecting", 1)]


def test_area_capture_keeps_the_nearest(spark):
    t = spark.createDataFrame([(1, k, 0.1 * k, 0.1, 0.01, 0.01) for k in range(12)], "p long, id long, x double, y double, w double, h double")
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 1.2, 0.3)], "p long, id long, x double, y double, w double, h double")
    assert [r.token_id for r in spatial.area_capture(t, a, ["p"]).orderBy("rank").collect()] == [6, 5, 7, 4, 8, 3, 9, 2]
    assert spatial.area_capture(t, a, ["p"], k=12).count() == 12 and spatial.area_capture(t.where("false"), a, ["p"]).count() == 0


def test_hints_logs_and_cells(spark, tmp_path):
    rows = [("2024/1/5", None, "due_date", "2024-01-05"), ("no date", "date", "x", "no date"), ("(1,2OO.5)", "money", "x", "-1200.5"), ("  a   b ", "text", "x", "a b"), (None, "num", "x", ""), ("  z ", None, "note", "z")]
    df = spark.createDataFrame(rows, "v string, magic string, key string, want string")
    assert [r.got for r in df.select(numeric.cleaned_by_hint(F.col("v"), F.col("magic"), F.col("key")).alias("got")).collect()] == [r[3] for r in rows]
    line = lambda d, n, raw: (d, n, f'[1] ocr.apply {{"fieldKey": "f", "magicDataType": "any", "raw": "{raw}", "cleaned": "{raw}"}}')
    log = spark.createDataFrame([line(d, n, f"{d}{n}") for d in (1, 2) for n in (1, 2)] + [(2, 3, '[1] verify.done {"fieldKey": "f", "changed": true, "cleaned": "new"}')], "doc long, line_no long, value string")
    got = {(r.doc, r.line_no): r.cleaned for r in eventlog.accuracy_rows(eventlog.log_lines(log, ("doc",)), ("doc",)).collect()}
    assert got == {(1, 1): "11", (1, 2): "12", (2, 1): "21", (2, 2): "new"}
    cells = spark.createDataFrame([("", None, 'a "b", c')], "x string, y string, z string")
    writers.write_csv(cells, str(tmp_path / "csv"))
    assert [tuple(r) for r in readers.csv_table(spark, str(tmp_path / "csv")).collect()] == [("", "", 'a "b", c')]


def test_alike_regions_of_one_batch(spark):
    names = "batch long, id long, x double, y double, w double, h double, aspect double, rectangularity double, solidity double, neighbours long, edge_weight double, edge_types array<double>, depth long, type string, confidence double, density double"
    row = lambda b, k, x: (b, k, x, 0.5, 0.1, 0.1, 1.0, 1.0, 1.0, 0, 0.0, None, 0, "t", 0.5, 0.5)
    a = spark.createDataFrame([row(1, 1, 0.5), row(2, 2, 0.5)], names)
    t = spark.createDataFrame([row(1, 5, 0.5), row(3, 6, 0.5)], names).withColumn("doc", F.lit(9))
    assert [(r.batch, r.doc, r.a_id, r.b_id, r.similarity) for r in batchstats.similar_regions(a, t, ["batch"]).collect()] == [(1, 9, 1, 5, 1.0)]
