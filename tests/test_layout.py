import math

from foliant.operators import batchstats, layout, summary

BOX = "page int, id int, x double, y double, w double, h double"


def test_lines_meet_across_bands_and_pages_stay_apart(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 19.0), (1, 2, 390.0, 19.0, 10.0, 19.0), (1, 3, 0.0, 60.0, 2.0, 2.0), (2, 4, 0.0, 0.0, 1.0, 1.0), (None, 5, 0.0, 0.0, 1.0, 1.0), (None, 6, 0.0, 0.0, 1.0, 1.0)]
    lines = spark.createDataFrame([(*r, None) for r in rows], BOX + ", block_id int")
    tokens = spark.createDataFrame([(1, 7, 1), (1, 8, None)], "page int, id int, line_id int")
    e = {(r.source_id, r.target_id, r.edge_type): r.weight for r in layout.text_edges(tokens, lines, ["page"]).collect()}
    assert set(e) == {(7, 1, "token_to_line"), (1, 2, "line_horizontal_neighbor")}
    assert math.isclose(e[1, 2, "line_horizontal_neighbor"], 1 - 390 / 400)


def test_nearest_region_ties_far_lines_and_empty_pages(spark):
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 0.0), (1, 2, 900.0, 0.0, 0.0, 0.0), (2, 3, 0.0, 0.0, 0.0, 0.0)], BOX)
    regions = spark.createDataFrame([(1, 9, 3.0, 4.0, 0.0, 0.0), (1, 8, 4.0, 3.0, 0.0, 0.0)], BOX)
    got = {r.id: (r.region_id, r.distance) for r in layout.nearest_regions(lines, regions, ["page"], 10.0).collect()}
    assert got[1] == (8, 5.0) and got[2][0] == 8 and got[3] == (None, None)
    assert layout.nearest_regions(lines.limit(0), regions, ["page"], 10.0).count() == 0


def test_box_without_a_region_takes_the_nearest(spark):
    boxes = spark.createDataFrame([(1, 1, 1.0, 1.0, 2.0, 2.0), (1, 2, 500.0, 500.0, 2.0, 2.0), (2, 3, 0.0, 0.0, 1.0, 1.0)], BOX)
    regions = spark.createDataFrame([(1, 5, 0.0, 0.0, 10.0, 10.0, 0.5), (1, 6, 0.0, 0.0, 4.0, 4.0, 0.1)], BOX + ", share double")
    got = {r.id: (r.region_id, r.contained, r.members, r.rx) for r in layout.located(boxes, regions, ["page"], 50.0).collect()}
    assert got == {1: (6, True, 2, 0.5), 2: (5, False, 0, 1.0), 3: (None, False, 0, None)}


def test_layout_without_keywords_or_tokens(spark):
    c = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 100.0, 100.0), (1, 2, "none", 0.0, 0.0, 100.0, 100.0)], "page int, candidate int, layout string, x double, y double, w double, h double")
    k = spark.createDataFrame([("a", 1, "total", 0.5, 0.5, 0.5, 0.5, 0.5, 0.5)], "layout string, kw int, norm string, cx double, cy double, left double, top double, right double, bottom double")
    t = spark.createDataFrame([(1, 1, 50.0, 50.0, 0.0, 0.0, "total"), (1, 2, 50.0, 50.0, 0.0, 0.0, "total"), (1, 3, 59.0, 50.0, 0.0, 0.0, "total")], BOX + ", norm string")
    got = {r.candidate: (r.matched, r.match_ratio, r.position_penalty) for r in layout.layout_scores(c, k, t, ["page"]).collect()}
    assert got == {1: (1, 1.0, 0.0), 2: (0, 1.0, 0.0)}
    none = {r.candidate: r.match_ratio for r in layout.layout_scores(c, k, t.limit(0), ["page"]).collect()}
    assert none == {1: 0.0, 2: 1.0}


def test_cells_part_only_at_lines(spark):
    pages = spark.createDataFrame([(1, 100.0, 100.0)], "page int, width double, height double")
    h = spark.createDataFrame([(1, 50.0, 0.0, 100.0)], "page int, y double, x1 double, x2 double")
    v = spark.createDataFrame([(1, 30.0, 0.0, 20.0), (1, 31.0, 0.0, 20.0)], "page int, x double, y1 double, y2 double")
    cells = layout.grid_cells(pages, h, v, ["page"])
    assert cells.count() == 4  # the sliver between 30 and 31 is left out
    assert {(r.row, r.col) for r in cells.collect()} == {(0, 0), (0, 2), (1, 0), (1, 2)}
    whole = {(r.x, r.y, r.w, r.h) for r in layout.merged_cells(cells, h, v, pages, ["page"]).collect()}
    assert whole == {(0.0, 0.0, 30.0, 50.0), (31.0, 0.0, 69.0, 50.0), (0.0, 50.0, 30.0, 50.0), (31.0, 50.0, 69.0, 50.0)}


def test_quantiles_are_exact(spark):
    import random

    random.seed(5)
    data = {"a": [random.choice([1.0, 2.0, random.random() * 9]) for _ in range(6007)], "b": [3.0] * 40, "c": [5.0]}
    values = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "metric string, v double")
    got = {r.metric: (r.n, r.q0, r.q1) for r in batchstats.floor_quantiles(values, (0.25, 0.75)).collect()}
    want = {k: (len(vs), sorted(vs)[int(len(vs) * 0.25)], sorted(vs)[int(len(vs) * 0.75)]) for k, vs in data.items()}
    assert got == want


def test_summaries_of_empty_and_null_documents(spark):
    docs = spark.createDataFrame([(1, 100.0, 100.0, 1, 1, None), (2, None, 100.0, 1, 1, 1), (3, 100.0, 100.0, 1, 1, 1)], "doc_id int, width double, height double, line_count int, block_count int, token_count int")
    regions = spark.createDataFrame([(1, 1, 0.0, 0.0, 50.0, 0.0, None, None, None), (2, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "s")], "doc_id int, region_id int, x double, y double, w double, h double, confidence double, density double, surface string")
    edges = spark.createDataFrame([], "doc_id int, source_id int, target_id int, edge_type string, weight double")
    d = summary.region_descriptors(regions, docs)
    s = summary.summaries(docs, d, edges)
    valid, rest = summary.split_valid(s)
    assert [(r.doc_id, r.surfaces, sum(r.distribution)) for r in valid.collect()] == [(1, {"unknown": 1}, 0.0)]
    assert {r.doc_id: r.reason for r in rest.collect()} == {2: "no viewport", 3: "no regions"}
    assert [len(r.vector) for r in summary.signatures(d, summary.neighbourhoods(d, edges)).collect()] == [14, 14]
    assert summary.summaries(docs.limit(0), d.limit(0), edges).count() == 0
    assert {r.metric: r.stability for r in summary.stability(s).collect()}["region_count"] == 1.0


def test_context_matches_all_pairs(spark):
    import random

    from foliant.operators import matching

    random.seed(3)
    pts = [(p, i, random.random() * 2 - 1, random.random()) for p in (1, 2) for i in range(40)] + [(1, 99, 0.5, 0.5), (1, 98, 0.5, 0.5)]
    df = spark.createDataFrame(pts, "page int, id int, x double, y double")
    got = {(r.page, r.field_id): set() for r in matching.context(df, df.withColumn("text", df.id), ["page"], 0.3, 4).collect()}
    for r in matching.context(df, df.withColumn("text", df.id), ["page"], 0.3, 4).collect():
        assert r.text == r.id
        got[r.page, r.field_id].add(r.id)
    for p, i, x, y in pts:
        d = sorted((math.dist((x, y), (u, v)), j) for q, j, u, v in pts if q == p)
        assert got[p, i] == {j for away, j in d if away <= 0.3 and (away, j) in d[:4]}


def test_aligned_groups_and_bands(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 30.0, 5.0, 10.0, 10.0), (1, 3, 15.0, 9.0, 30.0, 10.0), (1, 4, 0.0, 99.0, 5.0, 5.0), (None, 5, 0.0, 0.0, 1.0, 1.0)]
    b = spark.createDataFrame(rows, BOX)
    got = [(r.members, r.first, r.last, r.cross, r.along) for r in layout.aligned_groups(b, ["page"]).collect()]
    assert got == [(3, 1, 2, 10.0, None)]
    pages = spark.createDataFrame([(1, 100.0, 1000.0)], "page int, width double, height double")
    lines = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (1, 20.0, 0.0, 20.0), (1, 40.5, 0.0, 30.0)], "page int, y double, x1 double, x2 double")
    assert sorted((r.band, r.lines, r.separator) for r in layout.line_bands(lines, pages, ["page"]).collect()) == [(0, 2, False), (1, 1, True)]
    assert layout.line_bands(lines.limit(0), pages, ["page"]).count() == 0
