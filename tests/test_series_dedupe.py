import pytest

from foliant.operators import dedupe, series

HEAD = ["row_index", "Event Date", "Money In", "Money Out", "Total Amount", "YTD Total", "File ID"]
ROWS = [(0, "2024-01-03", "100", "20", "80", "80", "A"), (1, "2024-01-02", "50", "10", "40", "40", "B"), (2, "bad-date", "1", "2", "3", "4", "C"), (3, "2024-01-04", "120", "30", "90", "170", "A")]


def test_series(spark):
    df = spark.createDataFrame(ROWS, HEAD)
    got = series.events(df).orderBy("event_date", "doc_id").collect()
    assert [(r.doc_id, r.money_in, r.ytd_total) for r in got] == [("B", 50.0, 40.0), ("A", 120.0, 170.0)]
    assert tuple(series.summary(df).first()) == (4, 2, 1, 1)
    assert series.datasets(series.events(df)).count() == 8


def test_missing_column(spark):
    with pytest.raises(series.MissingColumns, match="money_in"):
        series.events(spark.createDataFrame([(0, "x")], "row_index int, doc_id string"))


def test_best_confidence(spark):
    rows = [("a", "x", "1", 0.8, 1, 0), ("a", "x", "2", 0.6, 2, 1), ("a", "x", "3", 0.8, 3, 2), ("b", "x", "4", None, None, 3)]
    df = spark.createDataFrame(rows, "file_id string, field_key string, value string, confidence double, ts long, arrival int")
    assert {(r.file_id, r.value) for r in dedupe.best_confidence(df, ["file_id", "field_key"]).collect()} == {("a", "3"), ("b", "4")}
    assert {(r.file_id, r.value) for r in dedupe.best_confidence(df.where("arrival < 2"), ["file_id", "field_key"]).collect()} == {("a", "1")}


def test_import_is_distinct(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (2, "w")], "id int, v string")
    assert sorted(map(tuple, dedupe.import_new(a, b, "id", "v").collect())) == [(1, "x"), (2, "w")]
