import pytest
from pyspark.sql import functions as F

from foliant.operators import tabular

SCHEMA = f"doc_seq long, file_id string, fields map<string,string>, totals map<string,string>, line_items array<{tabular.ITEM}>"


def item(sku="", description="", quantity="", unit_price="", amount="", line_no="", row_number=None, missing=None):
    return (sku, description, quantity, unit_price, amount, line_no, row_number, missing)


def records(spark, *rows):
    return spark.createDataFrame([(i, f"f{i}", f, t, li) for i, (f, t, li) in enumerate(rows)], SCHEMA)


def flat(spark, *rows):
    return [r.asDict() for r in tabular.flatten(records(spark, *rows)).orderBy("doc_seq", "idx").collect()]


def test_cells_are_cleaned_and_totals_filled(spark):
    fields = {"store_name": " My Store ", "department_division": "Electronics\nDivision", "invoice_total": "1050"}
    items = [item("0001", "Widget A\nLarge", "2", "100.5", "201", "0001"), item("0002", "Widget B", "3", "50", "", " ", None, {"line_no": "true"})]
    first, second = flat(spark, (fields, {}, items))
    assert (first["Store / Business Name"], first["Department / Division"], first["Invoice Total"]) == ("My Store", "Electronics Division", "1050.00")
    assert first["Item Description"] == "Widget A Large" and first["Line Total"] == "201.00" and first["Line No"] == "0001"
    assert (second["Line Total"], second["Line No"]) == ("150.00", "2")
    missing = tabular.missing_reasons(tabular.selected_items(records(spark, (fields, {}, items)))).collect()
    assert [(r["column"], r["row"], r["reasons"], r["flagged"]) for r in missing] == [("line_no", 2, ["empty", "flagged"], True)]


def test_totals_alone_give_one_row(spark):
    (row,) = flat(spark, ({"subtotal_amount": "250"}, {}, []))
    assert (row["Quantity"], row["Unit Price"], row["Line Total"], row["Line No"]) == ("1.00", "250.00", "250.00", "1")


def test_majority_prunes_sparse_rows(spark):
    full = [item(f"s{i}", f"Widget number {i}", "1", "2", "2") for i in range(8)]
    assert len(flat(spark, ({}, {}, full + [item(), item()]))) == 8
    assert len(flat(spark, ({}, {}, full + [item("", f"Comment line {i}", "", "3", "") for i in range(6)]))) == 8


def test_zero_rows_and_inference(spark):
    rows = flat(spark, ({}, {}, [item("a", "Widget", "", "5", "20"), item("b", "Free gift wrap", "", "", ""), item("c", "Other", "", "7", "")]))
    assert [(r["Quantity"], r["Unit Price"], r["Line Total"]) for r in rows] == [("4.00", "5.00", "20.00"), ("1.00", "0.00", "0.00"), ("1.00", "7.00", "7.00")]
    assert [r["Line No"] for r in rows] == ["1", "2", "3"]


def test_line_numbers_run_over_the_batch(spark):
    one = [item("a", "First thing", "1", "1", "1")]
    assert [r["Line No"] for r in flat(spark, ({}, {}, one), ({}, {}, one))] == ["1", "2"]


def test_custom_rows_are_padded(spark):
    df = tabular.flatten_custom(records(spark, ({"a": " x "}, {}, []), ({"a": "y"}, {}, [item("k")])), {"A": "a"}, {"Code": "sku"})
    assert [tuple(r) for r in df.orderBy("doc_seq").collect()] == [(0, 0, "x", "", "f0"), (1, 0, "y", "k", "f1")]


def test_area_registry_and_sheets(spark):
    config = spark.createDataFrame([(0, "cold", "Cold Storage", ["coldstorage", "freezer"]), (1, "back", "Backroom", None)], "seq int, area_id string, area_name string, aliases array<string>")
    rows = spark.createDataFrame([(1, "coldstorage", None), (2, None, "COLD  STORAGE"), (3, "Freezer", "x"), (4, None, "unknown")], "n int, area_id string, area_name string")
    got = tabular.resolve_areas(rows, tabular.area_registry(config)).orderBy("n").collect()
    assert [r["resolved_id"] for r in got] == ["cold", "cold", "cold", "unknown"]
    cells = spark.createDataFrame([("f1", "a", 0, "Store", "S"), ("f1", "a", 0, "aisle", "4"), ("f2", "a", 0, "aisle", "5")], "file_id string, resolved_id string, row int, column string, value string")
    sheet = tabular.sheet(cells, "a")
    assert sheet.columns == ["row", "Store", "aisle", "File ID"]
    assert {(r["Store"], r["aisle"], r["File ID"]) for r in sheet.collect()} == {("S", "4", "f1"), ("", "5", "f2")}
    with pytest.raises(Exception, match="unexpected column"):
        tabular.sheet(cells, "a", ["aisle"]).collect()


def test_empty_batch(spark):
    assert tabular.flatten(records(spark).limit(0) if False else spark.createDataFrame([], SCHEMA)).count() == 0


def test_items_enriched(spark):
    r = records(spark, ({}, {}, [item("a", "x", "2", "3", ""), item("b", "y", "1", "1", "9", "7")]))
    (got,) = r.select(tabular.enrich_items(F.col("line_items")).alias("i")).collect()
    assert [(i["line_no"], i["amount"]) for i in got["i"]] == [("1", "6.00"), ("7", "9")]
