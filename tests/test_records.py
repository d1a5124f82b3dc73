import pytest

from foliant.operators import records, tabular

ENTRY = "file_id string, seq int, field_key string, value string, raw string, confidence double"


def test_field_map_keeps_the_last_entry(spark):
    e = spark.createDataFrame([("f", 1, "a", "1", "r", 0.8), ("f", 2, "a", None, "r2", None), ("f", 1, "zone", "x", "x", 0.4), ("g", 1, None, "y", "y", 1.0)], ENTRY)
    got = {r.file_id: {k: tuple(v) for k, v in r.fields.asDict().items()} if hasattr(r.fields, "asDict") else {k: tuple(v) for k, v in r.fields.items()} for r in records.field_map(e, ["a", "b"], ["zone"]).collect()}
    assert got == {"f": {"a": ("", "r2", 0.0), "b": ("", "", 0.0)}, "g": {"a": ("", "", 0.0), "b": ("", "", 0.0)}}


def test_compiled_record(spark):
    rows = [("f", 1, "subtotal_amount", "100", "", 0.9), ("f", 1, "tax_amount", "13.00", "", 0.5), ("f", 1, "invoice_total", "113.5 CAD", "", 0.98), ("f", 1, "store_name", " My \n Store", "", 0.5), ("g", 1, "subtotal_amount", "x", "", 0.9)]
    items = spark.createDataFrame([("f", [("", "a", "2", "30", "", "", None, None), ("", "b", "", "", "39.9", "7", None, None)])], f"file_id string, line_items array<{tabular.ITEM}>")
    r = {x.file_id: x for x in records.compiled(records.field_map(spark.createDataFrame(rows, ENTRY), []), items).collect()}
    f = r["f"]
    assert f.invoice.store == "My Store" and f.totals.total == "113.5 CAD" and f.warnings == ["line_totals_vs_subtotal"]
    assert [(i.line_no, i.amount) for i in f.line_items] == [("1", "60.00"), ("7", "39.9")] and f.line_sum == pytest.approx(99.9)
    assert f.fields["subtotal_amount"].confidence == pytest.approx(0.76) and f.fields["invoice_total"].confidence == 1.0 and f.fields["tax_amount"].confidence == pytest.approx(0.55)
    assert r["g"].warnings == [] and r["g"].fields["subtotal_amount"].confidence == 0.9 and r["g"].line_items == []


def test_config_defaults():
    c = records.normalized_config({"static_fields": [{"key": "s", "label": "S"}, {"name": "bin", "is_area": True}, {"key": "sub", "is_subordinate": True}, {}], "area_keys": ["bin", "x"], "areas": [{"name": " Cold  Store ", "rowType": 1, "type": "Repeating-Block", "aliases": [" a ", ""], "columns": [{"key": "k"}, "m"]}, {}]})
    assert [f["key"] for f in c["static_fields"]] == ["s", "sub"] and c["area_keys"] == ["bin", "x", "sub"] and c["document_keys"] == ["s", "sub"]
    assert c["areas"] == [{"area_id": "Cold Store", "area_name": "Cold Store", "aliases": ["a"], "columns": ["k", "m"], "row_mode": "block"}]
    none = records.normalized_config(None)
    assert none["has_document_fields"] and none["include_line_items"] and not records.normalized_config({"area_keys": ["z"]})["has_document_fields"]


def test_sheets(spark):
    r = spark.createDataFrame([], f"doc_seq long, file_id string, fields map<string,string>, totals map<string,string>, line_items array<{tabular.ITEM}>")
    with pytest.raises(ValueError, match="Exporter input empty"):
        records.sheets(r, None, {})
    areas = spark.createDataFrame([("f", None, "FREEZER", "", {"Invoice #": "7"}, [{"bin": "B1"}, {"bin": "B2"}]), ("g", "z", "Z", "block", {"bin": "x"}, None)], "file_id string, area_id string, area_name string, row_mode string, fields map<string,string>, rows array<map<string,string>>")
    found = records.sheets(r, areas, {"areas": [{"id": "cold", "name": "Cold", "aliases": ["freezer"]}]})
    assert set(found) == {"Cold", "Z"} and sorted(x["bin"] for x in found["Cold"].collect()) == ["B1", "B2"]


def test_line_sums_two_cents_off_are_no_warning(spark):
    """2 x 10.01 and 3 x 0.36 make 21.10: a subtotal of 21.08 is two cents off, though in binary it is more."""
    assert abs(20.02 + 1.08 - 21.08) > 0.02
    rows = [(f, 1, "subtotal_amount", v, "", 0.9) for f, v in (("two", "21.08"), ("three", "21.07"), ("below", "21.12"))]
    items = [(f, [("", "a", "2", "10.01", "", "", None, None), ("", "b", "3", "0.36", "", "", None, None)]) for f in ("two", "three", "below")]
    lines = spark.createDataFrame(items, f"file_id string, line_items array<{tabular.ITEM}>")
    got = {r.file_id: r.warnings for r in records.compiled(records.field_map(spark.createDataFrame(rows, ENTRY), []), lines).collect()}
    assert got == {"two": [], "three": ["line_totals_vs_subtotal"], "below": []}
