import pytest
from pyspark.sql import functions as F

from foliant.functions import dates, numeric, stats
from foliant.functions import text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "want"), [(" 1,050 ", "1050.00"), ("(5)", "5.00"), ("-", ""), (None, ""), ("abc", ""), ("$2.5", "2.50"), ("1.005", "1.00")])
def test_clean_numeric(spark, raw, want):
    assert one(spark, numeric.clean_numeric, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("($1,200.50)", -1200.5), ("", None), ("-", None), ("12%", 12.0), ("x", None)])
def test_parse_numeric(spark, raw, want):
    assert one(spark, numeric.parse_numeric, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("2024-02-30", None), ("2024-02-29", "2024-02-29"), ("3/4/2024", "2024-03-04"), ("25/12/2024", "2024-12-25"), ("13-13-2024", None), ("bad", None)])
def test_event_date(spark, raw, want):
    got = one(spark, dates.event_date, raw)
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize(("raw", "want"), [("Mar 3rd, 2024", "2024-03-03"), ("3/4/2024", "2024-03-04"), ("2024-1-2", "2024-01-02"), ("25/12/2024", "2024-12-25"), ("soon", "")])
def test_normal_date(spark, raw, want):
    assert one(spark, dates.normal_date, raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Ro11ing", "Rolling"), ("I0I", "IOI"), ("OIO", "OIO"), ("0LGA", "0LGA"), ("", ""), (None, "")])
def test_adjacent_glyphs(spark, raw, want):
    assert one(spark, T.adjacency_fixed, raw) == want


def test_types_and_repeats(spark):
    fixed = lambda kind: lambda c: T.type_fixed(c, F.lit(kind))
    assert one(spark, fixed("text_only"), "0LGA") == "OLGA" and one(spark, fixed("numeric_only"), "O") == "0" and one(spark, fixed("any"), "O0") == "O0"
    assert one(spark, T.collapse_repeats, "net net total total total") == "net total"
    assert one(spark, T.collapse_repeats, "a A b a a b " * 40 + "end") == "a b end" and one(spark, T.collapse_repeats, "") == ""
    assert one(spark, T.match_norm, "Crème  BRÛLÉE!") == "creme brulee"
    assert one(spark, T.collapse, " a \n b ") == "a b"
    assert one(spark, lambda c: T.rehydrate(c, F.lit("XY")), "a-b c") == "X-Y c"


def test_similarity(spark):
    assert one(spark, lambda c: T.edit_ratio(c, F.lit("abc")), "") == 1.0
    assert one(spark, lambda c: T.token_overlap(c, F.lit("12345")), "Invoice 12345") == 1.0
    assert one(spark, lambda c: T.jaccard(c, F.lit("b c")), "a b") == pytest.approx(1 / 3)


def test_statistics(spark):
    lists = spark.createDataFrame([([1.0, 2.0, 3.0, 100.0, 2.0, 3.0, 1.0],), ([1.0, 2.0],), ([],)], "v array<double>")
    assert [r[0] for r in lists.select(F.size(stats.without_outliers(F.col("v")))).collect()] == [6, 2, 0]
    v = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "a array<double>, b array<double>")
    r = v.select(stats.cosine(F.col("a"), F.col("a")), stats.cosine(F.col("a"), F.col("b")), stats.divergence(F.col("a"), F.col("b")), stats.divergence(F.col("a"), F.col("a"))).first()
    assert (r[0], r[1], r[3]) == (1.0, 0.0, 0.0) and r[2] > 0.9


def test_cells_hints_and_shown_boxes_of_odd_values(spark):
    from pyspark.sql import functions as F

    from foliant.functions import numeric
    from foliant.operators import eventlog

    rows = [("2 pcs", "$3.5", None), (None, None, "12.5-3"), ("-", "abc", ""), ("1.5", "2.005", "0")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, p string, a string")
    got = [tuple(r) for r in df.orderBy("i").select(*numeric.consistent(F.col("q"), F.col("p"), F.col("a"))).collect()]
    assert got[:3] == [("2", "3.50", "7.00"), ("", "", "12.50"), ("-", "", "")] and got[3][2] == "0.00"
    keys = spark.createDataFrame([(None, None), ("Money", "x"), (None, "due_date"), ("text", "tax"), (None, "the tax"), (None, "taxes")], "m string, k string")
    assert [r[0] for r in keys.select(numeric.type_hint(F.col("m"), F.col("k"))).collect()] == ["any", "numeric", "date", "text", "numeric", "any"]
    assert [r[0] for r in keys.select(numeric.format_score(F.col("k"), F.lit("12"))).collect()] == [0.4, 0.4, 0.4, 1.0, 1.0, 1.0]
    box = spark.createDataFrame([((1.0, None, 100.0, -0.125),), (None,)], "b struct<x:double,y:double,w:double,h:double>")
    assert [r[0] for r in box.select(eventlog.shown_box(F.col("b"))).collect()] == ["{x:1, w:100, h:-0.12}", None]
