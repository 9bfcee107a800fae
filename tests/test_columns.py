import pytest
from pyspark.sql import functions as F

from lotline.functions import columns as C
from lotline.operators import cleaning as K
from lotline.plans.products import reliability_flags


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_floor_tokens(spark):
    texts = ["B2", "01", "0", None, "nan", " nan ", "", "00", "B12", "반지층", "3"]
    got = one(spark, [(t,) for t in texts], "t string", C.normalize_token("t"))
    assert [g[0] for g in got] == ["지하2", "1", "0", "nan", "nan", "nan", "nan", "", "지하12", "반지하", "3"]


def test_split_code(spark):
    rows = [("106", 9), ("1204", 12), ("1204", 5), ("999", None), ("999", 0), ("B12", 3), ("7", 3)]
    floor, unit = C.split_code_by_limit("c", "n")
    got = one(spark, rows, "c string, n int", floor, unit)
    assert got == [("1", "06"), ("12", "04"), ("1", "204"), ("999", None), ("999", None), ("B12", None), ("7", "")]


def test_padded_key(spark):
    rows = [("1121510100", "1", 12, None), (None, None, 12345, 3), ("x", "2", 1, 0)]
    key = C.build_padded_key([("a", 10, 0), ("b", 1, 1), ("c", 4, 0), ("d", 4, 0)])
    strict = C.build_padded_key([("a", 10, 0), ("b", 1, 1), ("c", 4, 0), ("d", 4, 0)], null_if=F.col("a").isNull())
    got = one(spark, rows, "a string, b string, c int, d int", key, strict)
    assert got[0] == ("1121510100100120000",) * 2
    assert got[1] == ("00000000001123450003", None)  # a long lot number is not cut
    assert got[2][0] == "0000000000200010000"


def test_categories_and_codes(spark):
    got = one(spark, [("1",), ("지하2",), ("반지하",), ("7",), ("옥상",), ("nan",), (None,), ("-1",), ("200",)], "t string",
              C.floor_category("t"), C.floor_number("t"))
    assert got == [("floor1", 1.0), ("basement", -2.0), ("basement", -0.5), ("floor2+", 7.0), ("other", None),
                   ("missing", None), ("missing", None), ("basement", -1.0), ("floor2+", None)]
    codes = one(spark, [("3110008.0",), ("UNASSIGNED",), (None,)], "c string", C.normalize_code("c"), C.normalize_code("c", "<NA>"))
    assert codes == [("3110008", "3110008"), (None, "<NA>"), (None, "<NA>")]
    quarters = one(spark, [("20191",), ("20194",), ("20195",), ("2019",)], "q string", C.quarter_code("q"))
    assert [q[0] for q in quarters] == [201903, 201912, None, None]
    parts = C.parse_location_id("l")
    assert one(spark, [("123_지하_1_4",)], "l string", *parts.values()) == [("123", "지하_1", "4")]


def test_brand_and_bins(spark):
    rows = [("Cafe (x) Gangnam점", None), ("Cafe강남점", "강남점"), ("GS-25 [a] & Co.", " "), (None, None)]
    assert [r[0] for r in one(spark, rows, "n string, b string", C.brand_key("n", "b"))] == ["cafe", "cafe", "gs25co", ""]
    bins = C.cut_bins("v", [0, 2, 4], ["low", "high"], include_lowest=True)
    got = one(spark, [(0.0,), (2.0,), (2.5,), (5.0,), (None,)], "v double", bins["label"])
    assert [g[0] for g in got] == ["low", "low", "high", None, None]


def test_period_of_file_name(spark):
    assert one(spark, [("shops_202303.csv",)], "f string", C.first_period_of("f")) == [(202303,)]
    with pytest.raises(Exception, match="no period"):
        one(spark, [("shops.csv",)], "f string", C.first_period_of("f"))


def test_reliability_order(spark):
    rows = [("p", "1", 9, True)] * 8 + [("p", "2", 9, True), ("p", None, 9, True), ("q", " nan ", 9, True), ("r", "1", None, False)]
    df = spark.createDataFrame(rows, "parcel string, floor_raw string, total_floors int, matched boolean")
    got = {tuple(r) for r in reliability_flags(df).select("parcel", "floor_raw", "reliability").collect()}
    assert got == {("p", "1", "floor1_skew"), ("p", "2", "floor1_skew"), ("p", None, "no_floor"), ("q", " nan ", "no_floor"),
                   ("r", "1", "unmatched")}


def test_invalid_areas(spark):
    rows = [(2_000_000.0, 100.0, 2, 0, 1990), (500.0, 100.0, 1, 0, 1800), (250.0, 100.0, 1, 0, 2000), (0.0, 1.0, 1, None, None)]
    df = spark.createDataFrame(rows, "area double, footprint double, floors_up int, floors_down int, approval_year int")
    got = [tuple(r) for r in K.null_out_invalid(df, K.building_rules()).select("area", "approval_year").collect()]
    assert got == [(None, 1990), (None, None), (250.0, 2000), (None, None)]
