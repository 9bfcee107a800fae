import pytest

import __spark_entry__ as entry
from lotline.sources import sinks, snapshots
from lotline.runtime import shared_dir

ROOT = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["e1_detect_episodes", "d12_weighted_median", "c7_points_in_polygons", "g7_area_baseline", "e10_assign_slots"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    got = entry.queries()[name](spark, ROOT).toArrow()
    want = con.sql(entry.oracle_sql()[name]).to_arrow_table()
    names = sorted(got.column_names)
    rows = lambda t: sorted(zip(*[t.column(c).to_pylist() for c in names]), key=repr)
    assert names == sorted(want.column_names) and rows(got) == rows(want)


def test_columns_by_name_and_drift(spark):
    base = shared_dir(spark)
    spark.createDataFrame([("007", "a")], "floor string, id string").coalesce(1).write.option("header", True).csv(f"{base}/202303")
    spark.createDataFrame([("b", "08", "x")], "id string, floor string, extra string").coalesce(1).write.option("header", True).csv(f"{base}/202306")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("floor", T.StringType()), T.StructField("unit", T.StringType())])
    parts = [snapshots.read_snapshots(spark, f"{base}/{p}", schema, pattern=r"/(\d{6})/[^/]*$") for p in ("202303", "202306")]
    got = {tuple(r) for r in snapshots.union_snapshots(parts).collect()}
    assert got == {("a", "007", None, 202303), ("b", "08", None, 202306)}
    drift = snapshots.schema_drift_report(snapshots.header_columns(spark, [f"{base}/202303", f"{base}/202306"]))
    assert {r["path"][-6:]: (r["missing"], r["extra"]) for r in drift.collect()} == {"202303": ([], []), "202306": ([], ["extra"])}


def test_failed_page_raises(spark):
    page = "<f><RESULT><CODE>ERROR-300</CODE></RESULT></f>"
    df = spark.createDataFrame([(page,)], "xml string")
    with pytest.raises(Exception, match="ERROR-300"):
        snapshots.explode_xml_rows(df, "xml", ["a"]).collect()


def test_panel_is_never_overwritten(spark):
    path = shared_dir(spark)
    df = spark.createDataFrame([(1, 202303)], "v int, period int")
    sinks.write_panel(df, path)
    with pytest.raises(Exception):
        sinks.write_panel(df, path)


def test_files_are_read_by_their_own_header_and_charset(spark):
    from pyspark.sql import types as T

    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    base = shared_dir(spark)
    frames = [("a", "UTF-8", [("1", "001", "가게")], "id string, floor string, name string"), ("b", "x-windows-949", [("상가", "2", "002")], "name string, id string, floor string"), ("c", "UTF-8", [("3",)], "id string")]
    for name, charset, rows, kind in frames:
        spark.createDataFrame(rows, kind).coalesce(1).write.option("header", True).option("encoding", charset).csv(f"{base}/202303_{name}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "floor", "name")])
    got = snapshots.read_snapshots(spark, f"{base}/*", schema, encoding=["UTF-8", "x-windows-949"], pattern=r"/(\d{6})_[^/]*/[^/]*$")
    assert {tuple(r) for r in got.collect()} == {("1", "001", "가게", 202303), ("2", "002", "상가", 202303), ("3", None, None, 202303)}
    with pytest.raises(ValueError, match="decodes .*_b"):
        snapshots.read_csv_encoded(spark, [f"{base}/202303_b"], ["UTF-8", "US-ASCII"])
