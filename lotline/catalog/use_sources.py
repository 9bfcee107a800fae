"""Sources and sinks (A1-A13): the given tables are written in the foreign form first and read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.catalog import views as V
from lotline.catalog.registry import query
from lotline.operators.aggregates import group_rate
from lotline.plans import products as P
from lotline.runtime import scalar, shared_dir, stored, table
from lotline.sources import sinks as K
from lotline.sources import snapshots as S

SHOP = T.StructType([
    T.StructField("parcel", T.StringType()), T.StructField("floor", T.StringType()), T.StructField("shop_id", T.StringType()),
    T.StructField("branch", T.StringType()),
])


@query("a1_read_snapshots", "SELECT parcel, floor, shop_id, CAST(NULL AS VARCHAR) AS branch, period FROM snapshot", ("snapshot",))
def _(spark, root):
    # two headers: the columns of even months stand in another order, and one more stands between them
    rows, base = stored(V.snapshot(spark, root).select("parcel", "floor", "shop_id", "period")), shared_dir(spark)
    for name, even in (("a", True), ("b", False)):
        own = K.dealt_by(rows.where((F.col("period") / 3 % 2 < 1) == F.lit(even)), "period")
        own = own.select("shop_id", F.lit("x").alias("extra"), "floor", "parcel", "period") if even else own
        own.write.partitionBy("period").option("header", True).csv(f"{base}/{name}")
    return S.read_snapshots(spark, f"{base}/*/period=*", SHOP, pattern=r"period=(\d{6})")


@query("a2_read_csv_encoded", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, concat('상가_', p_name) AS name FROM part")
def _(spark, root):
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    path = shared_dir(spark)
    rows = table(spark, root, "part").select("p_partkey", F.concat(F.lit("상가_"), "p_name").alias("name"))
    rows.write.option("header", True).option("encoding", "x-windows-949").csv(path)
    return S.read_csv_encoded(spark, path, "x-windows-949").select("p_partkey", "name")


@query("a3_schema_drift_report", """
SELECT * FROM (VALUES ('customer', '', ''), ('supplier', 'acctbal,mktsegment', 'site')) v(file, missing, extra)""")
def _(spark, root):
    base = shared_dir(spark)
    table(spark, root, "customer").selectExpr("c_custkey key", "c_name name", "c_acctbal acctbal", "c_mktsegment mktsegment").write.option("header", True).csv(f"{base}/customer")
    table(spark, root, "supplier").selectExpr("s_suppkey key", "s_name name", "s_nationkey site").write.option("header", True).csv(f"{base}/supplier")
    report = S.schema_drift_report(S.header_columns(spark, [f"{base}/customer", f"{base}/supplier"]))
    return report.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.array_join("missing", ",").alias("missing"),
                         F.array_join("extra", ",").alias("extra"))


@query("a4_union_snapshots", """
SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier""")
def _(spark, root):
    a = table(spark, root, "customer").selectExpr("c_custkey key", "c_name name", "c_mktsegment segment")
    return S.union_snapshots([a, table(spark, root, "supplier").selectExpr("s_suppkey key", "s_name name")])


@query("a5_read_columns", "SELECT l_partkey, l_quantity FROM lineitem")
def _(spark, root):
    return S.read_columns(spark, f"{root}/lineitem.parquet", ["l_partkey", "l_quantity"])


@query("a6_write_panel", "SELECT period, count(*) AS n, count(DISTINCT location_id) AS n_places FROM panel GROUP BY period", ("panel",))
def _(spark, root):
    path = shared_dir(spark)
    K.write_panel(V.panel(spark, root), path)
    return spark.read.parquet(path).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("location_id").alias("n_places"))


@query("a7_write_report", "SELECT location_id, obs_quarters, turnover_cnt FROM metrics", ("metrics",))
def _(spark, root):
    path = shared_dir(spark)
    K.write_report(V.metrics(spark, root).select("location_id", "obs_quarters", "turnover_cnt"), path)
    return spark.read.option("header", True).schema("location_id string, obs_quarters bigint, turnover_cnt bigint").csv(path)


@query("a8_write_area_documents", """
SELECT location_id, n_name AS district_id, count(*) AS n_entries FROM episodes JOIN supplier ON CAST(s_suppkey AS VARCHAR) = split_part(location_id, '_', 1)
JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""", ("episodes",))
def _(spark, root):
    from lotline.operators.ranked import nested_history

    site = V.areas(spark, root).select(F.col("s_suppkey").cast("string").alias("parcel"), F.col("n_name").alias("district_id"))
    history = nested_history(V.episodes(spark, root), ["location_id"], "start", ["end", "shop_id", "surv_q", "state"])
    docs = history.withColumn("parcel", F.substring_index("location_id", "_", 1)).join(site, "parcel").drop("parcel")
    path = shared_dir(spark)
    K.write_area_documents(docs, "district_id", path)
    back = spark.read.schema("location_id string, history array<struct<start:int,end:int,shop_id:string>>, district_id string").json(path)
    return back.select("location_id", "district_id", F.size("history").alias("n_entries"))


@query("a9_profile_document", """
SELECT concat('{"n_rows":', sum(n), ',"n_variables":', count(DISTINCT variable), '}') AS head, count(*) AS n_bins FROM (
  SELECT 'use' AS variable, use AS bin, count(*) AS n FROM flagged GROUP BY use) t""", ("flagged",))
def _(spark, root):
    rows = P.reliability_flags(V.floor_rows(spark, root), ratio=0.25).withColumn("bad", (F.col("reliability") != "verified").cast("int"))
    rates = group_rate(rows, "use", "bad").select(F.lit("use").alias("variable"), F.col("use").alias("bin"), "n", F.round("rate", 4).alias("rate"))
    doc = K.profile_document(rates, "variable", ["bin", "n", "rate"], {"n_rows": scalar(rows, F.count(F.lit(1)))})
    kind = "n_rows bigint, variables map<string, array<struct<bin: string, n: bigint, rate: double>>>"
    parsed = doc.select(F.from_json("document", kind).alias("d"))
    head = F.concat(F.lit('{"n_rows":'), F.col("d.n_rows").cast("string"), F.lit(',"n_variables":'), F.size("d.variables").cast("string"), F.lit("}"))
    return parsed.select(head.alias("head"), F.size(F.col("d.variables")["use"]).alias("n_bins"))


@query("a10_geojson_features", """
SELECT CAST(polygon_id AS BIGINT) AS polygon_id, polygon_name, 'Feature' AS kind, CAST(5 AS BIGINT) AS n_corners, round(ring[1].x, 6) AS x, round(ring[1].y, 6) AS y FROM polygons""", ("polygons",))
def _(spark, root):
    features = K.geojson_features(V.polygons(spark, root), ["polygon_id", "polygon_name"])
    kind = "type string, geometry struct<type: string, coordinates: array<array<array<double>>>>, properties map<string, string>"
    parsed = features.select("polygon_id", "polygon_name", F.from_json("feature", kind).alias("f"))
    outline = F.col("f.geometry.coordinates")[0]
    last = F.element_at(outline, -1)  # the closing corner is the first one again
    return parsed.select("polygon_id", "polygon_name", F.col("f.type").alias("kind"), F.size(outline).alias("n_corners"),
                         last[0].alias("x"), last[1].alias("y"))


@query("a12_explode_xml_rows", """
SELECT CAST(o_orderkey // 1000 AS VARCHAR) AS page, CAST(o_orderkey AS VARCHAR) AS code, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS amount FROM orders""")
def _(spark, root):
    # pages of at most 1000 rows, as the service returned them (the order key is unique)
    rows = table(spark, root, "orders").select(
        F.floor(F.col("o_orderkey") / 1000).cast("string").alias("page"), "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("amount"))
    element = F.concat(F.lit("<row><code>"), F.col("o_orderkey").cast("string"), F.lit("</code><amount>"),
                       F.col("amount").cast("string"), F.lit("</amount></row>"))
    pages = rows.groupBy("page").agg(F.concat(
        F.lit("<facts><RESULT><CODE>INFO-000</CODE></RESULT>"), F.array_join(F.collect_list(element), ""), F.lit("</facts>")).alias("xml"))
    return S.explode_xml_rows(pages, "xml", ["code", "amount"])


@query("a13_range_overlap", """
SELECT *, CASE WHEN greatest(a_from, b_from) <= least(a_to, b_to) THEN greatest(a_from, b_from) END AS shared_from,
  CASE WHEN greatest(a_from, b_from) <= least(a_to, b_to) THEN least(a_to, b_to) END AS shared_to
FROM (SELECT min(period) AS a_from, max(period) AS a_to, count(DISTINCT period) AS a_periods FROM panel) a,
  (SELECT min(quarter) AS b_from, max(quarter) AS b_to, count(DISTINCT quarter) AS b_periods FROM facts) b""", ("panel", "facts"))
def _(spark, root):
    return S.range_overlap(V.panel(spark, root), V.facts(spark, root).withColumnRenamed("quarter", "period"), "period")
