"""Joins (C1-C13) and spatial operators."""

from pyspark.sql import functions as F

from lotline.catalog import views as V
from lotline.catalog.registry import query
from lotline.functions.columns import cut_bins
from lotline.operators import episodes as E
from lotline.operators import joins as J
from lotline.operators import spatial as S
from lotline.runtime import table


@query("c1_attach", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o_custkey = c_custkey")
def _(spark, root):
    dim = table(spark, root, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.attach(table(spark, root, "orders").select("o_orderkey", "o_custkey"), dim, ["o_custkey"])


@query("c2_inner_on", """
SELECT parcel, floor, period, l.shop_id, s.state FROM snapshot l JOIN (SELECT DISTINCT location_id, shop_id, state FROM episodes WHERE state = 'open') s
ON concat(l.parcel, '_', l.floor, '_1') = s.location_id AND l.shop_id = s.shop_id""", ("snapshot", "episodes"))
def _(spark, root):
    rows = V.snapshot(spark, root).withColumn("location_id", F.concat_ws("_", "parcel", "floor", F.lit("1")))
    side = V.episodes(spark, root).where("state = 'open'").select("location_id", "shop_id", "state").distinct()
    return J.inner_on(rows, side, ["location_id", "shop_id"]).select("parcel", "floor", "period", "shop_id", "state")


@query("c2_usage_check", """
SELECT use, count(*) AS n_rows, round(avg(CASE WHEN floor_raw = '1' THEN 1.0 ELSE 0.0 END), 6) AS floor1_share, round(avg(total_floors), 6) AS mean_floors
FROM floor_rows WHERE matched AND total_floors >= 5 AND floor_raw IS NOT NULL GROUP BY use""", ("floor_rows",))
def _(spark, root):
    rows = V.floor_rows(spark, root).where("matched and total_floors >= 5 and floor_raw is not null")
    return rows.groupBy("use").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg((F.col("floor_raw") == "1").cast("double")).alias("floor1_share"),
        F.avg("total_floors").alias("mean_floors"))


@query("c3_outer_features", """
SELECT coalesce(a.k, b.k, c.k) AS k, n_urgent, n_low, round(mean_price, 6) AS mean_price FROM
  (SELECT o_custkey AS k, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) a
  FULL JOIN (SELECT o_custkey AS k, count(*) AS n_low FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) b ON a.k = b.k
  FULL JOIN (SELECT o_custkey AS k, avg(o_totalprice) AS mean_price FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) c ON coalesce(a.k, b.k) = c.k""")
def _(spark, root):
    rows = table(spark, root, "orders").withColumnRenamed("o_custkey", "k")
    a = rows.where("o_orderpriority = '1-URGENT'").groupBy("k").agg(F.count(F.lit(1)).alias("n_urgent"))
    b = rows.where("o_orderpriority = '5-LOW'").groupBy("k").agg(F.count(F.lit(1)).alias("n_low"))
    c = rows.where("o_orderstatus = 'P'").groupBy("k").agg(F.avg("o_totalprice").alias("mean_price"))
    return J.outer_features([a, b, c], ["k"])


@query("c4_lookup", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, p_type, CAST(p_size AS BIGINT) AS p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def _(spark, root):
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return J.lookup(rows, table(spark, root, "part"), "p_partkey", ["p_type", "p_size"]).withColumnRenamed("p_partkey", "l_partkey")


_PAIRS = "SELECT l_partkey, l_suppkey FROM lineitem GROUP BY ALL HAVING count(*) >= 2"


def _pairs(spark, root):
    return table(spark, root, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("c5_keep_in", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM lineitem SEMI JOIN ({_PAIRS}) p USING (l_partkey, l_suppkey)")
def _(spark, root):
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.keep_in(rows, _pairs(spark, root), ["l_partkey", "l_suppkey"])


@query("c5_keep_not_in", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey FROM lineitem ANTI JOIN ({_PAIRS}) p USING (l_partkey, l_suppkey)")
def _(spark, root):
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return J.keep_not_in(rows, _pairs(spark, root), ["l_partkey", "l_suppkey"])


@query("c5_flag_in", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS has_open FROM customer""")
def _(spark, root):
    keys = table(spark, root, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return J.flag_in(table(spark, root, "customer").select("c_custkey"), keys, ["c_custkey"], "has_open")


@query("c6_join_with_fallback", """
WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal FROM customer),
cell AS (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS v FROM c GROUP BY ALL HAVING count(*) >= 12),
kind AS (SELECT c_mktsegment, avg(c_acctbal) AS v FROM c WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL)
SELECT c_custkey, round(coalesce(cell.v, kind.v), 6) AS mean_balance, CASE WHEN cell.v IS NOT NULL THEN 'cell' WHEN kind.v IS NOT NULL THEN 'type' ELSE 'none' END AS basis
FROM c LEFT JOIN cell USING (c_nationkey, c_mktsegment) LEFT JOIN kind USING (c_mktsegment)""")
def _(spark, root):
    rows = table(spark, root, "customer")
    mean = F.avg("c_acctbal").alias("mean_balance")
    cell = rows.groupBy("c_nationkey", "c_mktsegment").agg(mean, F.count(F.lit(1)).alias("n")).where("n >= 12")
    kind = rows.where("c_mktsegment <> 'BUILDING'").groupBy("c_mktsegment").agg(mean)
    return J.join_with_fallback(
        rows, [(cell, ["c_nationkey", "c_mktsegment"], "cell"), (kind, ["c_mktsegment"], "type")], ["mean_balance"]
    ).select("c_custkey", "mean_balance", "basis")


V._sql("edges", ("polygons",), """
SELECT polygon_id, polygon_name, unnest(list_transform(range(1, len(ring) + 1), lambda i: {'ax': ring[i].x, 'ay': ring[i].y,
  'bx': ring[i % len(ring) + 1].x, 'by': ring[i % len(ring) + 1].y})) AS e FROM polygons""")
V._sql("within_polygon", ("points", "edges"), """
SELECT point_id, polygon_id, polygon_name FROM points, edges GROUP BY ALL
HAVING count(CASE WHEN (e.ay > y) <> (e.by > y) AND x < (e.bx - e.ax) * (y - e.ay) / (e.by - e.ay) + e.ax THEN 1 END) % 2 = 1""")


@query("c7_points_in_polygons", """
SELECT p.point_id, w.polygon_id, w.polygon_name FROM points p LEFT JOIN (
  SELECT point_id, CAST(min(polygon_id) AS BIGINT) AS polygon_id, arg_min(polygon_name, polygon_id) AS polygon_name FROM within_polygon GROUP BY point_id) w
ON p.point_id = w.point_id""", ("points", "within_polygon"))
def _(spark, root):
    return S.points_in_polygons(V.points(spark, root), V.polygons(spark, root), point_id="point_id", polygon_id="polygon_id",
                                keep=["polygon_name"]).select("point_id", "polygon_id", "polygon_name")


V._sql("polygon_distance", ("points", "edges", "within_polygon"), """
SELECT point_id, polygon_id, CASE WHEN EXISTS (SELECT 1 FROM within_polygon w WHERE w.point_id = d.point_id AND w.polygon_id = d.polygon_id) THEN 0.0 ELSE m END AS m
FROM (SELECT point_id, polygon_id, min(sqrt(pow(x - (e.ax + t * (e.bx - e.ax)), 2) + pow(y - (e.ay + t * (e.by - e.ay)), 2))) AS m
  FROM (SELECT *, greatest(0.0, least(1.0, ((x - e.ax) * (e.bx - e.ax) + (y - e.ay) * (e.by - e.ay))
      / (pow(e.bx - e.ax, 2) + pow(e.by - e.ay, 2)))) AS t FROM points, edges) s GROUP BY ALL) d""")


@query("c8_nearest_polygon", """
SELECT point_id, CAST(arg_min(polygon_id, (round(m, 6), polygon_id)) AS BIGINT) AS polygon_id, round(min(m), 6) AS distance_m FROM polygon_distance GROUP BY point_id""",
       ("polygon_distance",))
def _(spark, root):
    return S.nearest_polygon(V.points(spark, root), V.polygons(spark, root), point_id="point_id", polygon_id="polygon_id").select(
        "point_id", "polygon_id", "distance_m")


_EDGES = [0, 50, 100, 200, 500, 1000, 5000, 20000, 200000]
_LABELS = ["0-50m", "50-100m", "100-200m", "200-500m", "500m-1km", "1-5km", "5-20km", "20km+"]


@query("c8_distance_buckets", """
SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN m <= 50 THEN '0-50m' WHEN m <= 100 THEN '50-100m' WHEN m <= 200 THEN '100-200m'
  WHEN m <= 500 THEN '200-500m' WHEN m <= 1000 THEN '500m-1km' WHEN m <= 5000 THEN '1-5km' WHEN m <= 20000 THEN '5-20km' ELSE '20km+' END AS bucket
  FROM (SELECT point_id, min(m) AS m FROM polygon_distance GROUP BY point_id) a) b GROUP BY bucket""", ("polygon_distance",))
def _(spark, root):
    near = S.nearest_polygon(V.points(spark, root), V.polygons(spark, root), point_id="point_id", polygon_id="polygon_id")
    return near.groupBy(cut_bins("distance_m", _EDGES, _LABELS, include_lowest=True)["label"].alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_HAV = """2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
  + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"""


@query("c9_nearest_point", f"""
SELECT point_id, arg_min(station, (d, station)) AS station, round(min(d), 6) AS distance_m
FROM (SELECT a.point_id, b.station, {_HAV} AS d FROM points a, stations b) t GROUP BY point_id""", ("points", "stations"))
def _(spark, root):
    return S.nearest_point(V.points(spark, root), V.stations(spark, root), point_id="point_id", target="station").select(
        "point_id", "station", "distance_m")


@query("c10_count_within", f"""
SELECT a.point_id, count(b.point_id) - 1 AS density FROM points a JOIN points b ON {_HAV} <= 1000 GROUP BY a.point_id""", ("points",))
def _(spark, root):
    rows = V.points(spark, root)
    return S.count_within(rows, rows, radius_m=1000.0, name="density", exclude_self=True).select("point_id", "density")


@query("c10_stations_within", f"""
SELECT a.point_id, count(b.station) AS n_stations FROM points a LEFT JOIN stations b ON {_HAV} <= 1500 GROUP BY a.point_id""", ("points", "stations"))
def _(spark, root):
    return S.count_within(V.points(spark, root), V.stations(spark, root), radius_m=1500.0, name="n_stations").select("point_id", "n_stations")


@query("c11_expand_span", """
SELECT e.location_id, e.episode_id, g.period, g.idx FROM episodes e JOIN grid g ON g.period BETWEEN e."start" AND e."end" """, ("episodes", "grid"))
def _(spark, root):
    return J.expand_span(V.episodes(spark, root), "start", "end", V.grid(spark, root)).select(
        "location_id", "episode_id", "period", "idx")


@query("c12_pair_before_after", """
WITH comp AS (SELECT o_custkey AS k, o_orderpriority AS cat, min(year(o_orderdate)) AS first_q, max(year(o_orderdate)) AS last_q FROM orders GROUP BY ALL)
SELECT a.k, a.cat AS cat_old, b.cat AS cat_new FROM
  (SELECT k, cat FROM comp WHERE first_q < 1998 QUALIFY row_number() OVER (PARTITION BY k ORDER BY last_q DESC, cat DESC) = 1) a
  JOIN (SELECT k, cat FROM comp WHERE last_q >= 1998 QUALIFY row_number() OVER (PARTITION BY k ORDER BY first_q, cat) = 1) b ON a.k = b.k""")
def _(spark, root):
    comp = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("cat")).agg(
        F.min(F.year("o_orderdate")).alias("first_q"), F.max(F.year("o_orderdate")).alias("last_q"))
    return J.pair_before_after(comp, "k", "first_q", "last_q", ["cat"], 1998)


_BOX = "min(e.ax) AS min_x, min(e.ay) AS min_y, max(e.ax) AS max_x, max(e.ay) AS max_y"


@query("c13_polygon_bounds", f"SELECT CAST(polygon_id AS BIGINT) AS polygon_id, {_BOX} FROM edges GROUP BY polygon_id", ("edges",))
def _(spark, root):
    return S.polygon_bounds(V.polygons(spark, root), "polygon_id")[0]


@query("c13_total_bounds", f"SELECT count(DISTINCT polygon_id) AS n_polygons, {_BOX} FROM edges", ("edges",))
def _(spark, root):
    return S.polygon_bounds(V.polygons(spark, root), "polygon_id")[1]
