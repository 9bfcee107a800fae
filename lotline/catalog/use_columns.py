"""Keys, tokens, cleaning, data-quality reports."""

from pyspark.sql import functions as F

from lotline.catalog import views as V
from lotline.catalog.registry import query
from lotline.functions import columns as C
from lotline.operators import cleaning as K
from lotline.plans import products as P
from lotline.runtime import table


@query("b1_padded_key", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') || CAST(CASE WHEN l_linenumber > 4 THEN l_linenumber ELSE 1 END AS VARCHAR)
  || lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(4, len(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0') || lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 4, '0') AS parcel_key
FROM lineitem""")
def _(spark, root):
    kind = F.when(F.col("l_linenumber") > 4, F.col("l_linenumber").cast("string")).otherwise("unknown")
    key = C.build_padded_key([("l_suppkey", 10, 0), (kind, 1, 1), ("l_partkey", 4, 0), ("l_quantity", 4, 0)])
    return table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", key.alias("parcel_key"))


@query("b2_reverse_code_map", """
SELECT CAST(s_nationkey AS BIGINT) AS s_nationkey, c_mktsegment, arg_min(code, (-n, code)) AS code FROM (
  SELECT c_nationkey AS s_nationkey, c_mktsegment, c_custkey % 7 AS code, count(*) AS n FROM customer GROUP BY ALL) t GROUP BY ALL
""")
def _(spark, root):
    rows = table(spark, root, "customer").select(
        F.col("c_nationkey").alias("s_nationkey"), "c_mktsegment", (F.col("c_custkey") % 7).alias("code"))
    return K.reverse_code_map(rows, ["s_nationkey", "c_mktsegment"], "code")


@query("b3_strip_prefix", "SELECT c_custkey, trim(replace(c_name, 'Customer#', '')) AS bare FROM customer")
def _(spark, root):
    return table(spark, root, "customer").select("c_custkey", C.strip_prefix("c_name", "Customer#").alias("bare"))


@query("b4_value_map", """
SELECT p_partkey, CAST(CASE p_type WHEN 'PROMO' THEN 2 WHEN 'SMALL' THEN 1 ELSE 0 END AS BIGINT) AS kind FROM part""")
def _(spark, root):
    return table(spark, root, "part").select("p_partkey", C.value_map("p_type", {"PROMO": 2, "SMALL": 1}, 0).alias("kind"))


_TOKEN = """CASE l_linenumber WHEN 1 THEN 'B' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 2 THEN '0' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)
  WHEN 3 THEN NULL WHEN 4 THEN '지' WHEN 5 THEN ' nan ' WHEN 6 THEN '반' ELSE '0' END"""


def _token():
    q = F.col("l_quantity").cast("bigint").cast("string")
    n = F.col("l_linenumber")
    return (F.when(n == 1, F.concat(F.lit("B"), q)).when(n == 2, F.concat(F.lit("0"), q)).when(n == 3, None)
            .when(n == 4, "지").when(n == 5, " nan ").when(n == 6, "반").otherwise("0"))


@query("b5_normalize_token", f"""
SELECT token, floor, count(*) AS n FROM (
  SELECT token, CASE WHEN token IS NULL OR trim(token) = '' OR lower(trim(token)) = 'nan' THEN 'nan'
    WHEN token = '지' THEN '지하1' WHEN token = '반' THEN '반지하' WHEN token LIKE 'B%' THEN '지하' || substr(token, 2)
    WHEN regexp_full_match(token, '0+[0-9]+') THEN ltrim(token, '0') ELSE token END AS floor
  FROM (SELECT {_TOKEN} AS token FROM lineitem) a) b GROUP BY ALL""")
def _(spark, root):
    rows = table(spark, root, "lineitem").select(_token().alias("token"))
    return rows.groupBy("token", C.normalize_token("token").alias("floor")).agg(F.count(F.lit(1)).alias("n"))


@query("b6_split_code_by_limit", """
SELECT p_partkey, code, p_size, CASE WHEN k IS NULL THEN substr(code, 1, 1) ELSE CAST(CAST(substr(code, 1, k) AS BIGINT) AS VARCHAR) END AS floor,
  substr(code, coalesce(k, 1) + 1) AS unit
FROM (SELECT *, list_filter([9, 8, 7, 6, 5, 4, 3, 2, 1], lambda n: n < len(code) AND CAST(substr(code, 1, n) AS BIGINT) BETWEEN 1 AND p_size)[1] AS k
  FROM (SELECT p_partkey, CAST(p_partkey * 7 + 100 AS VARCHAR) AS code, CAST(p_size AS BIGINT) AS p_size FROM part) a) b""")
def _(spark, root):
    rows = table(spark, root, "part").withColumn("code", (F.col("p_partkey") * 7 + 100).cast("string"))
    floor, unit = C.split_code_by_limit("code", "p_size")
    return rows.select("p_partkey", "code", "p_size", floor.alias("floor"), unit.alias("unit"))


@query("b7_exceed_limit_count", """
SELECT count(*) AS n_rows, count(CASE WHEN CAST(floor_raw AS INTEGER) > total_floors THEN 1 END) AS n_exceeding FROM floor_rows""",
       ("floor_rows",))
def _(spark, root):
    return K.exceed_limit_count(V.floor_rows(spark, root), "floor_raw", "total_floors")


RELIABILITY = """
SELECT f.*, CASE WHEN NOT matched THEN 'unmatched' WHEN floor_raw IS NULL THEN 'no_floor'
  WHEN f.parcel IN (SELECT parcel FROM floor_rows WHERE matched GROUP BY parcel HAVING max(total_floors) >= 5
    AND avg(CASE WHEN floor_raw = '1' THEN 1.0 ELSE 0.0 END) >= 0.25) THEN 'floor1_skew' ELSE 'verified' END AS reliability
FROM floor_rows f"""
V._sql("flagged", ("floor_rows",), RELIABILITY)


def flagged(spark, root):
    return P.reliability_flags(V.floor_rows(spark, root), ratio=0.25)


@query("b8_flag_cascade", "SELECT reliability, use, count(*) AS n FROM flagged GROUP BY ALL", ("flagged",))
def _(spark, root):
    return flagged(spark, root).groupBy("reliability", "use").agg(F.count(F.lit(1)).alias("n"))


@query("g1_reliability_flags", "SELECT reliability, parcel, count(*) AS n FROM flagged GROUP BY ALL", ("flagged",))
def _(spark, root):
    return flagged(spark, root).groupBy("reliability", "parcel").agg(F.count(F.lit(1)).alias("n"))


@query("b9_floor_category", f"""
SELECT floor, CASE WHEN floor = 'nan' THEN 'missing' WHEN floor LIKE '지하%' OR floor LIKE '반지%' THEN 'basement'
    WHEN CAST(floor AS DOUBLE) = 1 THEN 'floor1' WHEN CAST(floor AS DOUBLE) >= 2 THEN 'floor2+' ELSE 'basement' END AS floor_class,
  CASE WHEN floor = 'nan' THEN NULL WHEN floor LIKE '반지%' THEN -0.5
    WHEN floor LIKE '지하%' THEN CASE WHEN CAST(substr(floor, 3) AS DOUBLE) <= 10 THEN -CAST(substr(floor, 3) AS DOUBLE) END
    ELSE CAST(floor AS DOUBLE) END AS floor_no, count(*) AS n
FROM (SELECT CASE WHEN token IS NULL OR trim(token) = '' OR lower(trim(token)) = 'nan' THEN 'nan'
    WHEN token = '지' THEN '지하1' WHEN token = '반' THEN '반지하' WHEN token LIKE 'B%' THEN '지하' || substr(token, 2)
    WHEN regexp_full_match(token, '0+[0-9]+') THEN ltrim(token, '0') ELSE token END AS floor
  FROM (SELECT {_TOKEN} AS token FROM lineitem) a) b GROUP BY ALL""")
def _(spark, root):
    rows = table(spark, root, "lineitem").select(C.normalize_token(_token()).alias("floor"))
    return rows.groupBy("floor", C.floor_category("floor").alias("floor_class"), C.floor_number("floor").alias("floor_no")).agg(
        F.count(F.lit(1)).alias("n"))


@query("b10_parse_location_id", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CAST(l_suppkey AS VARCHAR) AS parcel, 'B_' || CAST(l_partkey % 6 AS VARCHAR) AS floor, CAST(l_linenumber AS VARCHAR) AS slot
FROM lineitem""")
def _(spark, root):
    rows = table(spark, root, "lineitem").withColumn("loc", C.location_id(
        F.col("l_suppkey").cast("string"), F.concat(F.lit("B_"), (F.col("l_partkey") % 6).cast("string")), "l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[c.alias(n) for n, c in C.parse_location_id("loc").items()])


@query("b11_normalize_code", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS code,
  CASE WHEN o_orderstatus = 'P' THEN '<NA>' ELSE CAST(o_custkey AS VARCHAR) END AS code_text FROM orders""")
def _(spark, root):
    raw = F.when(F.col("o_orderstatus") == "P", "UNASSIGNED").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
    return table(spark, root, "orders").select(
        "o_orderkey", C.normalize_code(raw).alias("code"), C.normalize_code(raw, "<NA>").alias("code_text"))


@query("b12_rare_to_other", """
WITH t AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'N' || CAST(c_nationkey AS VARCHAR) END AS use FROM customer),
k AS (SELECT use FROM t WHERE use IS NOT NULL GROUP BY use HAVING count(*) / (SELECT count(use) FROM t) >= 0.04)
SELECT c_custkey, CASE WHEN use IS NULL THEN 'missing' WHEN use IN (SELECT use FROM k) THEN use ELSE 'other' END AS use FROM t""")
def _(spark, root):
    rows = table(spark, root, "customer").select("c_custkey", F.when(
        F.col("c_acctbal") >= 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("use"))
    return K.rare_to_other(rows, "use", 0.04)


@query("b13_range_filters", """
SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points WHERE lon BETWEEN 126.8 AND 127.0 AND lat BETWEEN 37.45 AND 37.6""",
       ("points",))
def _(spark, root):
    return V.points(spark, root).where(C.in_box("lon", "lat", (126.8, 127.0, 37.45, 37.6))).select("point_id", "lon", "lat")


@query("b14_null_out_invalid", """
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, CASE WHEN l_extendedprice <= 0 OR l_extendedprice > 1000000
    OR (l_extendedprice > l_quantity * 100 * greatest(l_linenumber, 1) * 3 AND l_quantity * 100 > 0) THEN NULL ELSE l_extendedprice END AS area,
  CASE WHEN year(l_shipdate) - 98 BETWEEN 1900 AND 2026 THEN year(l_shipdate) - 98 END AS approval_year
FROM lineitem""")
def _(spark, root):
    rows = table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("area"), (F.col("l_quantity") * 100).alias("footprint"),
        F.col("l_linenumber").alias("floors_up"), F.lit(None).cast("int").alias("floors_down"),
        (F.year("l_shipdate") - 98).alias("approval_year"))
    return K.null_out_invalid(rows, K.building_rules()).select("l_orderkey", "l_linenumber", "l_partkey", "area", "approval_year")


@query("b15_pick_columns_by_pattern", "SELECT s_name AS name, s_acctbal AS lon, CAST(s_suppkey AS DOUBLE) AS lat FROM supplier")
def _(spark, root):
    # station file whose coordinate columns carry other names and are swapped (median of "lat" above 90)
    rows = table(spark, root, "supplier").select(
        F.col("s_name").alias("Station_NM"), F.col("s_acctbal").alias("POINT_LATITUDE"), F.col("s_suppkey").cast("double").alias("POINT_LNG"))
    return K.pick_columns_by_pattern(rows, {"lat": ["lat", "ycode"], "lon": ["lon", "lng"], "name": ["station", "name"]})


@query("b16_brand_key", "SELECT p_partkey, replace(p_name, ' ', '') AS brand FROM part")
def _(spark, root):
    name = F.concat(
        F.when(F.col("p_type") == "PROMO", "[event] ").otherwise(""), F.initcap("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"),
        F.when(F.col("p_size") > 40, " 강남").when(F.col("p_size") > 25, " 강남점").otherwise(""))
    branch = F.when(F.col("p_size") > 40, "강남")
    return table(spark, root, "part").select("p_partkey", C.brand_key(name, branch).alias("brand"))


@query("b17_derived_columns", """
SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log_price, round(o_totalprice / nullif(o_custkey % 4, 0), 6) AS per_unit,
  least(greatest(o_totalprice, 50000.0), 300000.0) AS clipped, (year(o_orderdate) * 100 + quarter(o_orderdate) * 3) // 100 AS year FROM orders""")
def _(spark, root):
    return table(spark, root, "orders").select(
        "o_orderkey", C.log1p_col("o_totalprice").alias("log_price"), C.ratio("o_totalprice", F.col("o_custkey") % 4).alias("per_unit"),
        C.clip_col("o_totalprice", 50000.0, 300000.0).alias("clipped"), C.period_year(V.quarter("o_orderdate")).alias("year"))


@query("b18_dropna_report", """
SELECT unnest(['price', 'code']) AS "column", unnest([count(*) - count(price), count(*) - count(code)]) AS n_null,
  count(CASE WHEN price IS NULL OR code IS NULL THEN 1 END) AS n_lost, count(*) AS n_rows
FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, CASE WHEN o_orderpriority <> '5-LOW' THEN 1 END AS code FROM orders) t""")
def _(spark, root):
    rows = table(spark, root, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", 1).alias("code"))
    return K.dropna_report(rows, ["price", "code"])[1]


@query("b19_zero_variance_columns", """
SELECT unnest(['price', 'constant']) AS "column", unnest([round(stddev_samp(o_totalprice), 6), 0.0]) AS std, unnest([false, true]) AS zero FROM orders""")
def _(spark, root):
    rows = table(spark, root, "orders").select(F.col("o_totalprice").alias("price"), (F.col("o_orderkey") * 0 + 7).alias("constant"))
    return K.zero_variance_columns(rows, ["price", "constant"])


@query("b20_membership_report", """
SELECT c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS in_other, count(*) AS n_rows,
  count(CASE WHEN c_acctbal < 0 THEN 1 END) AS null_balance FROM customer GROUP BY 1""")
def _(spark, root):
    a = table(spark, root, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    b = table(spark, root, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return K.membership_report(a, b, "c_custkey", ["balance"])


@query("b21_text_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')")
def _(spark, root):
    return table(spark, root, "part").where(C.text_contains("p_name", "ring")).select("p_partkey", "p_name")


@query("a11_quarter_code", """
SELECT o_orderkey, year(o_orderdate) * 10
    + CASE WHEN quarter(o_orderdate) = 4 AND o_orderstatus = 'P' THEN 5 ELSE quarter(o_orderdate) END AS raw, CASE WHEN quarter(o_orderdate) < 4 OR o_orderstatus <> 'P'
  THEN year(o_orderdate) * 100 + quarter(o_orderdate) * 3 END AS period FROM orders""")
def _(spark, root):
    q = F.quarter("o_orderdate")
    raw = F.year("o_orderdate") * 10 + F.when((q == 4) & (F.col("o_orderstatus") == "P"), 5).otherwise(q)
    return table(spark, root, "orders").select("o_orderkey", raw.alias("raw"), C.quarter_code(raw).alias("period"))
