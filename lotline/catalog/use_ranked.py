"""Records by rank, histories, categories, grades, samples."""

from pyspark.sql import functions as F

from lotline.catalog import views as V
from lotline.catalog.registry import query
from lotline.functions.columns import cut_bins, in_box
from lotline.operators import category as G
from lotline.operators import ranked as R
from lotline.plans.products import GRADES
from lotline.runtime import table


@query("e12_top_per_group", """
SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
QUALIFY rank <= 3""")
def _(spark, root):
    rows = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_per_group(rows, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query("e13_latest_per_key", """
SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def _(spark, root):
    return R.latest_per_key(table(spark, root, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderpriority"])


@query("e13_earliest_per_key", """
SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def _(spark, root):
    return R.earliest_per_key(table(spark, root, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderpriority"])


_COORD = "126.5 + (o_orderkey * 7919 % 8000) / 10000.0 AS lon, 37.4 + (o_orderkey * 104729 % 3000) / 10000.0 AS lat"


@query("e14_repair_representative", f"""
SELECT t.o_custkey, round(b.lon, 6) AS lon, round(b.lat, 6) AS lat, any_valid, varies FROM (
  SELECT o_custkey, bool_or(ok) AS any_valid, count(DISTINCT (lon, lat)) > 1 AS varies FROM (SELECT *, lon BETWEEN 126.7 AND 127.2 AND lat BETWEEN 37.4 AND 37.7 AS ok
    FROM (SELECT o_custkey, o_orderkey, {_COORD} FROM orders) a) c GROUP BY o_custkey) t
LEFT JOIN (SELECT * FROM (SELECT o_custkey, o_orderkey, {_COORD} FROM orders) a WHERE lon BETWEEN 126.7 AND 127.2 AND lat BETWEEN 37.4 AND 37.7
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) b ON t.o_custkey = b.o_custkey""")
def _(spark, root):
    k = F.col("o_orderkey")
    rows = table(spark, root, "orders").select(
        "o_custkey", "o_orderkey", (F.lit(126.5) + (k * 7919 % 8000) / 10000.0).alias("lon"), (F.lit(37.4) + (k * 104729 % 3000) / 10000.0).alias("lat"))
    return R.repair_representative(rows, ["o_custkey"], "o_orderkey", ["lon", "lat"], in_box("lon", "lat"))


@query("e15_representative_row", """
SELECT p_brand, area, use, year, area_total, n_rows FROM (
  SELECT p_brand, p_retailprice AS area, p_type AS use, CAST(p_size AS BIGINT) AS year, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r,
    round(sum(p_retailprice) OVER (PARTITION BY p_brand), 6) AS area_total, count(*) OVER (PARTITION BY p_brand) AS n_rows FROM part) t WHERE r = 1""")
def _(spark, root):
    rows = table(spark, root, "part").withColumnsRenamed({"p_retailprice": "area", "p_type": "use", "p_size": "year"})
    return R.representative_row(rows, ["p_brand"], "area", ["use", "year"], "p_partkey")


@query("e17_value_history", """
SELECT h.o_custkey, h.o_orderstatus, first_q, last_q, changed FROM (SELECT o_custkey, o_orderstatus, min(CAST(strftime(o_orderdate, '%Y%m') AS BIGINT)) AS first_q, max(CAST(strftime(o_orderdate, '%Y%m') AS BIGINT)) AS last_q
  FROM orders GROUP BY ALL) h JOIN (SELECT o_custkey, count(DISTINCT o_orderstatus) > 1 AS changed FROM orders GROUP BY o_custkey) c ON h.o_custkey = c.o_custkey""")
def _(spark, root):
    rows = table(spark, root, "orders").withColumn("period", F.date_format("o_orderdate", "yyyyMM").cast("int"))
    return R.value_history(rows, ["o_custkey"], ["o_orderstatus"], "period")


@query("e17_value_history_runs", """
SELECT location_id, shop_id, "start" AS first_q, "end" AS last_q, (SELECT count(DISTINCT shop_id) > 1 FROM panel p WHERE p.location_id = e.location_id) AS changed
FROM episodes e""", ("panel", "episodes"))
def _(spark, root):
    return R.value_history(V.panel(spark, root), ["location_id"], ["shop_id"], "period", runs=True)


# category system: the names of the part types change from 1998 on
V._sql("cat", (), """
SELECT CONCAT('S', CAST(l_partkey AS VARCHAR)) AS shop_id, CAST(year(l_shipdate) * 100 + quarter(l_shipdate) * 3 AS BIGINT) AS period,
  CASE WHEN year(l_shipdate) >= 1998 THEN concat('N_', CASE WHEN p_type = 'PROMO' AND l_linenumber < 4 THEN 'SMALL' ELSE p_type END) ELSE p_type END AS mid,
  CASE WHEN year(l_shipdate) >= 1998 THEN 'new ' ELSE 'old ' END || CASE WHEN p_type IN ('LARGE', 'MEDIUM', 'SMALL') THEN 'sized' ELSE 'other' END AS major
FROM lineitem JOIN part ON l_partkey = p_partkey""")


def categories(spark, root):
    rows = table(spark, root, "lineitem").join(table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey"))
    new = F.year("l_shipdate") >= 1998
    moved = F.when((F.col("p_type") == "PROMO") & (F.col("l_linenumber") < 4), "SMALL").otherwise(F.col("p_type"))
    return rows.select(
        F.concat(F.lit("S"), F.col("l_partkey").cast("string")).alias("shop_id"), V.quarter("l_shipdate").alias("period"),
        F.when(new, F.concat(F.lit("N_"), moved)).otherwise(F.col("p_type")).alias("mid"),
        F.concat(F.when(new, "new ").otherwise("old "), F.when(F.col("p_type").isin("LARGE", "MEDIUM", "SMALL"), "sized").otherwise("other")).alias("major"))


@query("e19_detect_category_revision", """
WITH s AS (SELECT period, list(DISTINCT mid) AS c FROM cat GROUP BY period), p AS (SELECT period, c, lag(c) OVER (ORDER BY period) AS b FROM s)
SELECT min(period) AS revision FROM p WHERE b IS NOT NULL AND len(list_filter(c, lambda x: NOT list_contains(b, x))) + len(list_filter(b, lambda x: NOT list_contains(c, x))) >= 3""",
       ("cat",))
def _(spark, root):
    return G.detect_category_revision(categories(spark, root), "period", "mid")


V._sql("comp", ("cat",), "SELECT shop_id, major, mid, min(period) AS first_q, max(period) AS last_q FROM cat GROUP BY ALL")
V._sql("crosswalk", ("comp",), """
SELECT a.mid AS old_category, b.mid AS new_category, count(*) AS n_keys, count(*) / sum(count(*)) OVER (PARTITION BY a.mid) AS share,
  row_number() OVER (PARTITION BY a.mid ORDER BY count(*) DESC, b.mid) AS r
FROM (SELECT * FROM comp WHERE first_q < 199803 QUALIFY row_number() OVER (PARTITION BY shop_id ORDER BY last_q DESC, mid DESC) = 1) a
JOIN (SELECT * FROM comp WHERE last_q >= 199803 QUALIFY row_number() OVER (PARTITION BY shop_id ORDER BY first_q, mid) = 1) b ON a.shop_id = b.shop_id
GROUP BY a.mid, b.mid""")


@query("e20_category_crosswalk", """
SELECT old_category, new_category, n_keys, round(share, 6) AS share, share < 0.5 AS weak FROM crosswalk WHERE r = 1""", ("crosswalk",))
def _(spark, root):
    comp = G.compress(categories(spark, root), "shop_id", "period", ["major", "mid"])
    return G.category_crosswalk(comp, "shop_id", "mid", [], 199803)


@query("e20_apply_crosswalk", """
WITH last AS (SELECT shop_id, max((last_q, first_q, mid)) AS any_r, max((last_q, first_q, mid)) FILTER (last_q >= 199803) AS new_r FROM comp GROUP BY shop_id),
m AS (SELECT mid, arg_min(major, (-n, major)) AS major FROM (SELECT mid, major, count(*) AS n FROM comp WHERE last_q >= 199803 GROUP BY ALL) t GROUP BY mid),
f AS (SELECT shop_id, coalesce(struct_extract(new_r, 3), new_category, struct_extract(any_r, 3)) AS mid FROM last LEFT JOIN (SELECT * FROM crosswalk WHERE r = 1) c
  ON struct_extract(any_r, 3) = old_category)
SELECT shop_id, f.mid, coalesce(m.major, 'other') AS major FROM f LEFT JOIN m ON f.mid = m.mid""", ("comp", "crosswalk"))
def _(spark, root):
    comp = G.compress(categories(spark, root), "shop_id", "period", ["major", "mid"])
    walk = G.category_crosswalk(comp, "shop_id", "mid", [], 199803)
    return G.apply_crosswalk(comp, walk, "shop_id", "mid", "major", 199803)


_CASE = "CASE WHEN pct <= 0.1 THEN 'very_safe' WHEN pct <= 0.3 THEN 'safe' WHEN pct <= 0.7 THEN 'normal' WHEN pct <= 0.9 THEN 'risky' ELSE 'very_risky' END"


@query("e21_grade", f"""
SELECT o_orderkey, {_CASE} AS grade FROM (SELECT o_orderkey, row_number() OVER (ORDER BY floor(o_totalprice / 1000), o_orderkey) / count(*) OVER () AS pct FROM orders) t""")
def _(spark, root):
    rows = table(spark, root, "orders").withColumn("score", F.floor(F.col("o_totalprice") / 1000).cast("double"))
    return R.grade(rows, "score", "o_orderkey", GRADES).select("o_orderkey", "grade")


@query("e21_grade_fixed_edges", """
SELECT o_orderkey, CASE WHEN o_totalprice <= 100000 THEN 'very_safe' WHEN o_totalprice <= 200000 THEN 'safe' WHEN o_totalprice <= 300000 THEN 'normal'
  WHEN o_totalprice <= 400000 THEN 'risky' ELSE 'very_risky' END AS grade FROM orders""")
def _(spark, root):
    edges = [-1, 100000, 200000, 300000, 400000, 1e12]
    return R.grade(table(spark, root, "orders"), "o_totalprice", "o_orderkey", GRADES, edges=edges).select("o_orderkey", "grade")


@query("e22_cut_bins", """
SELECT bin_idx, label, count(*) AS n FROM (SELECT CAST(CASE WHEN p_size <= 4 THEN 0 WHEN p_size <= 9 THEN 1 WHEN p_size <= 19 THEN 2 ELSE 3 END AS BIGINT) AS bin_idx,
  CASE WHEN p_size <= 4 THEN '1-4' WHEN p_size <= 9 THEN '5-9' WHEN p_size <= 19 THEN '10-19' ELSE '20+' END AS label FROM part) t GROUP BY ALL""")
def _(spark, root):
    bins = cut_bins("p_size", [0, 4, 9, 19, 1e9], ["1-4", "5-9", "10-19", "20+"])
    return table(spark, root, "part").select(bins.alias("b")).groupBy("b.bin_idx", "b.label").agg(F.count(F.lit(1)).alias("n"))


@query("e22_quantile_bins", """
WITH e AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM lineitem)
SELECT CAST(len(list_filter(q, lambda z: z < l_extendedprice)) AS BIGINT) AS bin_idx, count(*) AS n FROM lineitem, e GROUP BY 1""")
def _(spark, root):
    out = R.quantile_bins(table(spark, root, "lineitem"), "l_extendedprice", 5)
    return out.groupBy("bin.bin_idx").agg(F.count(F.lit(1)).alias("n"))


@query("f1_sort_by", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, abs(c_acctbal) DESC")
def _(spark, root):
    return R.sort_by(table(spark, root, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), [("c_mktsegment", "asc"), ("c_acctbal", "abs")])


@query("f2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(spark, root):
    return R.top_n(table(spark, root, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")], 20)


@query("f3_distinct_on", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def _(spark, root):
    return R.distinct_on(table(spark, root, "lineitem"), ["l_suppkey", "l_returnflag"])


@query("f4_union_named", """
SELECT 'supplier' AS kind, s_suppkey AS id, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_mktsegment FROM customer""")
def _(spark, root):
    a = table(spark, root, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = table(spark, root, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return R.union_named([a, b])


@query("f5_key_set_ops", """
SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS side
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k""")
def _(spark, root):
    rows = table(spark, root, "orders")
    return R.key_set_ops(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'P'"), "o_custkey")


_HASH = "CAST(concat('0x', substr(md5(concat('42|', CAST({k} AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0"


@query("f6_sample_groups", f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM lineitem WHERE {_HASH.format(k='l_partkey')} < 0.2")
def _(spark, root):
    return R.sample_groups(table(spark, root, "lineitem"), ["l_partkey"], 0.2).select("l_orderkey", "l_linenumber", "l_partkey")


@query("f7_sample_rows", f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey LIMIT 100")
def _(spark, root):
    return R.sample_rows(table(spark, root, "orders"), "o_orderkey", n=100).select("o_orderkey", "o_totalprice")


_RECS = """
recs AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY rate DESC, n DESC, item) AS rank
FROM (SELECT {by}, c_mktsegment AS item, avg(ok) AS rate, count(*) AS n FROM src GROUP BY {by}, c_mktsegment HAVING count(*) >= {n}) g)"""
V._sql("src", (), """
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, o_orderpriority, c_mktsegment, CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS ok
FROM orders JOIN customer ON o_custkey = c_custkey""")


def _outcomes(spark, root):
    return table(spark, root, "orders").join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        "c_nationkey", "o_orderpriority", "c_mktsegment", F.when(F.col("o_totalprice") > 300000, 1).otherwise(0).alias("ok"))


@query("f8_recommend_top_k", "WITH " + _RECS.format(by="c_nationkey, o_orderpriority", n=25).strip() + """
SELECT c_nationkey, o_orderpriority, item AS c_mktsegment, n, round(rate, 6) AS rate, rank FROM recs WHERE rank <= 3""", ("src",))
def _(spark, root):
    return R.recommend_top_k(_outcomes(spark, root), ["c_nationkey", "o_orderpriority"], "c_mktsegment", "ok", 3, 25, ["c_nationkey"])[0]


@query("f8_recommendations_with_fallback", "WITH " + _RECS.format(by="c_nationkey, o_orderpriority", n=35).strip().replace("recs AS", "a AS") + ", "
       + _RECS.format(by="c_nationkey", n=35).strip().replace("recs AS", "b AS") + """,
cells AS (SELECT DISTINCT c_nationkey, o_orderpriority FROM src),
fa AS (SELECT c_nationkey, o_orderpriority, string_agg(item, ',' ORDER BY rank) AS items FROM a WHERE rank <= 3 GROUP BY ALL),
fb AS (SELECT c_nationkey, string_agg(item, ',' ORDER BY rank) AS items FROM b WHERE rank <= 3 GROUP BY ALL)
SELECT c.c_nationkey, c.o_orderpriority, coalesce(fa.items, fb.items) AS items, CASE WHEN fa.items IS NOT NULL THEN 'full' ELSE 'fallback' END AS basis
FROM cells c LEFT JOIN fa ON c.c_nationkey = fa.c_nationkey AND c.o_orderpriority = fa.o_orderpriority LEFT JOIN fb ON c.c_nationkey = fb.c_nationkey""", ("src",))
def _(spark, root):
    rows = _outcomes(spark, root)
    keys, coarse = ["c_nationkey", "o_orderpriority"], ["c_nationkey"]
    full, floor = R.recommend_top_k(rows, keys, "c_mktsegment", "ok", 3, 35, coarse)
    out = R.recommendations_for(rows.select(*keys).distinct(), full, floor, keys, coarse, "c_mktsegment")
    return out.select(*keys, F.array_join(F.transform("recommended", lambda r: r["item"]), ",").alias("items"), "basis")


@query("f9_alternatives", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal, c_custkey) AS r FROM customer)
SELECT a.c_custkey, string_agg(CAST(b.c_custkey AS VARCHAR), ',' ORDER BY b.r) AS others FROM r a LEFT JOIN r b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment
  AND b.r <= 4 AND b.c_custkey <> a.c_custkey AND (b.r <= 3 OR a.r <= 3) GROUP BY a.c_custkey""")
def _(spark, root):
    out = R.alternatives(table(spark, root, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey", "c_acctbal", 3)
    others = F.array_join(F.transform("alternatives", lambda a: a["id"].cast("string")), ",")
    return out.select("c_custkey", F.nullif(others, F.lit("")).alias("others"))


@query("f10_nested_history", """
SELECT location_id, string_agg(concat(shop_id, ':', "start", '-', "end", ':', surv_q), ';' ORDER BY "start") AS history FROM episodes GROUP BY location_id""", ("episodes",))
def _(spark, root):
    out = R.nested_history(V.episodes(spark, root), ["location_id"], "start", ["end", "shop_id", "surv_q"])
    text = F.transform("history", lambda e: F.concat(
        e["shop_id"], F.lit(":"), e["start"].cast("string"), F.lit("-"), e["end"].cast("string"), F.lit(":"), e["surv_q"].cast("string")))
    return out.select("location_id", F.array_join(text, ";").alias("history"))
