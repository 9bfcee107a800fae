"""Group reports."""

from pyspark.sql import functions as F

from lotline.catalog import views as V
from lotline.catalog.registry import query
from lotline.functions.columns import in_box
from lotline.operators import aggregates as A
from lotline.plans import products as P
from lotline.runtime import stored, table


@query("d1_group_stats", """
SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS n_customers, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean,
  min(o_totalprice) AS low, max(o_totalprice) AS high, round(stddev_samp(o_totalprice), 6) AS std, round(quantile_cont(o_totalprice, 0.5), 6) AS middle
FROM orders GROUP BY o_orderstatus""")
def _(spark, root):
    out = A.group_stats(table(spark, root, "orders"), ["o_orderstatus"], {
        "n": ("o_orderkey", "size"), "n_customers": ("o_custkey", "nunique"), "total": ("o_totalprice", "sum"),
        "mean": ("o_totalprice", "mean"), "low": ("o_totalprice", "min"), "high": ("o_totalprice", "max"),
        "std": ("o_totalprice", "std"), "middle": ("o_totalprice", "median")})
    return out.withColumn("total", F.round("total", 2))


@query("d1_overall_stats", """
SELECT count(*) AS n, round(quantile_cont(l_extendedprice, 0.5), 6) AS middle, min(l_quantity) AS low FROM lineitem""")
def _(spark, root):
    return A.group_stats(table(spark, root, "lineitem"), [], {
        "n": ("l_orderkey", "size"), "middle": ("l_extendedprice", "median"), "low": ("l_quantity", "min")})


@query("d2_conditional_share", """
SELECT use, count(floor_raw) AS n_known, count(CASE WHEN floor_raw = '1' THEN 1 END) AS n_floor1,
  round(count(CASE WHEN floor_raw = '1' THEN 1 END) / count(floor_raw), 6) AS share_floor1 FROM floor_rows GROUP BY use""", ("floor_rows",))
def _(spark, root):
    return A.conditional_share(V.floor_rows(spark, root), ["use"], "floor_raw", F.col("floor_raw") == "1", "floor1")


@query("d3_group_mode", """
SELECT p_brand, arg_min(p_type, (-n, p_type)) AS mode_p_type FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) t GROUP BY p_brand""")
def _(spark, root):
    return A.group_mode(table(spark, root, "part"), ["p_brand"], "p_type")


@query("d4_distinct_per_group", """
SELECT l_partkey, count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_values, count(DISTINCT l_suppkey) > 1 AS varies FROM lineitem GROUP BY l_partkey""")
def _(spark, root):
    return A.distinct_per_group(table(spark, root, "lineitem"), ["l_partkey"], "l_suppkey")


@query("d4_varying_share", """
SELECT count(*) AS n_groups, round(avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END), 6) AS share_multi_row, round(avg(CASE WHEN d > 1 THEN 1.0 ELSE 0 END), 6) AS share_varies
FROM (SELECT c_custkey, count(o_orderkey) AS n, count(DISTINCT o_orderpriority) AS d FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) t""")
def _(spark, root):
    return A.varying_share(A.distinct_per_group(table(spark, root, "orders"), ["o_custkey"], "o_orderpriority"))


@query("d5_frequency", """
SELECT p_brand, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10""")
def _(spark, root):
    return A.frequency(table(spark, root, "part"), "p_brand", top=10)


@query("d6_cross_tab", """
SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O,
  count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P FROM orders GROUP BY o_orderpriority""")
def _(spark, root):
    return A.cross_tab(table(spark, root, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("d6_cross_tab_normalized", """
SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS F, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END), 6) AS O,
  round(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END), 6) AS P FROM orders GROUP BY o_orderpriority""")
def _(spark, root):
    return A.cross_tab(table(spark, root, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], normalize=True)


@query("d6_cross_tab_margins", """
SELECT coalesce(o_orderpriority, 'All') AS o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O,
  count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P, count(*) AS "All" FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def _(spark, root):
    return A.cross_tab(table(spark, root, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"], margins=True)


@query("d7_drilldown", """
SELECT gu, district_id, level, n_locations, n_frequent, round(mean_rate, 6) AS mean_rate FROM (
  SELECT district_type AS gu, district_id, (1 - grouping(district_type)) + (1 - grouping(district_id)) AS level, count(*) AS n_locations,
    CAST(sum(frequent) AS BIGINT) AS n_frequent, avg(turnover_rate) AS mean_rate
  FROM (SELECT coalesce(district_type, 'unassigned') AS district_type, coalesce(district_id, 'unassigned') AS district_id, frequent, turnover_rate FROM loc) a
  GROUP BY ROLLUP (district_type, district_id)) t""", ("loc",))
def _(spark, root):
    rows = V.loc(spark, root).select(F.col("district_type").alias("gu"), "district_id", "frequent", "turnover_rate")
    return A.drilldown(rows, ["gu", "district_id"], {
        "n_locations": F.count(F.lit(1)), "n_frequent": F.sum("frequent"), "mean_rate": F.avg("turnover_rate")})


_RATE = """
SELECT {axis}, count(*) AS n, count(CASE WHEN reliability <> 'verified' THEN 1 END) AS n_flag,
  round(avg(CASE WHEN reliability <> 'verified' THEN 1.0 ELSE 0 END), 6) AS rate,
  round(avg(CASE WHEN reliability <> 'verified' THEN 1.0 ELSE 0 END) - (SELECT avg(CASE WHEN reliability <> 'verified' THEN 1.0 ELSE 0 END) FROM flagged), 6) AS deviation
FROM flagged GROUP BY {axis}"""


def _excluded(spark, root):
    return P.reliability_flags(V.floor_rows(spark, root), ratio=0.25).withColumn(
        "excluded", F.when(F.col("reliability") != "verified", 1).otherwise(0))


@query("d8_group_rate", _RATE.format(axis="use"), ("flagged",))
def _(spark, root):
    return A.group_rate(_excluded(spark, root), "use", "excluded")


@query("d8_rate_by_year", _RATE.format(axis="year"), ("flagged",))
def _(spark, root):
    return A.group_rate(_excluded(spark, root), "year", "excluded")


@query("d9_composition_shift", """
SELECT use, round(n * 100.0 / sum(n) OVER (), 6) AS before_pct, round(k * 100.0 / sum(k) OVER (), 6) AS after_pct,
  round(k * 100.0 / sum(k) OVER () - n * 100.0 / sum(n) OVER (), 6) AS shift_pp
FROM (SELECT use, count(*) AS n, count(CASE WHEN reliability = 'verified' THEN 1 END) AS k FROM flagged GROUP BY use) t""", ("flagged",))
def _(spark, root):
    rows = P.reliability_flags(V.floor_rows(spark, root), ratio=0.25).withColumn("kept", F.col("reliability") == "verified")
    return A.composition_shift(rows, "use", "kept")


@query("d10_deviation_flags", f"""
SELECT * FROM (SELECT 'use' AS axis, use AS value, n, rate, deviation FROM ({_RATE.format(axis='use')}) a
UNION ALL SELECT 'year', CAST(year AS VARCHAR), n, rate, deviation FROM ({_RATE.format(axis='year')}) b
UNION ALL SELECT 'lot', lot, n, rate, deviation FROM ({_RATE.format(axis='lot')}) c) t WHERE abs(deviation) >= 0.05""", ("flagged",))
def _(spark, root):
    rows = _excluded(spark, root)
    return A.deviation_flags({
        axis: (A.group_rate(rows, axis, "excluded"), axis) for axis in ("use", "year", "lot")}, 0.05)


# industry rows of the locations: shares as weights
V._sql("expanded", ("loc", "shares"), """
SELECT l.location_id, l.turnover_rate, l.mean_surv, l.vacancy_rate, l.frequent, s.industry, s.share,
  coalesce(district_id, 'UNASSIGNED') AS district_id, coalesce(district_type, 'outside') AS district_type
FROM loc l JOIN shares s ON l.location_id = s.location_id WHERE obs_quarters >= 15""")


def rows_of(spark, root):
    return P.industry_rows(V.loc(spark, root), V.shares(spark, root))


@query("d11_weighted_mean", """
SELECT industry, round(coalesce(sum(v * share), 0) / sum(share), 6) AS w_mean
FROM (SELECT industry, share, CASE WHEN vacancy_rate > 0 THEN vacancy_rate END AS v FROM expanded) t GROUP BY industry""", ("expanded",))
def _(spark, root):
    # a null value keeps its weight in the divisor
    rows = rows_of(spark, root).withColumn("v", F.when(F.col("vacancy_rate") > 0, F.col("vacancy_rate")))
    return A.weighted_mean(rows, ["industry"], "v", "share")


_WMEDIAN = """
SELECT {keys}, min(v) AS w_median FROM (
  SELECT {keys}, v, sum(w) OVER (PARTITION BY {keys} ORDER BY v RANGE UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY {keys}) AS total FROM ({rows}) r
  WHERE v IS NOT NULL AND w IS NOT NULL) t WHERE cum >= total / 2 - total * 1e-9 GROUP BY {keys}"""


@query("d12_weighted_median", _WMEDIAN.format(keys="o_orderpriority", rows="SELECT o_orderpriority, o_totalprice AS v, CAST(o_custkey % 11 AS DOUBLE) AS w FROM orders"))
def _(spark, root):
    rows = table(spark, root, "orders").withColumn("w", (F.col("o_custkey") % 11).cast("double"))
    return A.weighted_median(rows, ["o_orderpriority"], "o_totalprice", "w")


_BASE = """
SELECT {keys}, round(sum(share), 6) AS n_w, round(sum(share * frequent), 6) AS n_flag_w, round(sum(share * frequent) / sum(share), 6) AS flag_ratio,
  round(coalesce(sum(turnover_rate * share), 0) / sum(share), 6) AS mean_rate, round(coalesce(sum(mean_surv * share), 0) / sum(share), 6) AS avg_surv,
  round(coalesce(sum(vacancy_rate * share), 0) / sum(share), 6) AS mean_vacancy FROM expanded GROUP BY {keys}"""


def _with_medians(keys, extra=""):
    ks = keys.split(", ")
    on = lambda t: " AND ".join(f"b.{k} = {t}.{k}" for k in ks)
    rate = _WMEDIAN.format(keys=keys, rows=f"SELECT {keys}, turnover_rate AS v, share AS w FROM expanded")
    surv = _WMEDIAN.format(keys=keys, rows=f"SELECT {keys}, mean_surv AS v, share AS w FROM expanded")
    return f"""SELECT b.*{extra}, round(r.w_median, 6) AS median_rate, round(s.w_median, 6) AS median_surv FROM ({_BASE.format(keys=keys)}) b
JOIN ({rate}) r ON {on('r')} JOIN ({surv}) s ON {on('s')}"""


@query("d13_weighted_baseline_district", _with_medians(
    "district_id, district_type, industry", ", b.n_w >= 3 AS enough, b.district_id <> 'UNASSIGNED' AS real_area"), ("expanded",))
def _(spark, root):
    return P.cell_baseline(rows_of(spark, root), min_n=3)


@query("d13_weighted_baseline_type", _with_medians("district_type, industry"), ("expanded",))
def _(spark, root):
    return P.type_baseline(rows_of(spark, root))


@query("d13_conservation_check", """
SELECT round(sum(share), 6) AS sum_w, round(sum(share * frequent), 6) AS sum_flag_w, (SELECT count(*) FROM loc WHERE obs_quarters >= 15) AS n_locations,
  (SELECT CAST(sum(frequent) AS BIGINT) FROM loc WHERE obs_quarters >= 15) AS n_frequent FROM expanded""", ("expanded",))
def _(spark, root):
    places = stored(V.loc(spark, root))
    return P.conservation_check(P.industry_rows(places, V.shares(spark, root)), places)


_SPREAD = "SELECT industry, stddev_samp(w_median) AS sd FROM (" + _WMEDIAN.format(
    keys="industry, district_id", rows="SELECT industry, district_id, turnover_rate AS v, share AS w FROM expanded") + ") d GROUP BY industry"


@query("d14_industry_baseline_with_spread", f"""
SELECT i.*, round(sd, 6) AS rate_std_between_districts FROM ({_with_medians('industry')}) i JOIN ({_SPREAD}) x ON i.industry = x.industry""", ("expanded",))
def _(spark, root):
    return P.industry_baseline(rows_of(spark, root))


@query("d15_share_and_dominant", "SELECT location_id, industry, round(share, 6) AS share, rn = 1 AS is_dominant FROM shares", ("shares",))
def _(spark, root):
    return V.shares(spark, root).drop("n")


@query("d16_top_categories_text", """
SELECT c_nationkey, string_agg(c_mktsegment || '(' || n || ')', ', ' ORDER BY n DESC, c_mktsegment) AS top FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, c_mktsegment, n, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r
  FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) g) t WHERE r <= 3 GROUP BY c_nationkey""")
def _(spark, root):
    return A.top_categories_text(table(spark, root, "customer"), ["c_nationkey"], "c_mktsegment")


@query("d18_within_group_range", """
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(m) AS n_members, round(min(m), 6) AS low, round(max(m), 6) AS high, round(max(m) - min(m), 6) AS "range"
FROM (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY ALL) t GROUP BY c_nationkey""")
def _(spark, root):
    means = table(spark, root, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.avg("c_acctbal").alias("m"))
    return A.within_group_range(means, ["c_nationkey"], "m")


@query("d19_two_stage_mean", """
SELECT district_id, round(avg(amount), 6) AS amount, round(avg(n_sales), 6) AS n_sales FROM (
  SELECT district_id, quarter, sum(amount) AS amount, sum(n_sales) AS n_sales FROM facts GROUP BY ALL) t GROUP BY district_id""", ("facts",))
def _(spark, root):
    return A.two_stage_mean(V.facts(spark, root), ["district_id"], "quarter", ["amount", "n_sales"])


@query("d20_growth_and_cv", """
SELECT district_id, round(arg_max(amount, quarter) / arg_min(amount, quarter) - 1, 6) AS growth, round(stddev_samp(amount) / avg(amount), 6) AS cv
FROM (SELECT district_id, quarter, sum(amount) AS amount FROM facts GROUP BY ALL) t GROUP BY district_id""", ("facts",))
def _(spark, root):
    quarterly = V.facts(spark, root).groupBy("district_id", "quarter").agg(F.sum("amount").alias("amount"))
    return A.growth_and_cv(quarterly, ["district_id"], "quarter", "amount")


@query("d21_composition_indices", """
SELECT location_id, round(-sum(share * ln(share)), 6) AS entropy, round(sum(share * share), 6) AS hhi, round(sum(CASE WHEN rn <= 3 THEN share END), 6) AS top3_share
FROM shares GROUP BY location_id""", ("shares",))
def _(spark, root):
    return A.composition_indices(V.shares(spark, root), ["location_id"], "share")


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("d22_pivot_fill", "SELECT location_id, " + ", ".join(
    f"round(coalesce(sum(CASE WHEN industry = '{t}' THEN share END), 0), 6) AS share_{t}" for t in _TYPES) + " FROM shares GROUP BY location_id", ("shares",))
def _(spark, root):
    return A.pivot_fill(V.shares(spark, root), ["location_id"], "industry", "share", _TYPES, prefix="share_")


_DESCRIBE = """count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS "min", round(CAST(max({c}) AS DOUBLE), 6) AS "max",
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75"""


@query("d23_describe_exact", f"SELECT {_DESCRIBE.format(c='l_extendedprice')} FROM lineitem")
def _(spark, root):
    return A.describe_exact(table(spark, root, "lineitem"), "l_extendedprice")


@query("d23_describe_by_group", f"SELECT c_mktsegment, {_DESCRIBE.format(c='c_acctbal')} FROM customer GROUP BY c_mktsegment")
def _(spark, root):
    return A.describe_exact(table(spark, root, "customer"), "c_acctbal", ["c_mktsegment"])


@query("d24_set_overlap", """
SELECT count(CASE WHEN a THEN 1 END) AS n_a, count(CASE WHEN b THEN 1 END) AS n_b, count(CASE WHEN a AND b THEN 1 END) AS n_both,
  count(CASE WHEN a OR b THEN 1 END) AS n_any, round(count(CASE WHEN a AND b THEN 1 END) / count(CASE WHEN a OR b THEN 1 END), 6) AS jaccard
FROM (SELECT l_discount >= 0.05 AS a, l_quantity > 25 AS b FROM lineitem) t""")
def _(spark, root):
    rows = table(spark, root, "lineitem").select((F.col("l_discount") >= 0.05).alias("a"), (F.col("l_quantity") > 25).alias("b"))
    return A.set_overlap(rows, "a", "b")


@query("d24_key_overlap", """
SELECT count(CASE WHEN b.k IS NULL THEN 1 END) AS only_a, count(CASE WHEN a.k IS NULL THEN 1 END) AS only_b, count(CASE WHEN a.k = b.k THEN 1 END) AS "both"
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') a
FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW') b ON a.k = b.k""")
def _(spark, root):
    rows = table(spark, root, "orders")
    return A.key_overlap(rows.where("o_orderpriority = '1-URGENT'"), rows.where("o_orderpriority = '5-LOW'"), "o_custkey")


@query("d25_min_sample", """
SELECT o_custkey, count(*) AS n, count(*) >= 15 AS enough FROM orders GROUP BY o_custkey HAVING count(*) >= 10""")
def _(spark, root):
    counts = table(spark, root, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return A.min_sample(A.min_sample(counts, "n", 10), "n", 15, "enough")


@query("d26_coverage_rate", """
SELECT unnest(['floor_raw', 'total_floors']) AS "column", count(*) AS n, unnest([count(floor_raw), count(total_floors)]) AS n_known,
  unnest([round(count(floor_raw) / count(*), 6), round(count(total_floors) / count(*), 6)]) AS rate FROM floor_rows""", ("floor_rows",))
def _(spark, root):
    return A.coverage_rate(V.floor_rows(spark, root), ["floor_raw", "total_floors"])


@query("d27_group_center_offset", """
SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(CASE WHEN NOT ok THEN 1 END) AS n_bad,
  round(avg(CASE WHEN NOT ok THEN lon END) - avg(CASE WHEN ok THEN lon END), 6) AS offset_lon, round(avg(CASE WHEN NOT ok THEN lat END) - avg(CASE WHEN ok THEN lat END), 6) AS offset_lat
FROM (SELECT *, lon BETWEEN 126.8 AND 127.2 AND lat BETWEEN 37.4 AND 37.7 AS ok FROM points) t GROUP BY c_nationkey""", ("points",))
def _(spark, root):
    return A.group_center_offset(V.points(spark, root), in_box("lon", "lat", (126.8, 127.2, 37.4, 37.7)), ["c_nationkey"], ["lon", "lat"])
