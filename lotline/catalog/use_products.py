"""Location, district and industry products."""

from pyspark.sql import functions as F

from lotline.catalog import views as V
from lotline.catalog.registry import query
from lotline.catalog.use_aggregates import rows_of
from lotline.operators import aggregates as A
from lotline.operators import episodes as E
from lotline.operators import ranked as R
from lotline.operators.joins import attach
from lotline.plans import products as P
from lotline.runtime import stored, table


@query("g4_ratio_by_area", """
SELECT gu, count(*) AS n_all, CAST(sum(frequent) AS BIGINT) AS n_subset, round(avg(frequent), 6) AS ratio FROM loc WHERE obs_quarters >= 15 GROUP BY gu""", ("loc",))
def _(spark, root):
    return P.ratio_by_area(V.loc(spark, root).where("obs_quarters >= 15"), "frequent", "gu")


V._sql("vac_base", ("loc",), """
SELECT district_id, count(*) AS n_area, avg(vacancy_rate) AS area_vacancy FROM loc WHERE district_id IS NOT NULL GROUP BY district_id""")
V._sql("vac_types", ("loc", "vac_base"), """
SELECT l.location_id, l.gu, l.district_id, n_area, area_vacancy, CASE WHEN area_vacancy IS NULL THEN 'unclassified'
  WHEN area_vacancy >= (SELECT quantile_cont(area_vacancy, 0.5) FROM vac_base) - 1e-12 THEN 'stagnant' ELSE 'competitive' END AS vacancy_type
FROM loc l LEFT JOIN vac_base b ON l.district_id = b.district_id WHERE l.frequent = 1""")


@query("g5_vacancy_types", "SELECT location_id, district_id, n_area, round(area_vacancy, 6) AS area_vacancy, vacancy_type FROM vac_types", ("vac_types",))
def _(spark, root):
    places = stored(V.loc(spark, root))
    return P.vacancy_types(places, places.where("frequent = 1"), ["district_id"]).select(
        "location_id", "district_id", "n_area", "area_vacancy", "vacancy_type")


@query("g5_vacancy_type_summary", """
SELECT gu, vacancy_type, count(*) AS n, round(avg(area_vacancy), 6) AS mean_vacancy FROM vac_types GROUP BY ALL""", ("vac_types",))
def _(spark, root):
    places = stored(V.loc(spark, root))
    return P.vacancy_types(places, places.where("frequent = 1"), ["district_id"]).groupBy("gu", "vacancy_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("area_vacancy").alias("mean_vacancy"))


@query("g5_duplicate_keys", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def _(spark, root):
    return P.duplicate_keys(table(spark, root, "lineitem"), "l_orderkey")


@query("g6_full_locations", """
SELECT l.location_id, l.obs_quarters, l.turnover_cnt, round(l.vacancy_rate, 6) AS vacancy_rate, dominant_ind, round(s.x, 6) AS x, round(s.y, 6) AS y,
  p.polygon_id AS district_id, p.polygon_name AS district_name, p.polygon_id IS NOT NULL AS assigned, l.frequent
FROM loc l JOIN stations s ON CAST(s.station_id AS VARCHAR) = l.parcel LEFT JOIN (
  SELECT station_id, CAST(min(polygon_id) AS BIGINT) AS polygon_id, arg_min(polygon_name, polygon_id) AS polygon_name FROM (
    SELECT station_id, polygon_id, polygon_name FROM stations, edges GROUP BY ALL
    HAVING count(CASE WHEN (e.ay > y) <> (e.by > y) AND x < (e.bx - e.ax) * (y - e.ay) / (e.by - e.ay) + e.ax THEN 1 END) % 2 = 1) w GROUP BY station_id) p
ON p.station_id = s.station_id""", ("loc", "stations", "edges"))
def _(spark, root):
    eps = V.episodes(spark, root)
    cal = E.calendar(V.grid(spark, root))
    vac = E.vacancy(eps, cal, key=["location_id"]).select("location_id", "vacancy_rate")
    dominant = V.shares(spark, root).where("is_dominant").select("location_id", F.col("industry").alias("dominant_ind"))
    metrics = E.location_metrics(eps, key=["location_id"])
    sites = V.stations(spark, root).select(F.col("station_id").cast("string").alias("parcel"), "x", "y")
    coords = metrics.select("location_id", F.substring_index("location_id", "_", 1).alias("parcel")).join(sites, "parcel").drop("parcel")
    out = P.full_locations(metrics, coords, vac, dominant, V.polygons(spark, root), max_mean=2.0)
    return out.select("location_id", "obs_quarters", "turnover_cnt", "vacancy_rate", "dominant_ind", "x", "y", "district_id",
                      "district_name", "assigned", "frequent")


V._sql("named", ("loc",), """
SELECT * REPLACE (coalesce(district_id, 'UNASSIGNED') AS district_id, coalesce(district_type, 'outside') AS district_type) FROM loc WHERE obs_quarters >= 15""")
V._sql("area_base", ("named",), """
SELECT district_id, district_type, count(*) AS n_locations, CAST(sum(frequent) AS BIGINT) AS n_frequent, avg(turnover_rate) AS mean_rate,
  quantile_cont(turnover_rate, 0.5) AS median_rate, avg(mean_surv) AS avg_surv, quantile_cont(mean_surv, 0.5) AS median_surv, avg(vacancy_rate) AS mean_vacancy,
  count(CASE WHEN vacancy_rate > 0 THEN 1 END) AS n_vacant, count(vacancy_rate) AS n_vacancy_known, min(first_q) AS from_q, max(last_q) AS to_q
FROM named GROUP BY ALL""")


@query("g7_area_baseline", """
SELECT b.district_id, b.district_type, n_locations, n_frequent, round(mean_rate, 6) AS mean_rate, round(median_rate, 6) AS median_rate, round(avg_surv, 6) AS avg_surv,
  round(median_surv, 6) AS median_surv, round(mean_vacancy, 6) AS mean_vacancy, n_vacant, n_vacancy_known, from_q, to_q, round(n_frequent / n_locations, 6) AS frequent_ratio,
  round(n_vacant / nullif(n_vacancy_known, 0), 6) AS vacant_ratio, n_locations >= 30 AS enough, b.district_id <> 'UNASSIGNED' AS real_area, top_industries
FROM area_base b JOIN (SELECT district_id, district_type, string_agg(dominant_ind || '(' || n || ')', ', ' ORDER BY n DESC, dominant_ind) AS top_industries FROM (
  SELECT *, row_number() OVER (PARTITION BY district_id, district_type ORDER BY n DESC, dominant_ind) AS r
  FROM (SELECT district_id, district_type, dominant_ind, count(*) AS n FROM named GROUP BY ALL) c) t WHERE r <= 3 GROUP BY ALL) i
ON b.district_id = i.district_id AND b.district_type = i.district_type""", ("area_base", "named"))
def _(spark, root):
    return P.area_baseline(V.loc(spark, root))


V._sql("rel", ("named", "area_base", "expanded"), f"""
SELECT n.*, n.district_id <> 'UNASSIGNED' AS real_area, b.mean_rate AS area_rate, b.avg_surv AS area_surv, coalesce(c.mean_rate, t.mean_rate) AS adj_rate,
  CASE WHEN c.mean_rate IS NOT NULL THEN c.avg_surv ELSE t.avg_surv END AS adj_surv,
  CASE WHEN n.district_id = 'UNASSIGNED' THEN 'outside mean (' ELSE '' END || CASE WHEN c.mean_rate IS NOT NULL THEN 'district x industry' WHEN t.mean_rate IS NOT NULL THEN 'type x industry' ELSE 'none' END
  || CASE WHEN n.district_id = 'UNASSIGNED' THEN ')' ELSE '' END AS basis
FROM named n LEFT JOIN area_base b ON n.district_id = b.district_id
LEFT JOIN (SELECT district_id, industry, coalesce(sum(turnover_rate * share), 0) / sum(share) AS mean_rate, coalesce(sum(mean_surv * share), 0) / sum(share) AS avg_surv
  FROM expanded GROUP BY district_id, district_type, industry HAVING sum(share) >= 4) c ON n.district_id = c.district_id AND n.dominant_ind = c.industry
LEFT JOIN (SELECT district_type, industry, coalesce(sum(turnover_rate * share), 0) / sum(share) AS mean_rate, coalesce(sum(mean_surv * share), 0) / sum(share) AS avg_surv
  FROM expanded GROUP BY district_type, industry) t ON n.district_type = t.district_type AND n.dominant_ind = t.industry""")


def relative(spark, root):
    places = stored(V.loc(spark, root))
    expanded = P.industry_rows(places, V.shares(spark, root))
    mean = lambda keys: expanded.groupBy(*keys).agg(
        F.sum("share").alias("n_w"), A.weighted_mean_expr("turnover_rate", "share").alias("mean_rate"),
        A.weighted_mean_expr("mean_surv", "share").alias("avg_surv"))
    cell = A.min_sample(mean(["district_id", "district_type", "industry"]), "n_w", 4, "enough")
    return P.relative_metrics(places, P.area_baseline(places), cell, mean(["district_type", "industry"]))


_CLASS = """CASE WHEN turnover_rate - adj_rate > 0 AND NOT mean_surv - adj_surv > 0 THEN 'more turnover, shorter survival'
  WHEN turnover_rate - adj_rate > 0 THEN 'more turnover, longer survival' WHEN turnover_rate - adj_rate IS NULL OR mean_surv - adj_surv IS NULL THEN 'unclassified'
  WHEN NOT mean_surv - adj_surv > 0 THEN 'less turnover, shorter survival' ELSE 'less turnover, longer survival' END"""


@query("g8_relative_metrics", f"""
SELECT location_id, district_id, dominant_ind, basis, round(turnover_rate - area_rate, 6) AS rel_rate, round(mean_surv - area_surv, 6) AS rel_surv,
  round(turnover_rate - adj_rate, 6) AS adj_rel_rate, round(mean_surv - adj_surv, 6) AS adj_rel_surv, {_CLASS} AS class FROM rel""", ("rel",))
def _(spark, root):
    return relative(spark, root).select(
        "location_id", "district_id", "dominant_ind", "basis", "rel_rate", "rel_surv", "adj_rel_rate", "adj_rel_surv", "class")


@query("c6_industry_adjusted_basis", "SELECT basis, count(*) AS n FROM rel GROUP BY basis", ("rel",))
def _(spark, root):
    return relative(spark, root).groupBy("basis").agg(F.count(F.lit(1)).alias("n"))


@query("g8_relative_candidates", """
SELECT location_id, round(area_rate, 6) AS area_rate, round(turnover_rate - adj_rate, 6) AS adj_rel_rate FROM rel
WHERE real_area AND area_rate <= (SELECT quantile_cont(area_rate, 0.25) + 1e-12 FROM rel WHERE real_area)
  AND turnover_rate - adj_rate > (SELECT quantile_cont(turnover_rate - adj_rate, 0.9) FROM rel WHERE real_area)""", ("rel",))
def _(spark, root):
    return P.relative_candidates(stored(relative(spark, root))).select("location_id", "area_rate", "adj_rel_rate")


@query("g9_compare_assigned", f"""
SELECT real_area, class, n, round(n / sum(n) OVER (PARTITION BY real_area), 6) AS share
FROM (SELECT real_area, {_CLASS} AS class, count(*) AS n FROM rel GROUP BY ALL) t""", ("rel",))
def _(spark, root):
    return P.compare_assigned(relative(spark, root), "real_area", "class", ["turnover_rate"])[0]


@query("g9_assigned_means", """
SELECT district_id IS NOT NULL AS assigned, count(*) AS n, round(avg(turnover_rate), 6) AS turnover_rate, round(avg(mean_surv), 6) AS mean_surv FROM loc GROUP BY 1""", ("loc",))
def _(spark, root):
    rows = V.loc(spark, root).withColumn("assigned", F.col("district_id").isNotNull()).withColumn("class", F.lit("x"))
    return P.compare_assigned(rows, "assigned", "class", ["turnover_rate", "mean_surv"])[1]


V._sql("riskb", ("loc",), """
SELECT *, turnover_rate - area_turnover_rate AS excess_turnover_rate, turnover_cnt - area_turnover_cnt AS excess_turnover_cnt FROM (
  SELECT l.*, count(*) OVER w AS n_area, avg(turnover_rate) OVER w AS area_turnover_rate, avg(turnover_cnt) OVER w AS area_turnover_cnt
  FROM loc l WHERE obs_quarters >= 15 AND district_id IS NOT NULL WINDOW w AS (PARTITION BY district_id)) t WHERE n_area >= 10""")
V._sql("riskl", ("riskb",), """
SELECT *, CAST(CASE WHEN excess_turnover_rate >= (SELECT quantile_cont(excess_turnover_rate, 0.9) - 1e-12 FROM riskb) THEN 1 ELSE 0 END AS BIGINT) AS risk,
  CAST(CASE WHEN excess_turnover_cnt >= (SELECT quantile_cont(excess_turnover_cnt, 0.9) - 1e-12 FROM riskb) THEN 1 ELSE 0 END AS BIGINT) AS risk_cnt,
  CAST(CASE WHEN excess_turnover_rate >= (SELECT quantile_cont(excess_turnover_rate, 0.95) - 1e-12 FROM riskb) THEN 1 ELSE 0 END AS BIGINT) AS top5 FROM riskb""")


@query("g10_risk_base", """
SELECT location_id, district_id, n_area, round(excess_turnover_rate, 6) AS excess_turnover_rate, risk, risk_cnt AS risk_turnover_cnt, top5 FROM riskl""", ("riskl",))
def _(spark, root):
    return P.risk_base(stored(V.loc(spark, root)))[0].select(
        "location_id", "district_id", "n_area", "excess_turnover_rate", "risk", "risk_turnover_cnt", "top5")


@query("g10_threshold_summary", " UNION ALL ".join(f"""
SELECT '{b}' AS basis, CAST(sum({r}) AS BIGINT) AS n_risk, round(avg({r}), 6) AS risk_share, round(avg(CASE WHEN {r} = 1 THEN mean_surv END), 6) AS risk_mean_surv,
  round(quantile_cont(CASE WHEN {r} = 1 THEN mean_surv END, 0.5), 6) AS risk_median_surv, min(CASE WHEN {r} = 1 THEN turnover_cnt END) AS risk_min_turnover,
  round(quantile_cont(CASE WHEN {r} = 1 THEN turnover_cnt END, 0.5), 6) AS risk_median_turnover, round(avg(CASE WHEN {r} = 0 THEN mean_surv END), 6) AS rest_mean_surv,
  round((SELECT quantile_cont(excess_{b}, 0.9) FROM riskb), 6) AS q90, round((SELECT quantile_cont(excess_{b}, 0.95) FROM riskb), 6) AS q95 FROM riskl"""
    for b, r in (("turnover_rate", "risk"), ("turnover_cnt", "risk_cnt"))), ("riskl",))
def _(spark, root):
    return P.risk_base(stored(V.loc(spark, root)))[1]


@query("d24_label_overlap", """
SELECT CAST(sum(risk) AS BIGINT) AS n_a, CAST(sum(risk_cnt) AS BIGINT) AS n_b, CAST(sum(risk * risk_cnt) AS BIGINT) AS n_both,
  CAST(sum(greatest(risk, risk_cnt)) AS BIGINT) AS n_any, round(sum(risk * risk_cnt) / sum(greatest(risk, risk_cnt)), 6) AS jaccard FROM riskl""", ("riskl",))
def _(spark, root):
    return A.set_overlap(P.risk_base(stored(V.loc(spark, root)))[0], "risk_turnover_rate", "risk_turnover_cnt")


# district facts by kind: visitors per day part, workers and residents from customers of the nation
V._sql("visitors", (), """
SELECT n_name AS district_id, CAST(year(o_orderdate) * 100 + quarter(o_orderdate) * 3 AS BIGINT) AS quarter, CAST(count(*) AS DOUBLE) AS total,
  CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE) AS female, """ + ", ".join(
    f"CAST(count(CASE WHEN o_orderpriority LIKE '{i}-%' THEN 1 END) AS DOUBLE) AS part_{i}" for i in range(1, 6)) + """
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")


def visitors(spark, root):
    return (
        table(spark, root, "orders").join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("district_id"), V.quarter("o_orderdate").alias("quarter")).agg(
            F.count(F.lit(1)).cast("double").alias("total"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("female"),
            *[F.count_if(F.col("o_orderpriority").startswith(f"{i}-")).cast("double").alias(f"part_{i}") for i in range(1, 6)])
    )


_PARTS = range(1, 6)


@query("g11_area_profile", f"""
WITH q AS (SELECT district_id, quarter, sum(amount) AS amount, sum(n_sales) AS n_sales, sum(weekend_amount) AS weekend_amount, sum(night_amount) AS night_amount
  FROM facts WHERE quarter BETWEEN 199603 AND 200012 GROUP BY ALL),
s AS (SELECT district_id, avg(amount) AS sales, avg(n_sales) AS n_sales, avg(weekend_amount) AS we, avg(night_amount) AS ni, arg_max(amount, quarter) / arg_min(amount, quarter) - 1 AS growth,
  stddev_samp(amount) / avg(amount) AS cv FROM q GROUP BY district_id),
v AS (SELECT district_id, avg(total) AS total, avg(female) AS female, {', '.join(f'avg(part_{i}) AS part_{i}' for i in _PARTS)} FROM visitors WHERE quarter BETWEEN 199603 AND 200012 GROUP BY district_id),
r AS (SELECT district_id, avg(part_1 + part_2) AS total, avg(part_1) / avg(part_1 + part_2) AS apartment_ratio FROM visitors WHERE quarter BETWEEN 199603 AND 200012 GROUP BY district_id)
SELECT v.district_id, round(v.total, 6) AS visitors, round(ln(1 + v.total), 6) AS visitors_log, round(female / v.total, 6) AS visitor_female_ratio,
  {', '.join(f'round(part_{i} / v.total, 6) AS ratio_part_{i}' for i in _PARTS)}, round({' - '.join(['0'] + [f'part_{i} / v.total * ln(part_{i} / v.total)' for i in _PARTS])}, 6) AS visitor_entropy,
  round(female, 6) AS workers, round(ln(1 + female), 6) AS workers_log, round(r.total, 6) AS residents, round(apartment_ratio, 6) AS apartment_ratio, round(sales, 6) AS sales,
  round(ln(1 + sales), 6) AS sales_log, round(sales / n_sales, 6) AS amount_per_sale, round(we / sales, 6) AS weekend_ratio, round(ni / sales, 6) AS night_ratio, round(growth, 6) AS growth,
  round(cv, 6) AS cv, round(v.total / r.total, 6) AS visitors_per_resident, round(female / r.total, 6) AS workers_per_resident, round(sales / v.total, 6) AS sales_per_visitor
FROM v JOIN r ON v.district_id = r.district_id JOIN s ON v.district_id = s.district_id""", ("facts", "visitors"))
def profile(spark, root):
    v = visitors(spark, root)
    workers = v.select("district_id", "quarter", F.col("female").alias("total"))
    both = F.col("part_1") + F.col("part_2")
    residents = v.select("district_id", "quarter", both.alias("total"), both.alias("households"), F.col("part_1").alias("apartments"))
    return P.area_profile(V.facts(spark, root), v, workers, residents, (199603, 200012))


@query("g12_final_profile")
def _(spark, root):
    expanded = rows_of(spark, root)
    cells = expanded.where(F.col("district_id") != P.UNASSIGNED).groupBy("district_id", "industry").agg(F.sum("share").alias("n_w"))
    return P.final_profile(profile(spark, root), cells, ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"], cells)


@query("g12_industry_composition", """
WITH c AS (SELECT district_id, industry, sum(share) AS w FROM expanded WHERE district_id <> 'UNASSIGNED' GROUP BY ALL),
s AS (SELECT district_id, industry, w / sum(w) OVER (PARTITION BY district_id) AS p, sum(w) OVER (PARTITION BY district_id) AS t FROM c)
SELECT district_id, round(ln(1 + max(t)), 6) AS size_log, round(-sum(p * ln(p)), 6) AS entropy, round(sum(p * p), 6) AS hhi FROM s GROUP BY district_id""", ("expanded",))
def _(spark, root):
    cells = rows_of(spark, root).where(F.col("district_id") != P.UNASSIGNED).groupBy("district_id", "industry").agg(F.sum("share").alias("n_w"))
    total = cells.groupBy("district_id").agg(F.sum("n_w").alias("_t"))
    share = cells.join(total, "district_id").withColumn("share", F.col("n_w") / F.col("_t"))
    return A.composition_indices(share, ["district_id"], "share").drop("top3_share").join(
        total.select("district_id", F.log1p("_t").alias("size_log")), "district_id")


def features(spark, root):
    """Location table joined with building data of its site; points of the site spread by floor."""
    places = stored(V.loc(spark, root))
    base = places.join(V.stations(spark, root).select(F.col("station_id").alias("site"), "lon", "lat"), "site")
    base = base.withColumn("lat", F.col("lat") + F.col("floor").cast("double") / 20000.0)
    parts = table(spark, root, "part").withColumn("parcel", F.substring("p_brand", 7, 2))
    parts = parts.withColumnsRenamed({"p_retailprice": "area", "p_type": "use", "p_size": "floors_up"}).withColumn(
        "approval_year", F.lit(1970) + F.col("floors_up"))
    buildings = R.representative_row(parts, ["parcel"], "area", ["floors_up", "use", "approval_year"], "p_partkey").drop("n_rows")
    registry = parts.groupBy("parcel").agg(F.max("floors_up").alias("total_floors"))
    registry = attach(registry, A.group_mode(parts, ["parcel"], "use", "registry_use"), ["parcel"])
    universe = base.select("location_id", "parcel", "lon", "lat")
    return places, P.location_features(base, universe, buildings, registry, V.stations(spark, root), density_m=2000.0, station_m=1500.0)


_HAV = """2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"""
V._sql("feat", ("loc", "stations"), f"""
WITH a AS (SELECT l.*, lon, lat + CAST(l.floor AS DOUBLE) / 20000.0 AS lat FROM loc l JOIN stations s ON s.station_id = l.site),
bld AS (SELECT substr(p_brand, 7, 2) AS parcel, p_retailprice AS area, p_size, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1),
tot AS (SELECT substr(p_brand, 7, 2) AS parcel, sum(p_retailprice) AS area_total FROM part GROUP BY 1),
d AS (SELECT a.location_id, count(*) - 1 AS density_200m FROM a JOIN a b ON {_HAV} <= 2000 GROUP BY a.location_id),
n AS (SELECT a.location_id, arg_min(b.station, (round({_HAV}, 6), b.station)) AS nearest_station, min({_HAV}) AS station_m, count(CASE WHEN {_HAV} <= 1500 THEN 1 END) AS stations_500m
  FROM a, stations b GROUP BY a.location_id)
SELECT a.location_id, CASE WHEN floor = '1' THEN 'floor1' ELSE 'floor2+' END AS floor_class, CAST(floor AS DOUBLE) AS floor_no, p_type AS use_raw, coalesce(p_type, 'missing') AS use_class,
  area, area_total, CAST(p_size AS BIGINT) AS floors, CAST(2025 - (1970 + p_size) AS BIGINT) AS age, count(*) OVER (PARTITION BY a.parcel) AS n_in_building,
  density_200m, station_m, nearest_station, stations_500m, coalesce(district_type, 'missing') AS district_type
FROM a LEFT JOIN bld ON a.parcel = bld.parcel LEFT JOIN tot ON a.parcel = tot.parcel JOIN d ON a.location_id = d.location_id JOIN n ON a.location_id = n.location_id""")


@query("g13_location_features", """
SELECT * REPLACE (round(station_m, 6) AS station_m, round(area, 6) AS area, round(area_total, 6) AS area_total) FROM feat""", ("feat",))
def _(spark, root):
    return features(spark, root)[1]


V._sql("customers2", ("risk",), """
SELECT *, CASE WHEN n_orders <= 1 THEN '1' WHEN n_orders <= 3 THEN '2-3' WHEN n_orders <= 9 THEN '4-9' WHEN n_orders <= 29 THEN '10-29' ELSE '30+' END AS bin FROM risk""")


@query("g14_risk_profile", """
WITH q AS (SELECT quantile_cont(balance, [0.2, 0.4, 0.6, 0.8]) AS q FROM risk),
b AS (SELECT 'segment' AS variable, segment AS bin, label FROM risk UNION ALL
  SELECT 'n_in_building', CASE WHEN n_orders > 0 THEN bin ELSE 'missing' END, label FROM customers2 UNION ALL
  SELECT 'balance', 'q' || (1 + len(list_filter(q, lambda z: z < balance))), label FROM risk, q)
SELECT variable, bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_risk, round(avg(label), 6) AS rate, round(avg(label) / (SELECT avg(label) FROM risk), 6) AS lift,
  round(count(*) / (SELECT count(*) FROM risk), 6) AS share, round(sum(label) / (SELECT sum(label) FROM risk), 6) AS risk_share FROM b GROUP BY ALL""", ("risk", "customers2"))
def _(spark, root):
    rows = stored(V.risk(spark, root).withColumn("n_in_building", F.col("n_orders")))
    return P.risk_profile(rows, ["segment", "n_in_building", "balance"], "label")


@query("g15_segment_risk", """
SELECT district, segment, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_risk, round(avg(label), 6) AS rate, round(avg(label) / (SELECT avg(label) FROM risk), 6) AS lift
FROM (SELECT label, segment, CAST(district AS BIGINT) AS district FROM risk) t GROUP BY ALL HAVING count(*) >= 12""", ("risk",))
def _(spark, root):
    return P.segment_risk(V.risk(spark, root), ["district", "segment"], "label", 12)


@query("g16_map_documents", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY district_id, fc ORDER BY turnover_rate, location_id) AS r FROM (
  SELECT location_id, district_id, turnover_rate, CASE WHEN floor = '1' THEN 'floor1' ELSE 'floor2+' END AS fc FROM loc WHERE district_id IS NOT NULL) t)
SELECT a.location_id, a.district_id, (SELECT count(*) FROM episodes e WHERE e.location_id = a.location_id) AS n_history,
  (SELECT string_agg(b.location_id, ',' ORDER BY b.r) FROM r b WHERE b.district_id = a.district_id AND b.fc = a.fc AND b.location_id <> a.location_id AND b.r <= CASE WHEN a.r <= 3 THEN 4 ELSE 3 END) AS others
FROM r a""", ("loc", "episodes"))
def _(spark, root):
    from lotline.functions.columns import floor_category

    places = V.loc(spark, root).where("district_id is not null").withColumn("floor_class", floor_category("floor"))
    history = R.nested_history(V.episodes(spark, root), ["location_id"], "start", ["end", "shop_id", "surv_q", "state"])
    outcomes = V.records(spark, root).groupBy("location_id", "industry").agg(F.count(F.lit(1)).alias("n"))
    best = outcomes.groupBy("location_id").agg(F.max(F.struct("n", "industry")).alias("recommended"))
    docs = P.map_documents(places, history, best, score="turnover_rate")
    names = F.array_join(F.transform("alternatives", lambda a: a["id"]), ",")
    return docs.select("location_id", "district_id", F.size("history").alias("n_history"), F.nullif(names, F.lit("")).alias("others"))


@query("g16_area_documents", """
WITH g AS (SELECT district_id, turnover_rate, row_number() OVER (ORDER BY turnover_rate, site * 10 + CAST(floor AS BIGINT)) / count(*) OVER () AS pct FROM loc WHERE district_id IS NOT NULL AND turnover_rate IS NOT NULL),
l AS (SELECT district_id, turnover_rate, CASE WHEN pct <= 0.1 THEN 'very_safe' WHEN pct <= 0.3 THEN 'safe' WHEN pct <= 0.7 THEN 'normal' WHEN pct <= 0.9 THEN 'risky' ELSE 'very_risky' END AS g FROM g)
SELECT district_id, count(*) AS n_locations, round(avg(turnover_rate), 6) AS mean_score, """ + ", ".join(
    f"count(CASE WHEN g = '{x}' THEN 1 END) AS {x}" for x in P.GRADES) + """, count(CASE WHEN g IN ('risky', 'very_risky') THEN 1 END) AS n_risky,
  count(CASE WHEN g IN ('safe', 'very_safe') THEN 1 END) AS n_safe FROM l GROUP BY district_id""", ("loc",))
def _(spark, root):
    rows = V.loc(spark, root).where("district_id is not null").withColumn("tie", F.col("site") * 10 + F.col("floor").cast("bigint"))
    # the score is rounded so that both engines see equal ties
    graded = R.grade(stored(rows), "turnover_rate", "tie", P.GRADES)
    return P.area_document_summary(graded, "district_id", "grade", "turnover_rate")


V._sql("stores", (), """
SELECT c_custkey AS store_id, concat(CASE WHEN c_acctbal > 0 THEN 'Shop ' ELSE 'Cafe ' END, c_mktsegment, ' (x)') AS name,
  CASE WHEN o_urgent THEN concat('b', c_nationkey) END AS branch, CAST(c_nationkey AS BIGINT) AS gu
FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderpriority = '1-URGENT') AS o_urgent FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
V._sql("brands", ("stores",), """
SELECT *, CASE WHEN n_stores >= 10 AND n_areas >= 3 AND branch_share >= 0.87 THEN 'branch rule' WHEN n_stores >= 100 AND n_areas >= 20 AND branch_share >= 0.15 THEN 'large brand rule' ELSE '' END AS reason
FROM (SELECT lower(replace(replace(name, '(x)', ''), ' ', '')) AS brand, count(*) AS n_stores, count(DISTINCT gu) AS n_areas,
  avg(CASE WHEN branch IS NOT NULL THEN 1.0 ELSE 0 END) AS branch_share, min(name) AS example FROM stores GROUP BY 1) t""")


def stores(spark, root):
    urgent = table(spark, root, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("u"))
    rows = table(spark, root, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select(
        F.col("c_custkey").alias("store_id"), F.concat(F.when(F.col("c_acctbal") > 0, "Shop ").otherwise("Cafe "), "c_mktsegment", F.lit(" (x)")).alias("name"),
        F.when(F.col("u"), F.concat(F.lit("b"), F.col("c_nationkey").cast("string"))).alias("branch"), F.col("c_nationkey").alias("gu"))


_RULES = (("branch rule", 10, 3, 0.87), ("large brand rule", 100, 20, 0.15))


@query("g17_flag_franchise", """
SELECT store_id, lower(replace(replace(name, '(x)', ''), ' ', '')) AS brand, CAST(CASE WHEN reason <> '' THEN 1 ELSE 0 END AS BIGINT) AS franchise
FROM stores s JOIN brands b ON lower(replace(replace(name, '(x)', ''), ' ', '')) = b.brand""", ("stores", "brands"))
def _(spark, root):
    return P.flag_franchise(stores(spark, root), rules=_RULES)[0]


@query("g17_franchise_brands", """
SELECT brand, n_stores, n_areas, round(branch_share, 6) AS branch_share, example, reason, CAST(CASE WHEN reason <> '' THEN 1 ELSE 0 END AS BIGINT) AS franchise FROM brands""", ("brands",))
def _(spark, root):
    return P.flag_franchise(stores(spark, root), rules=_RULES)[1]


V._sql("store_eps", ("episodes", "grid", "loc"), """
SELECT e.location_id, e.episode_id, e.shop_id, e."start", e."end", e.surv_q, e.state, row_number() OVER (PARTITION BY e.location_id ORDER BY e."start") - 1 AS prior_tenants,
  g.idx = 0 AS left_censored, g.idx <= (SELECT count(*) FROM grid) - 8 AS observable_2y, CAST(CASE WHEN state = 'closed' AND surv_q < 8 THEN 1 ELSE 0 END AS BIGINT) AS closed_2y,
  e."start" // 100 AS entry_year, g.idx <> 0 AND g.idx <= (SELECT count(*) FROM grid) - 8 AND e."start" < 199901 AS in_scope
FROM episodes e JOIN grid g ON g.period = e."start" WHERE e.location_id IN (SELECT location_id FROM loc WHERE district_id IS NOT NULL)""")


def store_rows(spark, root):
    cal = E.calendar(V.grid(spark, root))
    base = V.loc(spark, root).where("district_id is not null")
    return P.store_episodes(V.episodes(spark, root), base, cal, entry_cutoff=199901)


@query("g18_store_episodes", "SELECT * FROM store_eps", ("store_eps",))
def _(spark, root):
    return store_rows(spark, root)


@query("g19_rate_tables", """
SELECT 'entry_year' AS key_set, entry_year, NULL AS prior, count(*) AS n, round(avg(closed_2y), 6) AS rate FROM store_eps WHERE in_scope GROUP BY entry_year HAVING count(*) >= 30
UNION ALL SELECT 'prior', NULL, least(prior_tenants, 5), count(*), round(avg(closed_2y), 6) FROM store_eps WHERE in_scope GROUP BY 3 HAVING count(*) >= 30
UNION ALL SELECT 'entry_year x prior', entry_year, least(prior_tenants, 5), count(*), round(avg(closed_2y), 6) FROM store_eps WHERE in_scope GROUP BY 2, 3 HAVING count(*) >= 30""", ("store_eps",))
def _(spark, root):
    rows = store_rows(spark, root).where("in_scope").withColumn("prior", F.least("prior_tenants", F.lit(5)))
    return P.rate_tables(rows, [["entry_year"], ["prior"], ["entry_year", "prior"]], "closed_2y", 30)
