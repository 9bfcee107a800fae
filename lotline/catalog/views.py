"""The roles of a tenancy panel played by the given tables, as DataFrames and as SQL text.

Every view exists twice: a function over the parquet tables and the same definition as a common table
expression for the comparison engine. The expressions only derive keys and attributes; no row is left
out except by the simulated outage of the panel (the collector lost all regions but EUROPE in six
quarters), which gives the gap repair something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.operators import episodes as E
from lotline.operators.aggregates import share_and_dominant
from lotline.runtime import scalar, stored, table

OUTAGE = (199709, 199812)

SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def _sql(name: str, needs: tuple[str, ...], text: str) -> None:
    SQL[name] = (needs, text)


def with_views(names: tuple[str, ...], body: str) -> str:
    """Prefix ``body`` with the needed common table expressions in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in SQL[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({SQL[n][1].strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[len('WITH '):]}"
    return f"WITH {ctes}\n{body}"


def quarter(col: str):
    return (F.year(col) * 100 + F.quarter(col) * 3).cast("int")


# --- shop snapshots: several shops at one (parcel, floor) ------------------------------------------

_sql("snapshot", (), """
SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS parcel, CAST(l_partkey % 6 + 1 AS VARCHAR) AS floor,
  CAST(year(l_shipdate) * 100 + quarter(l_shipdate) * 3 AS BIGINT) AS period,
  concat('S', CAST(l_orderkey % 5 AS VARCHAR)) AS shop_id
FROM lineitem
""")


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("parcel"),
        (F.col("l_partkey") % 6 + 1).cast("string").alias("floor"),
        quarter("l_shipdate").alias("period"),
        F.concat(F.lit("S"), (F.col("l_orderkey") % 5).cast("string")).alias("shop_id"),
    ).distinct()


# --- one tenant per place and period, with the outage ------------------------------------------------

_sql("panel", (), f"""
SELECT location_id, period, min(shop_id) AS shop_id FROM (
  SELECT concat(CAST(l_suppkey AS VARCHAR), '_', CAST(l_partkey % 6 + 1 AS VARCHAR), '_1') AS location_id,
    CAST(year(l_shipdate) * 100 + quarter(l_shipdate) * 3 AS BIGINT) AS period,
    concat('S', CAST(l_orderkey % 3 AS VARCHAR)) AS shop_id, r_name
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) x
WHERE NOT (period BETWEEN {OUTAGE[0]} AND {OUTAGE[1]} AND r_name <> 'EUROPE')
GROUP BY location_id, period
""")


def areas(spark: SparkSession, root: str) -> DataFrame:
    """Supplier sites with nation and region."""
    return (
        table(spark, root, "supplier")
        .join(table(spark, root, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, root, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


def panel_source(spark: SparkSession, root: str) -> DataFrame:
    """Rows behind the panel with numeric keys: (site, level, period, tenant)."""
    rows = table(spark, root, "lineitem").select(
        F.col("l_suppkey").alias("site"), (F.col("l_partkey") % 6 + 1).alias("level"), quarter("l_shipdate").alias("period"),
        (F.col("l_orderkey") % 3).alias("tenant"),
    )
    # joined one base table at a time: each right side has a known size, so Catalyst builds on it and
    # never on the facts
    supplier = table(spark, root, "supplier").select(F.col("s_suppkey").alias("site"), "s_nationkey")
    nation = table(spark, root, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    region = table(spark, root, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    joined = rows.join(supplier, "site").join(nation, "s_nationkey").join(region, "n_regionkey")
    return joined.where(~(F.col("period").between(*OUTAGE) & (F.col("r_name") != "EUROPE"))).select(*rows.columns)


def panel(spark: SparkSession, root: str) -> DataFrame:
    # numbers are grouped (hash aggregation); the texts are built on the much smaller result
    cells = E.one_tenant(panel_source(spark, root), ["site", "level"], "period", "tenant")
    return cells.select(
        F.concat_ws("_", F.col("site").cast("string"), F.col("level").cast("string"), F.lit("1")).alias("location_id"),
        "period", F.concat(F.lit("S"), F.col("tenant").cast("string")).alias("shop_id"),
    )


def grid(spark: SparkSession, root: str) -> DataFrame:
    return E.period_grid(panel_source(spark, root), "period")


_sql("grid", ("panel",), """
SELECT period, CAST(row_number() OVER (ORDER BY period) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT period FROM panel) d
""")

_sql("episodes", ("panel",), """
SELECT location_id, CAST(episode_id AS BIGINT) AS episode_id, min(shop_id) AS shop_id, min(period) AS "start", max(period) AS "end",
  count(DISTINCT period) AS surv_q,
  CASE WHEN max(period) = (SELECT max(period) FROM panel) THEN 'open' ELSE 'closed' END AS state
FROM (SELECT *, sum(flag) OVER (PARTITION BY location_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS episode_id
      FROM (SELECT *, CASE WHEN lag(shop_id) OVER (PARTITION BY location_id ORDER BY period) = shop_id THEN 0 ELSE 1 END AS flag
            FROM panel) a) b
GROUP BY location_id, episode_id
""")


def episodes(spark: SparkSession, root: str, cells: DataFrame | None = None) -> DataFrame:
    last = scalar(panel_source(spark, root) if cells is None else cells, F.max("period"))
    cells = panel(spark, root) if cells is None else cells
    return E.detect_episodes(cells, key=["location_id"], period="period", value="shop_id", unique=True, last_period=last)


_sql("metrics", ("episodes",), """
SELECT location_id, CAST(sum(surv_q) AS BIGINT) AS obs_quarters, count(*) - 1 AS turnover_cnt, avg(surv_q) AS mean_surv,
  max(surv_q) AS max_surv,
  CASE WHEN sum(surv_q) > 1 THEN (count(*) - 1) / greatest(sum(surv_q) - 1, 1) END AS turnover_rate
FROM episodes GROUP BY location_id
""")


def metrics(spark: SparkSession, root: str) -> DataFrame:
    return E.location_metrics(episodes(spark, root), key=["location_id"])


_sql("gaps", ("episodes", "grid"), """
SELECT e.*, a.idx AS start_idx, z.idx AS end_idx, z.idx - a.idx + 1 AS expected_q, z.idx - a.idx + 1 - surv_q AS gap_q
FROM episodes e JOIN grid a ON e."start" = a.period JOIN grid z ON e."end" = z.period
""")

_sql("missing_counts", ("gaps", "panel", "grid"), """
SELECT g.period, count(*) AS n_missing
FROM (SELECT location_id, shop_id, arg_min("start", episode_id) AS s, arg_min("end", episode_id) AS e
      FROM gaps WHERE gap_q > 0 GROUP BY location_id, shop_id) f
JOIN grid g ON g.period BETWEEN f.s AND f.e
WHERE NOT EXISTS (SELECT 1 FROM panel p WHERE p.location_id = f.location_id AND p.shop_id = f.shop_id AND p.period = g.period)
GROUP BY g.period
""")

_sql("bad", ("missing_counts",), """
SELECT period FROM missing_counts WHERE n_missing >= 0.2 * (SELECT max(n_missing) FROM missing_counts)
""")



def bad_periods(spark: SparkSession, root: str, eps: DataFrame, cells: DataFrame, grid: DataFrame) -> DataFrame:
    counts = E.missing_period_counts(eps, cells, grid, key=["location_id"], value="shop_id")
    return E.structural_bad_periods(counts)


# --- industry records and shares ----------------------------------------------------------------------

_sql("records", (), """
SELECT concat(CAST(l_suppkey AS VARCHAR), '_', CAST(l_partkey % 6 + 1 AS VARCHAR), '_1') AS location_id, p_type AS industry,
  CAST(year(l_shipdate) * 100 + quarter(l_shipdate) * 3 AS BIGINT) AS period
FROM lineitem JOIN part ON l_partkey = p_partkey
""")


def records(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").join(
        table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(
        F.concat_ws("_", F.col("l_suppkey").cast("string"), (F.col("l_partkey") % 6 + 1).cast("string"), F.lit("1"))
        .alias("location_id"),
        F.col("p_type").alias("industry"), quarter("l_shipdate").alias("period"),
    )


_sql("shares", ("records",), """
SELECT location_id, industry, count(*) / sum(count(*)) OVER (PARTITION BY location_id) AS share,
  row_number() OVER (PARTITION BY location_id ORDER BY count(*) DESC, industry) AS rn
FROM records GROUP BY location_id, industry
""")


def shares(spark: SparkSession, root: str) -> DataFrame:
    counts = records(spark, root).groupBy("location_id", "industry").agg(F.count(F.lit(1)).alias("n"))
    return share_and_dominant(counts, key=["location_id"], category="industry", measure="n")


# --- the location table: metrics + vacancy + industry + district --------------------------------------

_sql("loc", ("metrics", "episodes", "grid", "shares"), """
SELECT m.*, v.first_q, v.last_q, v.vacancy_rate, split_part(m.location_id, '_', 1) AS parcel,
  split_part(m.location_id, '_', 2) AS floor, d.industry AS dominant_ind, n_name AS gu,
  CASE WHEN s_acctbal >= 0 THEN n_name END AS district_id, CASE WHEN s_acctbal >= 0 THEN r_name END AS district_type,
  CAST(CASE WHEN m.obs_quarters >= 15 AND m.mean_surv < 2 THEN 1 ELSE 0 END AS BIGINT) AS frequent,
  CAST(s_suppkey AS BIGINT) AS site
FROM metrics m
JOIN (SELECT location_id, min("start") AS first_q, max("end") AS last_q,
        (max(z.idx) - min(a.idx) + 1 - sum(z.idx - a.idx + 1)) / (max(z.idx) - min(a.idx) + 1) AS vacancy_rate
      FROM episodes e JOIN grid a ON e."start" = a.period JOIN grid z ON e."end" = z.period GROUP BY location_id) v
  ON m.location_id = v.location_id
JOIN (SELECT location_id, industry FROM shares WHERE rn = 1) d ON m.location_id = d.location_id
JOIN supplier ON CAST(s_suppkey AS VARCHAR) = split_part(m.location_id, '_', 1)
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")


def loc(spark: SparkSession, root: str) -> DataFrame:
    from lotline.functions.columns import parse_location_id

    eps = stored(episodes(spark, root))  # metrics and vacancy both read it
    cal = E.calendar(grid(spark, root))
    dominant = shares(spark, root).where("is_dominant").select("location_id", F.col("industry").alias("dominant_ind"))
    named = F.col("s_acctbal") >= 0
    site = areas(spark, root).select(
        F.col("s_suppkey").cast("string").alias("parcel"), F.col("n_name").alias("gu"),
        F.when(named, F.col("n_name")).alias("district_id"), F.when(named, F.col("r_name")).alias("district_type"),
        F.col("s_suppkey").alias("site"),
    )
    parts = parse_location_id("location_id")
    vac = E.vacancy(eps, cal, key=["location_id"]).select("location_id", "first_q", "last_q", "vacancy_rate")
    return (
        E.location_metrics(eps, key=["location_id"]).join(vac, "location_id").join(dominant, "location_id")
        .withColumns({"parcel": parts["parcel"], "floor": parts["floor"]})
        .join(site, "parcel")
        .withColumn("frequent", F.when((F.col("obs_quarters") >= 15) & (F.col("mean_surv") < 2), 1).otherwise(0))
    )


# --- building rows: floor texts against a registry -----------------------------------------------------

_sql("floor_rows", (), """
SELECT CAST(l_partkey AS VARCHAR) AS parcel, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN NULL
  ELSE CAST(l_linenumber AS VARCHAR) END AS floor_raw, CAST(year(l_shipdate) AS BIGINT) AS year, l_returnflag AS lot,
  p_type AS use, CASE WHEN p_type <> 'PROMO' THEN p_size END AS total_floors, p_type <> 'PROMO' AS matched
FROM lineitem JOIN part ON l_partkey = p_partkey
""")


def floor_rows(spark: SparkSession, root: str) -> DataFrame:
    known = F.col("p_type") != "PROMO"
    return table(spark, root, "lineitem").join(
        table(spark, root, "part"), F.col("l_partkey") == F.col("p_partkey")
    ).select(
        F.col("l_partkey").cast("string").alias("parcel"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), None)
        .otherwise(F.col("l_linenumber").cast("string")).alias("floor_raw"),
        F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("lot"), F.col("p_type").alias("use"),
        F.when(known, F.col("p_size")).alias("total_floors"), known.alias("matched"),
    )


# --- points, stations, polygons ---------------------------------------------------------------------------

_POINT = """
126.7 + ({k} * 7919 % 5000) / 10000.0 AS lon, 37.4 + ({k} * 104729 % 3000) / 10000.0 AS lat,
CAST({k} * 7919 % 5000 AS DOUBLE) * 8.8 AS x, CAST({k} * 104729 % 3000 AS DOUBLE) * 11.1 AS y
"""


def _point_columns(key: str) -> list:
    k = F.col(key)
    east, north = (k * 7919 % 5000).cast("double"), (k * 104729 % 3000).cast("double")
    return [
        (F.lit(126.7) + east / 10000.0).alias("lon"), (F.lit(37.4) + north / 10000.0).alias("lat"),
        (east * 8.8).alias("x"), (north * 11.1).alias("y"),
    ]


_sql("points", (), f"SELECT c_custkey AS point_id, c_nationkey, c_mktsegment, {_POINT.format(k='c_custkey')} FROM customer")
_sql("stations", (), f"SELECT s_suppkey AS station_id, s_name AS station, {_POINT.format(k='(s_suppkey * 13 + 5)')} FROM supplier")
_sql("polygons", (), """
SELECT n_nationkey AS polygon_id, n_name AS polygon_name, [
  {'x': x0 + 800.0, 'y': y0 + 600.0}, {'x': x0 + 8000.0, 'y': y0 + 900.0 + 50.0 * (n_nationkey % 3)},
  {'x': x0 + 7600.0 - 40.0 * n_nationkey, 'y': y0 + 6000.0}, {'x': x0 + 500.0, 'y': y0 + 5200.0}] AS ring
FROM (SELECT *, CAST(n_nationkey % 5 AS DOUBLE) * 8800.0 AS x0, CAST(n_nationkey // 5 AS DOUBLE) * 6660.0 AS y0 FROM nation) n
""")


def points(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(
        F.col("c_custkey").alias("point_id"), "c_nationkey", "c_mktsegment", *_point_columns("c_custkey")
    )


def stations(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "supplier").withColumn("k", F.col("s_suppkey") * 13 + 5)
    return rows.select(F.col("s_suppkey").alias("station_id"), F.col("s_name").alias("station"), *_point_columns("k"))


def polygons(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("n_nationkey").cast("double")
    x0 = (F.col("n_nationkey") % 5).cast("double") * 8800.0
    y0 = F.floor(k / 5).cast("double") * 6660.0

    def corner(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(
        corner(x0 + 800.0, y0 + 600.0), corner(x0 + 8000.0, y0 + 900.0 + (k % 3) * 50.0),
        corner(x0 + 7600.0 - k * 40.0, y0 + 6000.0), corner(x0 + 500.0, y0 + 5200.0),
    )
    return table(spark, root, "nation").select(
        F.col("n_nationkey").alias("polygon_id"), F.col("n_name").alias("polygon_name"), ring.alias("ring")
    )


# --- long facts (district x industry x quarter) ------------------------------------------------------------

_sql("facts", (), """
SELECT n_name AS district_id, c_mktsegment AS industry,
  CAST(year(o_orderdate) * 100 + quarter(o_orderdate) * 3 AS BIGINT) AS quarter,
  sum(o_totalprice) AS amount, count(*) AS n_sales,
  sum(CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN o_totalprice ELSE 0 END) AS weekend_amount,
  sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) AS night_amount
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY ALL
""")


def facts(spark: SparkSession, root: str) -> DataFrame:
    amount = F.col("o_totalprice")
    return (
        table(spark, root, "orders")
        .join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("district_id"), F.col("c_mktsegment").alias("industry"),
                 quarter("o_orderdate").alias("quarter"))
        .agg(
            F.sum(amount).alias("amount"), F.count(F.lit(1)).alias("n_sales"),
            F.sum(F.when(F.dayofweek("o_orderdate").isin(1, 7), amount).otherwise(0.0)).alias("weekend_amount"),
            F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", amount).otherwise(0.0)).alias("night_amount"),
        )
    )


# --- customers with a binary target: most orders against the mean of their nation ---------------------------

_sql("risk", (), """
SELECT *, n_orders - avg(n_orders) OVER (PARTITION BY district) AS excess,
  CASE WHEN n_orders - avg(n_orders) OVER (PARTITION BY district) >= 4 THEN 1 ELSE 0 END AS label
FROM (SELECT c_custkey AS id, c_nationkey AS district, c_mktsegment AS segment, c_acctbal AS balance,
        count(o_orderkey) AS n_orders, avg(o_totalprice) AS mean_price,
        count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS n_urgent,
        count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_closed
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) c
""")


def risk(spark: SparkSession, root: str) -> DataFrame:
    rows = (
        table(spark, root, "customer")
        .join(
            table(spark, root, "orders").groupBy("o_custkey").agg(
                F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price"),
                F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
                F.count_if(F.col("o_orderstatus") == "F").alias("n_closed"),
            ),
            F.col("o_custkey") == F.col("c_custkey"), "left",
        )
        .select(
            F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("district"), F.col("c_mktsegment").alias("segment"),
            F.col("c_acctbal").alias("balance"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "mean_price",
            F.coalesce("n_urgent", F.lit(0)).alias("n_urgent"), F.coalesce("n_closed", F.lit(0)).alias("n_closed"),
        )
    )
    mean = rows.groupBy("district").agg(F.avg("n_orders").alias("_m"))
    return (
        rows.join(mean, "district").withColumn("excess", F.col("n_orders") - F.col("_m")).drop("_m")
        .withColumn("label", F.when(F.col("excess") >= 4, 1).otherwise(0))
    )


def vectors(spark: SparkSession, root: str, dims: int = 64) -> DataFrame:
    """Embeddings as numeric columns f0..f{dims-1} with their label."""
    return table(spark, root, "embeddings").select(
        F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(dims)]
    )


# --- tail probabilities in SQL, by their plain power series -----------------------------------------


def chi_tail_sql(x: str, dof: str) -> str:
    """Probability that chi-squared is at least x: one minus the sum of x^(a+i) e^-x / Gamma(a+i+1), halves of both."""
    a, y = f"(({dof}) / 2.0)", f"(greatest({x}, 1e-300) / 2.0)"
    terms = f"range(0, CAST(greatest({y} - {a}, 0) + 12 * sqrt({y} + 1) + 200 AS BIGINT))"
    return f"round(greatest(0, 1 - list_sum(list_transform({terms}, lambda i: exp(({a} + i) * ln({y}) - {y} - lgamma({a} + i + 1))))), 6)"


def f_tail_sql(f: str, d1: str, d2: str) -> str:
    """Probability that F is at least f: the incomplete beta function at d2 / (d2 + d1 f) as a power series."""
    a, b, x = f"({d2} / 2.0)", f"({d1} / 2.0)", f"({d2} / ({d2} + {d1} * greatest({f}, 1e-300)))"
    term = f"exp(lgamma({a} + {b} + i) - lgamma({a} + i + 1) - lgamma({b}) + ({a} + i) * ln({x}) + {b} * ln(1 - {x}))"
    return f"round(least(1, list_sum(list_transform(range(0, 50000), lambda i: {term}))), 6)"
