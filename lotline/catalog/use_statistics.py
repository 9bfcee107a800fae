"""Tests, effect sizes, survival, screening."""

from pyspark.sql import functions as F

from lotline.catalog import views as V
from lotline.catalog.registry import query
from lotline.operators import screening as Q
from lotline.operators import statistics as S
from lotline.operators.episodes import CLOSED
from lotline.runtime import stored, table

_CHI = """
WITH c AS (SELECT {a} AS a, {b} AS b, CAST(count(*) AS DOUBLE) AS o FROM {t} GROUP BY ALL), r AS (SELECT a, sum(o) AS r FROM c GROUP BY a), k AS (SELECT b, sum(o) AS k FROM c GROUP BY b),
n AS (SELECT sum(o) AS n, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM k) AS nk FROM c),
x AS (SELECT r.a, k.b, coalesce(o, 0) AS o, r * k / n AS e, nr, nk, n FROM r CROSS JOIN k CROSS JOIN n LEFT JOIN c ON c.a = r.a AND c.b = k.b),
y AS (SELECT sum(pow(abs(o - e) - CASE WHEN (nr - 1) * (nk - 1) = 1 THEN least(0.5, abs(o - e)) ELSE 0 END, 2) / e) AS chi2, CAST(max((nr - 1) * (nk - 1)) AS BIGINT) AS dof,
  CAST(max(n) AS BIGINT) AS n, least(max(nr), max(nk)) - 1 AS q FROM x)
SELECT round(chi2, 6) AS chi2, dof, n, round(sqrt(chi2 / (n * q)), 6) AS cramers_v, """ + V.chi_tail_sql("chi2", "dof") + """ AS p_value FROM y"""


@query("h1_chi_square_v", _CHI.format(a="use", b="reliability", t="flagged"), ("flagged",))
def _(spark, root):
    from lotline.catalog.use_columns import flagged

    return S.chi_square_v(flagged(spark, root), "use", "reliability")


@query("h1_chi_square_2x2", _CHI.format(a="l_returnflag = 'R'", b="l_linestatus", t="lineitem"))
def _(spark, root):
    rows = table(spark, root, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return S.chi_square_v(rows, "returned", "l_linestatus")


_KW = """
WITH d AS (SELECT {g} AS g, {v} AS v FROM {t} WHERE {g} IS NOT NULL AND {v} IS NOT NULL), r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM d),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d), s AS (SELECT count(*) AS k, sum(rs * rs / m) AS s FROM (SELECT g, sum(rk) AS rs, count(*) AS m FROM r GROUP BY g) x),
t AS (SELECT sum(CAST(c AS DOUBLE) * (CAST(c AS DOUBLE) * c - 1)) AS ties FROM (SELECT v, count(*) AS c FROM d GROUP BY v) y),
h AS (SELECT (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h, k, n FROM n, s, t)
SELECT round(h, 6) AS h, k, CAST(n AS BIGINT) AS n, round((h - k + 1) / (n - k), 6) AS epsilon2, """ + V.chi_tail_sql("h", "k - 1") + """ AS p_value FROM h"""


@query("h2_kruskal", _KW.format(g="o_orderpriority", v="floor(o_totalprice / 500)", t="orders"))
def _(spark, root):
    return S.kruskal(table(spark, root, "orders").withColumn("v", F.floor(F.col("o_totalprice") / 500)), "o_orderpriority", "v")


@query("h2_kruskal_turnover", _KW.format(g="district_id", v="round(turnover_rate, 9)", t="loc"), ("loc",))
def _(spark, root):
    rows = stored(V.loc(spark, root).select("district_id", F.round("turnover_rate", 9).alias("turnover_rate")))
    return S.kruskal(rows, "district_id", "turnover_rate")


_ANOVA = """
WITH d AS (SELECT {g} AS g, {v} AS v FROM {t} WHERE {g} IS NOT NULL AND {v} IS NOT NULL), m AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM d GROUP BY g),
a AS (SELECT avg(v) AS gm, count(*) AS n FROM d), w AS (SELECT sum(m.n * s) AS w, sum(m.n * pow(m - gm, 2)) AS b, count(*) AS k, max(a.n) AS n FROM m, a)
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS f, round(b / (b + w), 6) AS eta2, round(w / (b + w), 6) AS within_share, n, k,
  """ + V.f_tail_sql("(b / (k - 1)) / (w / (n - k))", "(k - 1)", "(n - k)") + """ AS p_value FROM w"""


@query("h3_anova_eta", _ANOVA.format(g="district_id", v="turnover_rate", t="loc"), ("loc",))
def _(spark, root):
    return S.anova_eta(stored(V.loc(spark, root)), "district_id", "turnover_rate")


_RHO = """
SELECT '{x}' AS feature, round(corr(ra, rb), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS ra,
  rank() OVER (ORDER BY excess) + (count(*) OVER (PARTITION BY excess) - 1) / 2.0 AS rb FROM (SELECT round(excess, 9) AS excess, balance, n_urgent, mean_price FROM risk) q WHERE {x} IS NOT NULL) t"""


@query("h4_spearman_table", " UNION ALL ".join(_RHO.format(x=x) for x in ("balance", "n_urgent", "mean_price")), ("risk",))
def _(spark, root):
    rows = stored(V.risk(spark, root).withColumn("excess", F.round("excess", 9)))
    return S.spearman_table(rows, ["balance", "n_urgent", "mean_price"], "excess")


@query("h5_group_cv", """
SELECT CAST(district AS BIGINT) AS district, count(*) AS n, round(avg(n_orders), 6) AS mean, round(stddev_samp(n_orders), 6) AS std, round(stddev_samp(n_orders) / avg(n_orders) * 100, 6) AS cv_pct
FROM risk GROUP BY district HAVING avg(n_orders) > 0""", ("risk",))
def _(spark, root):
    return S.group_cv(V.risk(spark, root), "district", "n_orders")


@query("h5_cv_summary", """
WITH c AS (SELECT count(*) AS n, stddev_samp(n_orders) / avg(n_orders) * 100 AS cv FROM risk GROUP BY district HAVING avg(n_orders) > 0)
SELECT round(avg(cv), 6) AS cv_mean, round(quantile_cont(cv, 0.5), 6) AS cv_median, round(sum(cv * n) / sum(n), 6) AS cv_weighted,
  (SELECT round(stddev_samp(n_orders) / avg(n_orders) * 100, 6) FROM risk) AS cv_overall, count(*) AS n_groups FROM c""", ("risk",))
def _(spark, root):
    return S.cv_summary(stored(V.risk(spark, root)), "district", "n_orders")


_KM = """
WITH e AS (SELECT surv_q AS t, CASE WHEN state = 'closed' THEN 1 ELSE 0 END AS ev FROM episodes WHERE "start" > (SELECT min("start") FROM episodes)),
c AS (SELECT t, sum(ev) AS d, count(*) AS c FROM e GROUP BY t), r AS (SELECT t, d, sum(c) OVER (ORDER BY t DESC) AS at_risk FROM c),
s AS (SELECT t, d, at_risk, product(1 - d / at_risk) OVER (ORDER BY t) AS s FROM r)"""


def _spells(spark, root):
    eps = stored(V.episodes(spark, root))
    first = eps.agg(F.min("start")).scalar()
    return eps.where(F.col("start") > first).withColumn("closed", (F.col("state") == CLOSED).cast("int"))


@query("h6_survival_table", _KM + "SELECT t, CAST(d AS BIGINT) AS d, CAST(at_risk AS BIGINT) AS at_risk, round(s, 6) AS survival FROM s", ("episodes",))
def _(spark, root):
    return S.survival_table(_spells(spark, root), "surv_q", "closed")


@query("h6_kaplan_meier", _KM + 'SELECT CAST(a AS BIGINT) AS "at", round(coalesce((SELECT s FROM s WHERE t <= a ORDER BY t DESC LIMIT 1), 1), 6) AS survival FROM (VALUES (0), (7), (11), (19)) v(a)', ("episodes",))
def _(spark, root):
    return S.kaplan_meier(_spells(spark, root), "surv_q", "closed", [0, 7, 11, 19])


@query("h6_naive_share", """
SELECT round(avg(CASE WHEN surv_q < 8 THEN 1.0 ELSE 0 END), 6) AS closed_below_2y, count(*) AS n FROM episodes WHERE state = 'closed' AND "start" > (SELECT min("start") FROM episodes)""", ("episodes",))
def _(spark, root):
    return S.share_below(_spells(spark, root).where("closed = 1"), "surv_q", F.lit(8), "closed_below_2y")


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("h7_correlation_pairs", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1:]))
def _(spark, root):
    return S.correlation_pairs(table(spark, root, "lineitem"), _COLS)


@query("h8_vif", """
SELECT unnest(['a', 'b']) AS column_name, unnest([round(1 / (1 - r * r), 6), round(1 / (1 - r * r), 6)]) AS vif FROM (SELECT corr(l_quantity, l_quantity * l_discount) AS r FROM lineitem) t""")
def _(spark, root):
    rows = table(spark, root, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_quantity") * F.col("l_discount")).alias("b"))
    factors = S.vif(S.correlation_matrix(rows, ["a", "b"]), ["a", "b"])
    return spark.createDataFrame(list(factors.items()), "column_name string, vif double")


def _wide(spark, root):
    return V.risk(spark, root).select(
        "id", "balance", "n_orders", F.log1p("n_orders").alias("n_orders_log"), F.coalesce("mean_price", F.lit(0.0)).alias("mean_price"),
        "n_urgent", "n_closed", (F.col("n_orders") - F.col("n_urgent")).alias("n_other"), F.lit(1.0).alias("constant"),
        (F.col("n_urgent") / F.greatest("n_orders", F.lit(1))).alias("share_urgent"),
        (1 - F.col("n_urgent") / F.greatest("n_orders", F.lit(1))).alias("share_rest"))


@query("h9_outlier_report", """
SELECT unnest(['balance', 'n_orders']) AS "column", unnest([round(greatest((max(balance) - avg(balance)) / stddev_samp(balance), (avg(balance) - min(balance)) / stddev_samp(balance)), 6),
  round(greatest((max(n_orders) - avg(n_orders)) / stddev_samp(n_orders), (avg(n_orders) - min(n_orders)) / stddev_samp(n_orders)), 6)]) AS max_abs_z FROM risk""", ("risk",))
def _(spark, root):
    return Q.outlier_report(V.risk(spark, root), ["balance", "n_orders"])


@query("h9_variation_report", " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(max(n) / sum(n), 6) AS mode_share, (SELECT round(stddev_samp({c}), 6) FROM risk) AS std FROM (SELECT {c}, count(*) AS n FROM risk WHERE {c} IS NOT NULL GROUP BY {c}) t"""
    for c in ("balance", "n_orders", "n_urgent")), ("risk",))
def _(spark, root):
    return Q.variation_report(V.risk(spark, root), ["balance", "n_orders", "n_urgent"])


@query("h9_screen_variables")
def _(spark, root):
    cols = ["balance", "n_orders", "n_orders_log", "mean_price", "n_urgent", "n_closed", "n_other", "constant", "share_urgent", "share_rest"]
    _, _, log = Q.screen_variables(stored(_wide(spark, root)), cols, compositions={"share_rest": ["share_urgent", "share_rest"]}, keep=["balance"])
    return spark.createDataFrame(log, "variable string, action string, reason string")


@query("h10_candidate_sets")
def _(spark, root):
    kept = Q.screen_variables(stored(_wide(spark, root)), ["balance", "n_orders", "mean_price", "n_urgent", "n_closed"], max_corr=0.99, max_vif=1e6)[1]
    sets = Q.candidate_sets(kept, {"counts": ["n_"], "money": ["balance", "price"]}, sizes=(2, 3), cap=10)
    return spark.createDataFrame([(i, g, ";".join(c)) for i, g, c in sets], "set_id string, set_group string, features string")
