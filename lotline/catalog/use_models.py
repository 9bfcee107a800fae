"""Supervised models (J1-J12): customers with many orders for their nation, folds by nation."""

from pyspark.sql import functions as F

from lotline.catalog import views as V
from lotline.catalog.registry import query
from lotline.operators import ranked as R
from lotline.operators import supervised as M
from lotline.plans.products import GRADES
from lotline.runtime import stored, table

NUM, CAT = ["balance", "mean_price", "share_urgent"], ["segment"]


def rows_of(spark, root, k=5):
    """Features that do not give the label away by themselves."""
    rows = V.risk(spark, root).withColumns({
        "mean_price": F.coalesce("mean_price", F.lit(0.0)), "share_urgent": F.col("n_urgent") / F.greatest("n_orders", F.lit(1)),
        "urgent_any": F.when(F.col("n_urgent") >= 2, 1).otherwise(0),
    })
    return stored(M.group_folds(rows, "district", "label", k))


V._sql("folds", ("risk",), """
SELECT district, CASE WHEN (r - 1) % 10 < 5 THEN (r - 1) % 10 ELSE 9 - (r - 1) % 10 END AS fold FROM (
  SELECT district, row_number() OVER (ORDER BY sum(label) DESC, district) AS r FROM risk GROUP BY district) t""")


@query("j1_group_folds", "SELECT id, CAST(r.district AS BIGINT) AS district, label, fold FROM (SELECT id, district, CAST(label AS BIGINT) AS label FROM risk) r JOIN folds f ON r.district = f.district", ("risk", "folds"))
def _(spark, root):
    return M.group_folds(V.risk(spark, root), "district", "label", 5).select("id", "district", "label", "fold")


@query("j2_cv_regression")
def _(spark, root):
    rows = rows_of(spark, root)
    num = ["balance", "mean_price", "n_urgent"]
    return M.cv_linear(rows, num, "n_orders", CAT).union(M.cv_forest(rows, num, "n_orders", CAT, trees=200))


@query("j3_cv_logistic")
def _(spark, root):
    return M.fold_metrics(M.out_of_fold(rows_of(spark, root), NUM, CAT, "label", "logistic"), "label", "score")


@query("j4_compare_encodings")
def _(spark, root):
    from lotline.operators.clustering import fit_labels, standardise

    rows = rows_of(spark, root, 3)
    districts = rows.groupBy("district").agg(F.avg("balance").alias("d_balance"), F.avg("share_urgent").alias("d_urgent"))
    labels = fit_labels(standardise(districts, ["d_balance", "d_urgent"]), ["d_balance", "d_urgent"], "kmeans", 4)
    return M.compare_encodings(stored(rows.join(labels, "district")), "cluster", ["d_balance", "d_urgent"], "n_orders", "label", trees=20)


def boosted(spark, root):
    return M.out_of_fold(rows_of(spark, root, 3), NUM, CAT, "label", "boosted", iterations=10, depth=3)


V._sql("hashed", ("risk",), """
SELECT id, segment, label, CAST(concat('0x', substr(md5(concat('42|', id)), 1, 8)) AS BIGINT) AS u, avg(label) OVER () AS mean FROM risk""")


@query("j5_ordered_target_rate", """
SELECT id, round((coalesce(sum(label) OVER w, 0) + mean) / (count(*) OVER w + 1), 6) AS rate FROM hashed
WINDOW w AS (PARTITION BY segment ORDER BY u, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", ("hashed",))
def _(spark, root):
    rows = stored(V.risk(spark, root))
    return M.ordered_target_rate(rows, "id", "segment", "label", part_rows=max(1, rows.count() // 20)).select("id", "rate")


@query("j5_cv_boosted")
def _(spark, root):
    return boosted(spark, root).select("id", "district", "fold", "label", "score")


V._sql("scored", (), """
SELECT o_orderkey AS id, CAST((o_orderkey * 7919 + CASE WHEN o_orderpriority = '1-URGENT' THEN 300 ELSE 0 END) % 1000 AS DOUBLE) / 1000 AS score,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label FROM orders""")


def scored(spark, root):
    urgent = F.col("o_orderpriority") == "1-URGENT"
    points = (F.col("o_orderkey") * 7919 + F.when(urgent, 300).otherwise(0)) % 1000
    return table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), (points.cast("double") / 1000).alias("score"), urgent.cast("int").alias("label"))


_SCAN = """
WITH t AS (SELECT CAST(round(0.05 + 0.01 * i, 2) AS DOUBLE) AS threshold FROM range(0, 91) r(i)), h AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM scored GROUP BY score),
c AS (SELECT threshold, coalesce(sum(CASE WHEN score >= threshold THEN p END), 0) AS tp, coalesce(sum(CASE WHEN score >= threshold THEN q END), 0) AS fp,
  coalesce(sum(CASE WHEN score < threshold THEN q END), 0) AS tn, coalesce(sum(CASE WHEN score < threshold THEN p END), 0) AS fn FROM t, h GROUP BY threshold),
m AS (SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r,
  tn / nullif(tn + fp, 0) AS s, tn / nullif(tn + fn, 0) AS v FROM c)"""
_F = "coalesce(CASE WHEN p > 0 AND r > 0 THEN {k} * p * r / ({b} * p + r) END, 0)"


@query("j6_threshold_scan", _SCAN + f"""
SELECT threshold, tp, fp, tn, fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(s, 6) AS specificity, round(v, 6) AS npv, round({_F.format(k=2, b=1)}, 6) AS f1,
  round({_F.format(k=5, b=4)}, 6) AS f2, round({_F.format(k=1.25, b=0.25)}, 6) AS f05, round(r + s - 1, 6) AS youden, tp + fp AS n_flagged FROM m""", ("scored",))
def _(spark, root):
    return M.threshold_scan(scored(spark, root), "label", "score")


@query("j6_threshold_picks", _SCAN + ", x AS (SELECT threshold, " + f"{_F.format(k=2, b=1)} AS f1, {_F.format(k=5, b=4)} AS f2, {_F.format(k=1.25, b=0.25)} AS f05, r + s - 1 AS youden FROM m) " + " UNION ALL ".join(
    f"SELECT '{n}' AS purpose, arg_max(threshold, ({c}, -threshold)) AS threshold, round(max({c}), 6) AS value FROM x"
    for n, c in (("best f1", "f1"), ("balanced", "youden"), ("recall first", "f2"), ("precision first", "f05"))), ("scored",))
def _(spark, root):
    return M.threshold_picks(M.threshold_scan(scored(spark, root), "label", "score"))


@query("j7_roc_auc", """
WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored), s AS (SELECT sum(CASE WHEN label = 1 THEN rk END) AS s, CAST(sum(label) AS DOUBLE) AS p, count(*) AS n FROM r)
SELECT round((s - p * (p + 1) / 2) / (p * (n - p)), 6) AS roc_auc FROM s""", ("scored",))
def _(spark, root):
    return M.roc_auc(scored(spark, root), "label", "score")


@query("j7_average_precision", """
WITH h AS (SELECT score, sum(label) AS p, count(*) AS c FROM scored GROUP BY score), w AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(c) OVER (ORDER BY score DESC) AS n, sum(p) OVER () AS pos FROM h)
SELECT round(sum(p / pos * tp / n), 6) AS average_precision FROM w""", ("scored",))
def _(spark, root):
    return M.average_precision(scored(spark, root), "label", "score")


@query("j8_permutation_importance")
def _(spark, root):
    rows = rows_of(spark, root)
    model = M.fit_classifier(rows, NUM, CAT, "label", "logistic")
    return M.permutation_importance(model, rows, "id", "label", {"price": ["mean_price"], "urgent": ["share_urgent"], "rest": ["balance", "segment"]}, repeats=2)


V._sql("segment_shares", (), """
SELECT o_custkey AS id, o_orderpriority AS category, count(*) / sum(count(*)) OVER (PARTITION BY o_custkey) AS share FROM orders GROUP BY o_custkey, o_orderpriority""")


@query("j9_oof_target_rate", """
WITH j AS (SELECT s.id, category, share, fold, label FROM segment_shares s JOIN risk r ON s.id = r.id JOIN folds f ON r.district = f.district),
c AS (SELECT category, fold, sum(share * label) AS s, sum(share) AS w FROM j GROUP BY ALL),
r AS (SELECT a.category, a.fold, (sum(b.s) - a.s) / greatest(sum(b.w) - a.w, 1e-9) AS rate FROM c a JOIN c b ON a.category = b.category GROUP BY a.category, a.fold, a.s, a.w)
SELECT r0.id, round(x.expected, 6) AS expected FROM risk r0 LEFT JOIN (SELECT id, sum(share * rate) AS expected FROM j JOIN r ON j.category = r.category AND j.fold = r.fold GROUP BY id) x ON r0.id = x.id""",
       ("segment_shares", "risk", "folds"))
def _(spark, root):
    from lotline.operators.aggregates import share_and_dominant

    counts = table(spark, root, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    shares = share_and_dominant(counts, key=["id"], category="category", measure="n")
    return M.oof_target_rate(shares, rows_of(spark, root, 5), "id", "category", "share", "label").select("id", "expected")


@query("j10_nested_sets")
def _(spark, root):
    sets = [("place", ["balance"], []), ("place + segment", ["balance"], CAT), ("place + segment + use", NUM, CAT)]
    return M.nested_sets(rows_of(spark, root, 3), sets, "label", "boosted", iterations=4, depth=3)


@query("j11_counterfactual_mean")
def _(spark, root):
    rows = rows_of(spark, root)
    model = M.fit_classifier(rows, ["balance", "mean_price", "urgent_any"], CAT, "label", "boosted", iterations=10, depth=3)
    return M.counterfactual_mean(model, rows, "urgent_any", "label", by="segment", min_n=100, min_hits=10)


@query("j12_grade_lift", """
WITH g AS (SELECT label, row_number() OVER (ORDER BY score, id) / count(*) OVER () AS pct FROM scored),
l AS (SELECT label, CASE WHEN pct <= 0.1 THEN 'very_safe' WHEN pct <= 0.3 THEN 'safe' WHEN pct <= 0.7 THEN 'normal' WHEN pct <= 0.9 THEN 'risky' ELSE 'very_risky' END AS grade FROM g)
SELECT grade, count(*) AS n, round(avg(label), 6) AS rate, round(avg(label) / (SELECT avg(label) FROM scored), 6) AS lift FROM l GROUP BY grade""", ("scored",))
def _(spark, root):
    graded = R.grade(scored(spark, root), "score", "id", GRADES)
    return M.grade_lift(graded, "grade", "label")
