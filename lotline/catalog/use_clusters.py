"""Unsupervised models (I1-I12) on the embeddings and on district-like groups."""

from pyspark.sql import functions as F

from lotline.catalog import views as V
from lotline.catalog.registry import query
from lotline.operators import clustering as C
from lotline.operators import many_models as M
from lotline.operators import spatial as S
from lotline.runtime import shared_dir, stored, table

_PAIR = "sum({c} * ({c} - 1) / 2.0)"
COLS = [f"f{i}" for i in range(64)]
#: A feature set of the usual size, for mixtures and the grid.
FEW = COLS[:6]
_VEC = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64))
V._sql("vec", (), f"SELECT vec_id AS id, label, {_VEC} FROM embeddings")


def vectors(spark, root):
    return V.vectors(spark, root)


@query("i1_standardise", "SELECT id, " + ", ".join(
    f"round((f{i} - avg(f{i}) OVER ()) / stddev_pop(f{i}) OVER (), 6) AS f{i}" for i in range(64)) + " FROM vec", ("vec",))
def _(spark, root):
    return C.standardise(vectors(spark, root), COLS).select("id", *COLS)


@query("i2_pca_components")
def _(spark, root):
    table_, _, keep, kaiser = C.pca_fit(C.standardise(stored(vectors(spark, root)), COLS), COLS)
    return table_.withColumns({"kept": F.lit(keep), "above_one": F.lit(kaiser), "loadings": F.to_json("loadings")})


@query("i2_pca_scores")
def _(spark, root):
    return C.pca_fit(C.standardise(stored(vectors(spark, root)), COLS), COLS)[1]


@query("i3_score_decile_lift", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM orders)
SELECT CAST(1 + len(list_filter(q, lambda z: z < o_totalprice)) AS BIGINT) AS decile, count(*) AS n, round(avg(u), 6) AS rate, 'o_totalprice' AS score,
  round(avg(u) / (SELECT avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END) FROM orders), 6) AS lift
FROM (SELECT o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS u FROM orders) o, e GROUP BY 1""")
def _(spark, root):
    rows = table(spark, root, "orders").withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    return C.score_decile_lift(rows, ["o_totalprice"], "urgent")


def kmeans_sql(candidates, rounds, tail):
    """Lloyd's rounds over the standardised embeddings for all candidates (k, start, sample), every distance in plain SQL, then ``tail``."""
    gap = "list_inner_product(m.x, m.x) + list_inner_product(o.x, o.x) - 2 * list_inner_product(m.x, o.x)"
    values = ", ".join(f"({i}, {c.k}, {c.start}, {'NULL' if c.sample is None else c.sample})" for i, c in enumerate(candidates))
    share = "CAST(concat('0x', substr(md5(concat(smp, '|', id)), 1, 8)) AS BIGINT) / 4294967296.0"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT m.c, id, min({{'d': {gap}, 'j': j}}) AS b FROM m JOIN c{r} o ON m.c = o.c GROUP BY m.c, id)")
        if r < rounds:
            steps.append(f"n{r} AS (SELECT c, j, list(s ORDER BY i) AS x FROM (SELECT a.c, a.b.j AS j, i, avg(v.x[i]) AS s FROM a{r} a JOIN v USING (id), range(1, 65) g(i) GROUP BY ALL) GROUP BY c, j)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, o.j, coalesce(n{r}.x, o.x) AS x FROM c{r} o LEFT JOIN n{r} USING (c, j))")
    return f"""
WITH e AS (SELECT vec_id AS id, i, CAST(embedding[i] AS DOUBLE) AS y FROM embeddings, range(1, 65) g(i)), s AS (SELECT i, avg(y) AS mu, stddev_pop(y) AS sd FROM e GROUP BY i),
v AS MATERIALIZED (SELECT id, list((y - mu) / sd ORDER BY i) AS x FROM e JOIN s USING (i) GROUP BY id), cand(c, k, st, smp) AS (VALUES {values}),
m AS MATERIALIZED (SELECT c, id, x FROM v, cand WHERE smp IS NULL OR {share} < 0.8),
c0 AS MATERIALIZED (SELECT c, r - 1 AS j, x FROM (SELECT m.c, k, x, row_number() OVER (PARTITION BY m.c ORDER BY md5(concat(st, '|', id)), id) AS r FROM m JOIN cand USING (c)) t WHERE r <= k),
{", ".join(steps)}, z AS (SELECT c, id, b.j AS j, greatest(b.d, 0) AS d FROM a{rounds}), {tail}"""


SWEEP = [M.Candidate(k, s) for k in range(2, 11) for s in range(3)]


def whole_vectors(spark, root):
    return C.standardise(stored(V.vectors(spark, root)), COLS)


@query("i4_kmeans_sweep", kmeans_sql(SWEEP, 10, """
cost AS (SELECT c, k, st, sum(d) AS cost, row_number() OVER (PARTITION BY k ORDER BY sum(d), st) AS r FROM z JOIN cand USING (c) GROUP BY c, k, st), f AS (SELECT z.* FROM z JOIN cost USING (c) WHERE r = 1),
y AS (SELECT f.*, x FROM f JOIN v USING (id)), n AS (SELECT c, j, count(*) AS n FROM f GROUP BY c, j),
means AS (SELECT c, j, list(s ORDER BY i) AS x FROM (SELECT c, j, i, avg(x[i]) AS s FROM y, range(1, 65) g(i) GROUP BY ALL) GROUP BY c, j),
away AS (SELECT y.c, y.j, avg(sqrt(list_sum(list_transform(list_zip(y.x, o.x), lambda p: pow(p[1] - p[2], 2))))) AS w, sum(list_sum(list_transform(list_zip(y.x, o.x), lambda p: pow(p[1] - p[2], 2)))) AS q FROM y JOIN means o USING (c, j) GROUP BY ALL),
apart AS (SELECT a.c, a.j, max((wa.w + wb.w) / sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda p: pow(p[1] - p[2], 2))))) AS r FROM means a JOIN means b ON a.c = b.c AND a.j <> b.j
  JOIN away wa ON wa.c = a.c AND wa.j = a.j JOIN away wb ON wb.c = b.c AND wb.j = b.j GROUP BY ALL),
db AS (SELECT c, avg(r) AS db FROM apart GROUP BY c),
ch AS (SELECT c, sum(n * list_sum(list_transform(x, lambda e: e * e))) / (count(*) - 1) / (sum(q) / (sum(n) - count(*))) AS ch, min(n) / sum(n) AS least FROM means JOIN n USING (c, j) JOIN away USING (c, j) GROUP BY c),
pairs AS (SELECT a.c, a.id, a.j, b.j AS other, sum(list_inner_product(a.x, a.x) + list_inner_product(b.x, b.x) - 2 * list_inner_product(a.x, b.x)) AS s FROM y a JOIN y b ON a.c = b.c GROUP BY ALL),
near AS (SELECT p.c, p.id, max(CASE WHEN p.j = other THEN n END) AS own, min(CASE WHEN p.j = other THEN s / greatest(n - 1, 1) END) AS a, min(CASE WHEN p.j <> other THEN s / n END) AS b FROM pairs p JOIN n ON n.c = p.c AND n.j = p.other GROUP BY ALL),
sil AS (SELECT c, avg(CASE WHEN own > 1 THEN (b - a) / greatest(a, b) ELSE 0 END) AS sil FROM near GROUP BY c)
SELECT 'kmeans' AS algo, CAST(k AS BIGINT) AS k, CAST(st AS BIGINT) AS start, round(cost, 6) AS cost, round(sil, 6) AS silhouette, round(ch, 6) AS calinski_harabasz, round(db, 6) AS davies_bouldin, round(least, 6) AS min_share
FROM cost JOIN sil USING (c) JOIN ch USING (c) JOIN db USING (c) WHERE r = 1"""))
def _(spark, root):
    return M.kmeans_sweep(whole_vectors(spark, root), "id", COLS, range(2, 11), starts=3, rounds=10)


@query("i5_gmm_sweep")
def _(spark, root):
    return C.sweep(C.standardise(stored(vectors(spark, root)), FEW), FEW, "gmm", range(2, 7))


SETS = [("S0001", "front", FEW[:4]), ("S0002", "back", FEW[2:]), ("S0003", "all", FEW)]


@query("i6_model_grid")
def _(spark, root):
    path = shared_dir(spark)
    rows = stored(vectors(spark, root).select("id", *FEW))
    C.model_grid(rows, "id", SETS, ["plain"], ["kmeans"], [3], path)  # an interrupted run ...
    return C.model_grid(rows, "id", SETS, ["plain", "pca"], ["kmeans", "bisecting"], [3], path)  # ... goes on


@query("i7_cluster_indices", """
WITH l AS (UNPIVOT vec ON """ + ", ".join(COLS) + """ INTO NAME f VALUE v), m AS (SELECT label, f, avg(v) AS m FROM l GROUP BY ALL), g AS (SELECT f, avg(v) AS g FROM l GROUP BY f),
n AS (SELECT label, count(*) AS n FROM vec GROUP BY label), b AS (SELECT sum(n * pow(m - g, 2)) AS b FROM m JOIN g USING (f) JOIN n USING (label)), w AS (SELECT sum(pow(v - m, 2)) AS w FROM l JOIN m USING (label, f)),
s AS (SELECT label, avg(d) AS s FROM (SELECT label, id, sqrt(sum(pow(v - m, 2))) AS d FROM l JOIN m USING (label, f) GROUP BY ALL) x GROUP BY label),
r AS (SELECT a.label, max((sa.s + sb.s) / d) AS r FROM (SELECT x.label, y.label AS other, sqrt(sum(pow(x.m - y.m, 2))) AS d FROM m x JOIN m y ON x.f = y.f AND x.label <> y.label GROUP BY ALL) a
  JOIN s sa ON sa.label = a.label JOIN s sb ON sb.label = a.other GROUP BY a.label)
SELECT (SELECT count(*) FROM n) AS n_clusters, (SELECT count(*) FROM vec) AS n, round((SELECT b FROM b) / ((SELECT count(*) FROM n) - 1) / ((SELECT w FROM w) / ((SELECT count(*) FROM vec) - (SELECT count(*) FROM n))), 6) AS calinski_harabasz,
  round((SELECT avg(r) FROM r), 6) AS davies_bouldin""", ("vec",))
def _(spark, root):
    return C.cluster_indices(vectors(spark, root), COLS, "label")


@query("i8_adjusted_rand", f"""
WITH c AS (SELECT label AS a, CAST(floor(f0 * 10) AS INTEGER) AS b, CAST(count(*) AS DOUBLE) AS c FROM vec GROUP BY ALL), i AS (SELECT {_PAIR.format(c='c')} AS i, sum(c) AS n FROM c),
ra AS (SELECT {_PAIR.format(c='s')} AS x FROM (SELECT sum(c) AS s FROM c GROUP BY a) t), rb AS (SELECT {_PAIR.format(c='s')} AS y FROM (SELECT sum(c) AS s FROM c GROUP BY b) t)
SELECT round((i - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 6) AS ari FROM i, ra, rb""", ("vec",))
def _(spark, root):
    return C.adjusted_rand(vectors(spark, root).withColumn("b", F.floor(F.col("f0") * 10)), "label", "b")


STABLE = [M.Candidate(k, 0, s) for k in range(3, 7) for s in [None, *range(1, 16)]]


@query("i8_stability_ari", kmeans_sql(STABLE, 10, f"""
w AS (SELECT p.k, q.c, a.j AS a, b.j AS b, CAST(count(*) AS DOUBLE) AS n FROM z b JOIN cand q ON q.c = b.c AND q.smp IS NOT NULL JOIN cand p ON p.k = q.k AND p.smp IS NULL JOIN z a ON a.c = p.c AND a.id = b.id GROUP BY ALL),
i AS (SELECT k, c, {_PAIR.format(c='n')} AS i, sum(n) AS n FROM w GROUP BY k, c), ra AS (SELECT c, {_PAIR.format(c='s')} AS x FROM (SELECT c, a, sum(n) AS s FROM w GROUP BY c, a) t GROUP BY c),
rb AS (SELECT c, {_PAIR.format(c='s')} AS y FROM (SELECT c, b, sum(n) AS s FROM w GROUP BY c, b) t GROUP BY c),
f AS (SELECT k, (i - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)) AS ari FROM i JOIN ra USING (c) JOIN rb USING (c))
SELECT CAST(k AS BIGINT) AS k, count(*) AS rounds, round(avg(ari), 6) AS ari_mean, round(stddev_pop(ari), 6) AS ari_std FROM f GROUP BY k"""))
def _(spark, root):
    return M.stability(whole_vectors(spark, root), "id", COLS, range(3, 7), samples=15, rounds=10)


@query("i9_select_balanced", """
WITH g AS (SELECT concat('S', c_nationkey) AS set_id, 'plain' AS variant, c_mktsegment AS algo, 2 + c_custkey % 5 AS k, round(avg(c_acctbal) / 10000, 6) AS silhouette, count(*) / 1000.0 AS min_share, round(max(c_acctbal) / 10000, 6) AS ari_mean
  FROM customer GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY set_id, variant, algo ORDER BY silhouette DESC, k) AS r FROM g),
p AS (SELECT *, row_number() OVER (PARTITION BY set_id, variant, algo ORDER BY ari_mean DESC, r) AS q FROM t WHERE r <= 3)
SELECT set_id, variant, algo, silhouette, ari_mean FROM p WHERE q = 1 AND k = 4 AND min_share >= 0.002""")
def _(spark, root):
    grid = table(spark, root, "customer").groupBy(
        F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("set_id"), F.lit("plain").alias("variant"), F.col("c_mktsegment").alias("algo"), (F.col("c_custkey") % 5 + 2).alias("k")
    ).agg(F.round(F.avg("c_acctbal") / 10000, 6).alias("silhouette"), (F.count(F.lit(1)) / 1000).alias("min_share"), F.round(F.max("c_acctbal") / 10000, 6).alias("ari_mean"))
    return C.select_balanced(grid, 4, 0.002).select("set_id", "variant", "algo", "silhouette", "ari_mean")


_TARGET = """
WITH r AS (SELECT n_regionkey AS g, label, n_orders FROM risk JOIN nation ON district = n_nationkey), m AS (SELECT g, count(*) AS n, avg(label) AS f, avg(n_orders) AS v FROM r GROUP BY g),
o AS (SELECT g, label, CAST(count(*) AS DOUBLE) AS o FROM r GROUP BY ALL), t AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT g) AS k, count(DISTINCT label) AS q FROM r),
x AS (SELECT a.g, b.label, a.s * b.s / n AS e FROM (SELECT g, sum(o) AS s FROM o GROUP BY g) a, (SELECT label, sum(o) AS s FROM o GROUP BY label) b, t),
c AS (SELECT sum(pow(coalesce(o, 0) - e, 2) / e) AS chi2 FROM x LEFT JOIN o USING (g, label)),
w AS (SELECT g, n_orders, rank() OVER (ORDER BY n_orders) + (count(*) OVER (PARTITION BY n_orders) - 1) / 2.0 AS rk FROM r), s AS (SELECT sum(rs * rs / n) AS s FROM (SELECT g, sum(rk) AS rs, count(*) AS n FROM w GROUP BY g) y),
u AS (SELECT sum(CAST(n AS DOUBLE) * (CAST(n AS DOUBLE) * n - 1)) AS ties FROM (SELECT n_orders, count(*) AS n FROM r GROUP BY 1) y),
h AS (SELECT (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM s, u, t)
SELECT k AS n_clusters, (SELECT round(max(f) - min(f), 6) FROM m) AS flag_range, (SELECT round(max(v) - min(v), 6) FROM m) AS value_range, round(sqrt(chi2 / (n * (least(k, q) - 1))), 6) AS cramers_v, round(chi2, 6) AS chi2,
  round(h, 6) AS h, round((h - k + 1) / (n - k), 6) AS epsilon2, """ + V.chi_tail_sql("chi2", "((k - 1) * (q - 1))") + " AS chi2_p, " + V.chi_tail_sql("h", "k - 1") + " AS h_p FROM c, h, t"


@query("i10_cluster_target_association", _TARGET, ("risk",))
def _(spark, root):
    labels = table(spark, root, "nation").select(F.col("n_nationkey").alias("district"), F.col("n_regionkey").alias("cluster"))
    return C.cluster_target_association(V.risk(spark, root), labels, "district", "label", "n_orders")


@query("i10_association_effects")
def _(spark, root):
    rows = stored(V.risk(spark, root))
    districts = rows.groupBy("district").agg(F.avg("balance").alias("balance"), F.avg("n_urgent").alias("urgent"))
    labels = C.fit_labels(C.standardise(districts, ["balance", "urgent"]), ["balance", "urgent"], "kmeans", 4)
    return C.cluster_target_association(rows, labels, "district", "label", "n_orders")


@query("i11_cluster_profile", """
WITH l AS MATERIALIZED (SELECT concat('f', i - 1) AS feature, CAST(label AS BIGINT) AS label, CAST(embedding[i] AS DOUBLE) AS y FROM embeddings, range(1, 65) g(i)),
o AS (SELECT feature, avg(y) AS m, stddev_samp(y) AS s FROM l GROUP BY feature),
r AS (SELECT feature, label, y, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS rk FROM l),
t AS (SELECT feature, sum(CAST(c AS DOUBLE) * (CAST(c AS DOUBLE) * c - 1)) AS ties FROM (SELECT feature, y, count(*) AS c FROM l GROUP BY ALL) q GROUP BY feature),
k AS (SELECT feature, count(*) AS k, CAST(sum(m) AS DOUBLE) AS n, sum(rs * rs / m) AS s FROM (SELECT feature, label, sum(rk) AS rs, count(*) AS m FROM r GROUP BY ALL) q GROUP BY feature),
h AS (SELECT feature, k, (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM k JOIN t USING (feature)),
p AS (SELECT feature, round(h, 6) AS h, """ + V.chi_tail_sql("h", "k - 1") + """ AS p_value FROM h)
SELECT feature, label, count(y) AS n, round(avg(y), 6) AS mean, round((avg(y) - any_value(o.m)) / any_value(o.s), 6) AS z, any_value(p.h) AS h, any_value(p.p_value) AS p_value
FROM l JOIN o USING (feature) JOIN p USING (feature) GROUP BY feature, label""")
def _(spark, root):
    return C.cluster_profile(V.vectors(spark, root), "label", COLS)


_DENSE = """
WITH RECURSIVE d AS MATERIALIZED (SELECT a.point_id AS a, b.point_id AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS far FROM points a, points b),
k AS (SELECT a, far, row_number() OVER (PARTITION BY a ORDER BY far) AS r FROM d)"""


@query("i12_kth_distance", _DENSE + " SELECT a AS point_id, round(far, 6) AS distance FROM k WHERE r = 5", ("points",))
def _(spark, root):
    return S.kth_distance(V.points(spark, root), "x", "y", 5).select("point_id", "distance")


@query("i12_density_eps", _DENSE + """, q AS (SELECT r, quantile_cont(far, [0.25, 0.5, 0.75, 0.9]) AS q FROM k WHERE r IN (5, 10, 15) GROUP BY r)
SELECT r AS min_samples, unnest([0.25, 0.5, 0.75, 0.9]::DOUBLE[]) AS share, round(unnest(q), 6) AS eps FROM q""", ("points",))
def _(spark, root):
    shares = [0.25, 0.5, 0.75, 0.9]
    rows = [(m, s, e) for m in (5, 10, 15) for s, e in zip(shares, C.density_eps(V.points(spark, root), "x", "y", m, shares))]
    return spark.createDataFrame(rows, "min_samples int, share double, eps double")


@query("i12_density_cluster", """
WITH RECURSIVE d AS MATERIALIZED (SELECT a.point_id AS a, b.point_id AS b FROM points a JOIN points b ON pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 900.0 * 900.0),
core AS MATERIALIZED (SELECT a FROM d GROUP BY a HAVING count(*) >= 5), e AS MATERIALIZED (SELECT d.a, d.b FROM d SEMI JOIN core c1 ON d.a = c1.a SEMI JOIN core c2 ON d.b = c2.a),
reach AS (SELECT a AS node, a AS seed FROM core UNION SELECT e.b, r.seed FROM reach r JOIN e ON r.node = e.a),
comp AS (SELECT node, min(seed) AS c FROM reach GROUP BY node)
SELECT p.point_id, c.c AS first_core, p.point_id NOT IN (SELECT d.a FROM d SEMI JOIN core c2 ON d.b = c2.a) AS noise FROM points p LEFT JOIN comp c ON c.node = p.point_id""", ("points",))
def _(spark, root):
    # clusters are named by their first core point; a border point may belong to several, so only its being no noise is compared
    points = stored(V.points(spark, root).select("point_id", "x", "y"))
    found = stored(C.density_cluster(points, "point_id", "x", "y", 900.0, 5).select("point_id", "cluster"))
    core = S.kth_distance(points, "x", "y", 5).where(F.col("distance") <= 900.0).select("point_id")
    held = stored(found.join(core, "point_id"))
    first = held.groupBy("cluster").agg(F.min("point_id").alias("first_core"))
    named = held.join(first, "cluster").select("point_id", "first_core")
    return found.join(named, "point_id", "left").select("point_id", "first_core", F.col("cluster").isNull().alias("noise"))


@query("i12_density_grid")
def _(spark, root):
    rows = V.points(spark, root).select("point_id", "x", "y")
    return C.density_grid(rows, "point_id", "x", "y", [5, 10, 15])
