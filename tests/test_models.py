import math
import random

import numpy as np
from pyspark.sql import functions as F

from __spark_entry__ import queries
from lotline.operators import clustering as C
from lotline.operators import screening as Q
from lotline.operators import supervised as M
from lotline.runtime import shared_dir


def people(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, c = rng.gauss(0, 1), rng.choice("pqr")
        rows.append((i, i % 23, x, rng.random(), c, int(x + rng.gauss(0, 0.7) > 0.8)))
    return spark.createDataFrame(rows, "id long, g int, x double, noise double, c string, y int")


def test_groups_stay_in_one_fold(spark):
    out = M.group_folds(people(spark), "g", "y", 4)
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    sizes = [r["p"] for r in out.groupBy("fold").agg(F.sum("y").alias("p")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 0.5 * max(sizes)


def test_auc_and_average_precision(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.1, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert math.isclose(M.roc_auc(df, "y", "s").first()[0], want)
    assert math.isclose(M.average_precision(df, "y", "s").first()[0], 1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    scan = {r["threshold"]: r for r in M.threshold_scan(df, "y", "s", [0.5, 0.95]).collect()}
    assert (scan[0.5]["tp"], scan[0.5]["fp"], scan[0.5]["tn"], scan[0.5]["fn"]) == (2, 1, 1, 1)
    assert scan[0.95]["precision"] is None and scan[0.95]["f1"] == 0.0


def test_random_category_does_not_lift_auc(spark):
    """Target rates of a random category, computed without the own fold, must carry no signal."""
    rows = M.group_folds(people(spark), "g", "y", 4)
    shares = rows.select("id", F.col("c").alias("cat"), F.lit(1.0).alias("share"))
    out = M.oof_target_rate(shares, rows, "id", "cat", "share", "y")
    assert out.where("expected is null").isEmpty()
    assert M.roc_auc(out, "y", "expected").first()[0] < 0.58


def test_importance_finds_the_signal(spark):
    rows = people(spark)
    model = M.fit_classifier(rows, ["x", "noise"], [], "y", "logistic")
    drop = {r["variable"]: r["auc_drop"] for r in M.permutation_importance(model, rows, "id", "y", {"x": ["x"], "noise": ["noise"]}, 1).collect()}
    assert drop["x"] > 0.15 and abs(drop["noise"]) < 0.05


def test_linear_models_from_gram_matrices(spark):
    import numpy as np

    rows = M.group_folds(people(spark).withColumn("t", F.col("x") * 2 - F.col("noise") + F.when(F.col("c") == "q", 1.5).otherwise(0.0)), "g", "y", 4)
    rows = rows.withColumn("flat", F.lit(3.0))
    got = {(r.model, r.fold): r.r2 for r in M.cv_linear(rows, ["x", "noise", "flat"], "t", ["c"], ridge=2.0, lasso=0.05).collect()}
    data = rows.collect()
    x = np.array([[r.x, r.noise, 3.0, *(float(r.c == v) for v in "pqr")] for r in data])
    y, fold = np.array([r.t for r in data]), np.array([r.fold for r in data])
    for f in range(4):
        a, b = x[fold != f], y[fold != f]
        mean, centre = a.mean(axis=0), b.mean()
        w = np.linalg.solve((a - mean).T @ (a - mean) + 2.0 * np.eye(6), (a - mean).T @ (b - centre))
        t, z = x[fold == f], y[fold == f]
        assert abs(got["ridge", f] - (1 - ((z - centre - (t - mean) @ w) ** 2).sum() / ((z - z.mean()) ** 2).sum())) < 1e-9
    # lasso: the gradient of the squares is alpha in size where a weight stands, and no larger elsewhere
    gram = sum(M.fold_grams(rows, ["x", "noise"], "t").values())
    w = M.solve_gram(gram, "lasso", 0.05)
    v = np.array([[r.x, r.noise] for r in data])
    slope = (v - v.mean(axis=0)).T @ (y - w[0] - v @ w[1:]) / len(y)
    assert all(abs(abs(g) - 0.05) < 1e-8 and g * u > 0 if u else abs(g) <= 0.05 + 1e-8 for g, u in zip(slope, w[1:]))


def test_ordered_target_rate_sees_earlier_rows_only(spark):
    import hashlib

    rows = [(i, None if i % 7 == 0 else ("a" if i % 3 else f"c{i % 5}"), None if i % 11 == 0 else int(i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, c string, y int")
    known = [y for _, _, y in rows if y is not None]
    mean = sum(known) / len(known)
    order = sorted(rows, key=lambda r: (int(hashlib.md5(f"42|{r[0]}".encode()).hexdigest()[:8], 16), r[0]))
    want, seen = {}, {}
    for i, c, y in order:
        total, n = seen.get(c, (0, 0))
        want[i] = (total + 2.0 * mean) / (n + 2.0)
        if y is not None:
            seen[c] = (total + y, n + 1)
    for part_rows in (10, 10**6):
        got = {r.id: r.rate for r in M.ordered_target_rate(df, "id", "c", "y", weight=2.0, part_rows=part_rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    folded = M.fold_target_rate(df.withColumn("fold", (F.col("id") % 3).cast("int")), 1, "id", "c", "y", "rate")
    assert folded.count() == 300 and folded.where("rate is null").isEmpty()


def test_many_models_share_scans(spark):
    import numpy as np

    from lotline.operators import many_models as N

    rng = random.Random(3)
    spots = [[rng.gauss(4 * (i % 4), 1), rng.gauss(3 * (i % 2), 1), rng.random()] for i in range(240)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(999, None, 1.0, 1.0)], "id long, a double, b double, c double").repartition(3)
    some = [N.Candidate(k, s, m) for k in (2, 4) for s in (0, 1) for m in (None, 5)]
    models = N.kmeans_many(df, "id", ["a", "b", "c"], some, 15)
    found = {r.candidate: r for r in N.indices(models).collect()}
    x = np.array(spots)
    for c, cand in enumerate(some):
        from hashlib import md5
        share = lambda i: int(md5(f"{cand.sample}|{i}".encode()).hexdigest()[:8], 16) / 2**32  # noqa: E731, B023
        own = [i for i in range(240) if cand.sample is None or share(i) < 0.8]
        order = sorted(own, key=lambda i: (md5(f"{cand.start}|{i}".encode()).hexdigest(), i))
        centres = x[order[: cand.k]]
        for _ in range(15):
            which = ((x[own][:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.array([x[own][which == j].mean(axis=0) if (which == j).any() else centres[j] for j in range(cand.k)])
        assert np.allclose(centres, models.centres[c])
        which = ((x[own][:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        gap = ((x[own][:, None] - x[own]) ** 2).sum(axis=2)
        sil = []
        for i in range(len(own)):
            inner = gap[i][which == which[i]].sum() / max((which == which[i]).sum() - 1, 1)
            outer = min(gap[i][which == j].mean() for j in set(which.tolist()) - {which[i]})
            sil.append((outer - inner) / max(inner, outer))
        assert abs(found[c].silhouette - np.mean(sil)) < 1e-9
        assert abs(found[c].min_share - np.bincount(which).min() / len(own)) < 1e-12
        plain = C.cluster_indices(spark.createDataFrame([(*spots[i], int(w)) for i, w in zip(own, which)], "a double, b double, c double, cluster int"), ["a", "b", "c"], "cluster").first()
        assert abs(found[c].calinski_harabasz - plain["calinski_harabasz"]) < 1e-6 and abs(found[c].davies_bouldin - plain["davies_bouldin"]) < 1e-9
    both = N.labels(models, [0, 1])
    inside = both.where("id <> -1").join(models.rows.where("inside[1]").select("id"), "id")
    assert abs(N.agreement(models, [(0, 1)]).first()["ari"] - C.adjusted_rand(inside, "c0", "c1").first()[0]) < 1e-12


def test_density_clusters_match_plain_search(spark):
    rng = random.Random(4)
    spots = [(rng.gauss(cx, 0.4), rng.gauss(cy, 0.4)) for cx, cy in [(0, 0), (4, 0), (0, 5)] for _ in range(60)] + [(20.0, 20.0), (2.0, 9.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id int, x double, y double")
    got = {r["id"]: r["cluster"] for r in C.density_cluster(df, "id", "x", "y", 0.6, 5).collect()}
    near = [[j for j, q in enumerate(spots) if math.dist(p, q) <= 0.6] for p in spots]
    core = {i for i, n in enumerate(near) if len(n) >= 5}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in label:
                    label[j] = i
                    todo += [m for m in near[j] if m in core]
    assert {i for i, c in got.items() if c is None} == {i for i in range(len(spots)) if not core & set(near[i])}
    pairs = {(label[i], got[i]) for i in core}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_density_grid_takes_every_min_samples_and_eps(spark):
    """All runs together give what each gives alone, with eps from the k-distances; copies of every row make these 0."""
    query = queries()["i12_density_grid"](spark, "/root/testdata/sf0.001")
    assert sorted(r["min_samples"] for r in query.collect()) == [5] * 4 + [10] * 4 + [15] * 4
    rng = random.Random(6)
    spots = [(float(rng.randrange(9)), float(rng.randrange(9))) for _ in range(50)] + [(rng.gauss(30, 1), rng.gauss(30, 1)) for _ in range(40)]
    kind = "id int, x double, y double"
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)] + [(90, None, 1.0), (91, float("nan"), 1.0)], kind)
    far = [[math.sqrt((a - c) * (a - c) + (b - d) * (b - d)) for c, d in spots] for a, b in spots]
    want = []
    for m in (5, 10):
        for eps in np.percentile([sorted(f)[m - 1] for f in far], [25, 50, 75, 90]):
            near = [{j for j, d in enumerate(f) if d <= eps} for f in far]
            core = {i for i, n in enumerate(near) if len(n) >= m}
            left, n_clusters = set(core), 0
            while left:
                todo, n_clusters = [left.pop()], n_clusters + 1
                while todo:
                    met = near[todo.pop()] & left
                    left -= met
                    todo += met
            want.append((m, float(eps), n_clusters, (2 + sum(not n & core for n in near)) / 92))
    got = sorted(tuple(r) for r in C.density_grid(df, "id", "x", "y", [5, 10]).collect())
    assert len(got) == len(want) == 8
    assert all(a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-12 and abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want))
    copies = spark.createDataFrame([(i, float(i % 3), 0.0) for i in range(18)] + [(18, 50.0, 0.0)], kind)
    assert [tuple(r) for r in C.density_grid(copies, "id", "x", "y", [5]).collect()] == [(5, 0.0, 3, 1 / 19)] * 4
    assert C.density_cluster(copies, "id", "x", "y", 0.0, 5).where("cluster is null").count() == 1


def test_components_of_long_paths_keep_their_estimated_size(spark):
    rng = random.Random(8)
    names = [f"{i:03d}" for i in rng.sample(range(400), 120)]
    ways = [names[:70], names[70:119], names[119:]]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    edges = spark.createDataFrame([p for way in ways for p in zip(way[:-1], way[1:])], "a string, b string")
    found = C.connected_components(nodes, edges)
    assert {(r["node"], r["component"]) for r in found.collect()} == {(n, min(way)) for way in ways for n in way}
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 12


def test_grid_skips_finished_candidates(spark):
    df = people(spark, 120).select("id", "x", "noise", (F.col("x") * 2 + F.col("noise")).alias("z"))
    path = shared_dir(spark)
    sets = [("S1", "all", ["x", "noise", "z"])]
    first = C.model_grid(df, "id", sets, ["plain"], ["kmeans"], [3], path).count()
    files = spark.read.parquet(path).inputFiles()
    again = C.model_grid(df, "id", sets, ["plain"], ["kmeans"], [3], path)
    assert first == again.count() == 1 and sorted(again.inputFiles()) == sorted(files)


def test_grid_reads_rows_twice_a_candidate_and_halves_centred_data(spark):
    """All indices of a candidate come from two scans, and equal those of Spark's evaluator; bisecting parts data whose mean is zero."""
    df = people(spark, 120).select("id", "x", "noise")
    scaled = C.standardise(df, ["x", "noise"]).cache()
    halves = C.fit_labels(scaled, ["x", "noise"], "bisecting", 3).cache()
    assert halves.select("cluster").distinct().count() == 3
    got = C.cluster_quality(halves, ["x", "noise"], "cluster")
    assert abs(got["silhouette"] - C.silhouette(halves, ["x", "noise"])) < 1e-9
    plain = C.cluster_indices(halves, ["x", "noise"], "cluster").first()
    assert all(abs(got[c] - plain[c]) < 1e-9 for c in ("n_clusters", "n", "calinski_harabasz", "davies_bouldin"))
    rows = [(0.0, 0.0, 0), (0.5, 0.0, 0), (9.0, 1.0, 1), (4.0, 4.0, 2), (4.5, 4.0, 2)]
    few = spark.createDataFrame(rows, "a double, b double, cluster int")
    assert abs(C.cluster_quality(few, ["a", "b"], "cluster")["silhouette"] - C.silhouette(few, ["a", "b"])) < 1e-12
    one = C.cluster_quality(few.where("cluster = 0"), ["a", "b"], "cluster")
    assert one["silhouette"] is None and one["min_share"] == 1


def test_forest_rows_are_dealt_to_all_cores(spark, monkeypatch):
    """A table in one partition is trained on in as many as there are cores; one fold at a time gives like figures."""
    df = people(spark, 300).select("id", "x", "noise", (F.col("x") * 2 + F.col("noise")).alias("z"), (F.col("id") % 3).cast("int").alias("fold")).coalesce(1)
    seen, fit = [], M.Pipeline.fit

    def watched(self, rows, params=None):
        seen.append(rows.rdd.getNumPartitions())
        return fit(self, rows, params)

    monkeypatch.setattr(M.Pipeline, "fit", watched)
    got = M.cv_forest(df, ["x", "noise"], "z", trees=5).orderBy("fold").collect()
    assert [r.fold for r in got] == [0, 1, 2] and all(r.r2 > 0.5 for r in got)
    assert seen == [spark.sparkContext.defaultParallelism] * 3
    monkeypatch.setattr(M, "GROWN", 1)
    again = M.cv_forest(df, ["x", "noise"], "z", trees=5).orderBy("fold").collect()
    assert all(abs(a.r2 - b.r2) < 0.05 for a, b in zip(again, got, strict=True))


def test_screening_rules(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((a, a + rng.gauss(0, 0.05), b, 1.0, math.exp(b), 0.3, 0.7))
    df = spark.createDataFrame(rows, "a double, twin double, b_log double, flat double, b double, p double, q double")
    _, kept, log = Q.screen_variables(df, df.columns, compositions={"q": ["p", "q"]}, keep=["a"])
    assert "flat" not in kept and "twin" not in kept and "a" in kept and "q" not in kept and "p" in kept
    assert "b_log" in kept and "b" not in kept
    assert ("q", "dropped", "reference category") in log
    sets = Q.candidate_sets(["v1", "v2", "v3", "s1", "s2"], {"A": ["v"], "B": ["s"]}, sizes=(2, 3), cap=2)
    assert {g for _, g, _ in sets} == {"A", "B", "A+B"} and len({i for i, _, _ in sets}) == len(sets)
