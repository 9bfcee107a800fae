"""Unsupervised models on Spark ML, their quality indices and stability, density clustering on cells."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.operators.ordinals import exact_quantiles, quantile_values
from lotline.operators.ranked import hash_share, quantile_bins, top_per_group
from lotline.operators.spatial import kth_distance, kth_distances
from lotline.operators.statistics import chi_square_v, kruskal, kruskal_by
from lotline.runtime import pinned, scalar, stored


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean and unit *population* deviation (the ML scaler divides by the sample deviation);
    constant columns become 0."""
    one = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return df.withColumns({c: (F.col(c) - F.lit(one[f"m_{c}"])) / F.lit(one[f"s_{c}"] or 1.0) for c in cols})


def vectorise(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=name, handleInvalid="skip").transform(df)


def pca_fit(df: DataFrame, cols: Sequence[str], min_var: float = 0.9) -> tuple[DataFrame, DataFrame, int, int]:
    """(component table, scores, components kept for ``min_var``, components with eigenvalue above 1).

    ``df`` is standardised; the component table has eigenvalue, share, cumulative share and loadings.
    """
    packed = vectorise(df, cols)
    n, d = packed.count(), len(cols)
    model = PCA(k=d, inputCol="features", outputCol="scores").fit(packed)
    share = [float(v) for v in model.explainedVariance]
    axes = model.pc.toArray()
    total, rows = 0.0, []
    for i, s in enumerate(share):
        total += s
        value = s * d * n / (n - 1)
        rows.append((f"pc{i + 1}", value, s, total, [float(axes[j, i] * math.sqrt(max(value, 0))) for j in range(d)]))
    table = df.sparkSession.createDataFrame(rows, "component string, eigenvalue double, share double, cumulative double, loadings array<double>")
    keep = next((i + 1 for i, r in enumerate(rows) if r[3] >= min_var - 1e-12), d)
    scores = model.transform(packed).withColumn("_s", vector_to_array("scores"))
    others = [c for c in df.columns if c not in cols]
    scores = scores.select(*others, *[F.col("_s")[i].alias(f"pc{i + 1}") for i in range(keep)])
    return table, scores, keep, sum(r[1] > 1 for r in rows)


def score_decile_lift(df: DataFrame, scores: Sequence[str], label: str, q: int = 10) -> DataFrame:
    """Label rate and lift per decile of each score."""
    base = scalar(df, F.avg(label))
    parts = []
    for s in scores:
        binned = quantile_bins(df, s, q, "_bin").where(F.col("_bin").isNotNull())
        parts.append(binned.groupBy((F.col("_bin.bin_idx") + 1).alias("decile")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate")).withColumn("score", F.lit(s)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("lift", F.col("rate") / base)


def decile_spread(deciles: DataFrame) -> DataFrame:
    """Largest minus smallest rate per score."""
    return deciles.groupBy("score").agg((F.max("rate") - F.min("rate")).alias("spread"))


def fit_labels(df: DataFrame, cols: Sequence[str], algo: str, k: int, seed: int = 42) -> DataFrame:
    """Rows with an integer ``cluster``. Algorithms: kmeans, bisecting (hierarchical), gmm."""
    makers = {
        "kmeans": lambda: KMeans(k=k, seed=seed, maxIter=30), "bisecting": lambda: BisectingKMeans(k=k, seed=seed),
        "gmm": lambda: GaussianMixture(k=k, seed=seed, maxIter=30),
    }
    packed = vectorise(df, cols)
    if algo == "bisecting":  # it parts a cluster by a share of its centre's length, so a centre at zero is never parted
        packed = vectorise(df.withColumns({f"{c}__moved": F.col(c) + 1.0 for c in cols}), [f"{c}__moved" for c in cols])
    model = makers[algo]().setFeaturesCol("features").setPredictionCol("cluster").fit(packed)
    keep = [*df.columns, "cluster"]
    return model.transform(packed).select(*keep)


def cluster_indices(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin from per-cluster counts, means and sums; one row.

    Only k centroids reach the driver; rows are read twice.
    """
    got = cluster_quality(df, cols, label, False)
    return df.sparkSession.createDataFrame(
        [tuple(got[c] for c in ("n_clusters", "n", "calinski_harabasz", "davies_bouldin"))],
        "n_clusters int, n bigint, calinski_harabasz double, davies_bouldin double")


def cluster_quality(df: DataFrame, cols: Sequence[str], label: str, shape: bool = True) -> dict:
    """The indices, the smallest cluster's share and (with ``shape``) the mean silhouette, in two scans for all of them.

    The mean squared distance from a row to a cluster is that to its mean and the cluster's variance together.
    """
    spread_of = [F.var_pop(c).alias(f"q_{c}") for c in cols]
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in cols], *spread_of).collect()
    n, k = sum(r["n"] for r in per), len(per)
    grand = [sum(r["n"] * r[f"m_{c}"] for r in per) / n for c in cols]
    between = sum(r["n"] * (r[f"m_{c}"] - g) ** 2 for r in per for c, g in zip(cols, grand))
    within = sum(r["n"] * r[f"q_{c}"] for r in per for c in cols)
    centres = df.sparkSession.createDataFrame(
        [(r[label], [float(r[f"m_{c}"]) for c in cols]) for r in per], f"{label} {df.schema[label].dataType.simpleString()}, _c array<double>")

    def squares(centre: list) -> Column:
        terms = [(F.col(c) - m) * (F.col(c) - m) for c, m in zip(cols, centre)]
        return sum(terms[1:], terms[0])

    placed = df.join(F.broadcast(centres), label).withColumn("_own", squares([F.col("_c")[i] for i in range(len(cols))]))
    means = [F.avg(F.sqrt("_own")).alias("s")]
    if shape and k > 1:
        inner, others = F.lit(0.0), F.lit(None).cast("double")
        for r in per:
            spread, mine = sum(r[f"q_{c}"] for c in cols), F.col(label) == r[label]
            inner = F.when(mine, (F.col("_own") + spread) * (r["n"] / max(1, r["n"] - 1))).otherwise(inner)
            others = F.least(others, F.when(~mine, squares([float(r[f"m_{c}"]) for c in cols]) + spread))
        single = [r[label] for r in per if r["n"] == 1]
        value = F.when(F.col("_in") < F.col("_out"), 1 - F.col("_in") / F.col("_out")).when(F.col("_in") > F.col("_out"), F.col("_out") / F.col("_in") - 1).otherwise(0.0)
        placed = placed.withColumns({"_in": inner, "_out": others})
        means.append(F.sum(F.when(F.col(label).isin(single), 0.0).otherwise(value) if single else value).alias("shape"))
    second = {r[label]: r for r in placed.groupBy(label).agg(*means).collect()}
    spread = {c: r["s"] for c, r in second.items()}
    place = {r[label]: [r[f"m_{c}"] for c in cols] for r in per}
    worst = [
        max((spread[a] + spread[b]) / math.dist(place[a], place[b]) for b in place if b != a and math.dist(place[a], place[b]) > 0)
        for a in place
    ] if k > 1 else [float("nan")]
    return {
        "n_clusters": k, "n": n, "min_share": min(r["n"] for r in per) / n,
        "calinski_harabasz": (between / (k - 1)) / (within / (n - k)) if k > 1 and within > 0 else None,
        "davies_bouldin": sum(worst) / len(worst) if k > 1 else None,
        "silhouette": sum(r["shape"] for r in second.values()) / n if shape and k > 1 else None,
    }


def silhouette(df: DataFrame, cols: Sequence[str], label: str = "cluster") -> float:
    """Mean silhouette with squared Euclidean distance, linear in rows (not the quadratic exact one)."""
    return ClusteringEvaluator(featuresCol="features", predictionCol=label).evaluate(vectorise(df, cols))


def sweep(df: DataFrame, cols: Sequence[str], algo: str, ks: Sequence[int], seed: int = 42) -> DataFrame:
    """One row per k with cost (kmeans: inertia; gmm: negative log likelihood) and the indices."""
    packed = vectorise(df.select(*cols), cols).cache()
    rows = []
    for k in ks:
        if algo == "gmm":
            model = GaussianMixture(k=k, seed=seed, maxIter=30, featuresCol="features", predictionCol="cluster").fit(packed)
            cost = -float(model.summary.logLikelihood)
        else:
            model = KMeans(k=k, seed=seed, maxIter=30, featuresCol="features", predictionCol="cluster").fit(packed)
            cost = float(model.summary.trainingCost)
        out = model.transform(packed).select(*cols, "cluster")
        got = cluster_quality(out, cols, "cluster")
        rows.append((algo, k, cost, got["silhouette"], got["calinski_harabasz"], got["davies_bouldin"], got["min_share"]))
    packed.unpersist()
    return df.sparkSession.createDataFrame(
        rows, "algo string, k int, cost double, silhouette double, calinski_harabasz double, davies_bouldin double, min_share double")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """I8: adjusted Rand index of two labelings from their contingency counts."""
    def pairs(col):
        return F.sum(col * (col - 1) / 2.0)

    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("c"))
    rows = cells.groupBy(a).agg(F.sum("c").alias("c"))
    cols = cells.groupBy(b).agg(F.sum("c").alias("c"))
    one = cells.agg(pairs(F.col("c")).alias("both"), F.sum("c").alias("n")).withColumns(
        {"ra": rows.agg(pairs(F.col("c"))).scalar(), "rb": cols.agg(pairs(F.col("c"))).scalar()})
    expected = F.col("ra") * F.col("rb") / (F.col("n") * (F.col("n") - 1) / 2.0)
    top = (F.col("ra") + F.col("rb")) / 2.0
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def stability_ari(
    df: DataFrame, key: str, fit: Callable[[DataFrame], DataFrame], rounds: int = 15, frac: float = 0.8, seed: int = 42,
) -> DataFrame:
    """I8: mean and deviation of the ARI between labels of the whole and of refits on hash samples of the rows."""
    base = stored(fit(df).select(key, F.col("cluster").alias("base")))
    values = []
    for i in range(rounds):
        part = df.where(hash_share([key], seed + i) < frac)
        again = fit(part).select(key, F.col("cluster").alias("again"))
        values.append(adjusted_rand(base.join(again, key), "base", "again").first()[0])
    mean = sum(values) / len(values)
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return df.sparkSession.createDataFrame([(rounds, mean, std)], "rounds int, ari_mean double, ari_std double")


#: Candidates of a grid that are fitted at the same time.
AT_ONCE = 4
GRID_SCHEMA = "set_id string, variant string, algo string, k int, silhouette double, calinski_harabasz double, davies_bouldin double, min_share double, ari_mean double"


def model_grid(
    df: DataFrame, key: str, sets: Sequence[tuple[str, str, Sequence[str]]], variants: Sequence[str], algos: Sequence[str],
    ks: Sequence[int], path: str, rounds: int = 0,
) -> DataFrame:
    """Every (feature set, variant, algorithm, k) once; results are appended to ``path`` candidate by
    candidate, and keys already there are skipped, so an interrupted run goes on where it stopped."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    done: set[tuple] = set()
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        done = {tuple(r) for r in spark.read.schema(GRID_SCHEMA).parquet(path).select("set_id", "variant", "algo", "k").collect()}
    def candidate(set_id: str, variant: str, data: DataFrame, names: list[str], algo: str, k: int) -> tuple:
        out = fit_labels(data, names, algo, k).cache()
        got = cluster_quality(out, names, "cluster")
        ari = stability_ari(data, key, lambda d: fit_labels(d, names, algo, k), rounds).first()["ari_mean"] if rounds else None
        out.unpersist()
        return set_id, variant, algo, k, got["silhouette"], got["calinski_harabasz"], got["davies_bouldin"], got["min_share"], ari

    # a task for each core; a fit's many small jobs leave cores to those of the next candidates
    cores = spark.sparkContext.defaultParallelism
    with ThreadPoolExecutor(AT_ONCE) as pool:
        for set_id, _, cols in sets:
            left = {v: [(a, k) for a, k in itertools.product(algos, ks) if (set_id, v, a, k) not in done] for v in variants}
            if not any(left.values()):
                continue
            plain = standardise(df.select(key, *cols).na.drop(), cols).repartition(cores, key).cache()
            held, fits = [plain], []
            for variant in variants:
                data, names = plain, list(cols)
                if left[variant] and variant == "pca":
                    _, data, keep, _ = pca_fit(plain, cols)
                    if keep < 2:
                        continue
                    data, names = data.cache(), [f"pc{i + 1}" for i in range(keep)]
                    held.append(data)
                fits += [pool.submit(inheritable_thread_target(spark)(candidate), set_id, variant, data, names, a, k) for a, k in left[variant]]
            for fit in fits:
                spark.createDataFrame([fit.result()], GRID_SCHEMA).write.mode("append").parquet(path)
            for x in held:
                x.unpersist()
    return spark.read.schema(GRID_SCHEMA).parquet(path)


def select_balanced(grid: DataFrame, k: int = 4, min_share: float = 0.03, top: int = 3) -> DataFrame:
    """Per (set, variant, algorithm) the number of clusters with the best stability among the ``top``
    silhouettes; of these picks the ones with ``k`` clusters, none below ``min_share``, best silhouette first."""
    keys = ["set_id", "variant", "algo"]
    best = top_per_group(grid, keys,
                         [F.col("silhouette").desc_nulls_last(), F.col("k").asc()], top, rank="_r")
    one = top_per_group(best, keys, [F.col("ari_mean").desc_nulls_last(), F.col("_r").asc()], 1, rank="_p")
    one = one.where(F.col("k") == k).where(F.col("min_share") >= min_share)
    return one.drop("_r", "_p").orderBy(F.col("silhouette").desc_nulls_last(), F.col("ari_mean").desc_nulls_last(), *keys)


def cluster_target_association(rows: DataFrame, labels: DataFrame, on: str, flag: str, value: str) -> DataFrame:
    """Labels of groups joined to their rows: Cramer's V with a flag, epsilon squared with a number, both with
    p-values, and the range of both means over the clusters."""
    joined = rows.join(labels.select(on, "cluster"), on).select("cluster", flag, value)
    joined = stored(joined)
    chi, kw = chi_square_v(joined, "cluster", flag), kruskal(joined, "cluster", value)
    per = joined.groupBy("cluster").agg(F.avg(flag).alias("f"), F.avg(value).alias("v"))
    return per.agg(F.count(F.lit(1)).alias("n_clusters"), (F.max("f") - F.min("f")).alias("flag_range"),
                   (F.max("v") - F.min("v")).alias("value_range")).withColumns({
        "cramers_v": chi.select("cramers_v").scalar(), "chi2": chi.select("chi2").scalar(),
        "h": kw.select("h").scalar(), "epsilon2": kw.select("epsilon2").scalar(),
        "chi2_p": chi.select("p_value").scalar(), "h_p": kw.select("p_value").scalar(),
    })


def cluster_profile(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Per feature and cluster the mean and its z score against all rows, and per feature the Kruskal-Wallis test over the
    clusters: the stacked table is ranked by (feature, value) once for all features."""
    long = stored(df.select(label, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols]))))
    overall = long.groupBy("feature").agg(F.avg("v").alias("_m"), F.stddev_samp("v").alias("_s"))
    means = long.groupBy("feature", label).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    tests = kruskal_by(long, "feature", label, "v").select("feature", "h", "p_value")
    return means.join(overall, "feature").join(tests, "feature", "left").select(
        "feature", label, "n", "mean", ((F.col("mean") - F.col("_m")) / F.nullif("_s", F.lit(0.0))).alias("z"), "h", "p_value")


#: Percentiles of the k-distances that a grid takes for eps.
EPS_SHARES = (0.25, 0.5, 0.75, 0.9)


def density_eps(df: DataFrame, x: str, y: str, min_samples: int, shares: Sequence[float] = EPS_SHARES) -> list[float]:
    """Candidates for eps: percentiles of the exact distance of each row to its ``min_samples``-th nearest row."""
    far = stored(kth_distance(df.select(x, y), x, y, min_samples).select("distance"))
    return [v for v in quantile_values(far, "distance", shares) if v is not None]


def _distances(points: DataFrame, x: str, y: str, ks: Sequence[int], shares: Sequence[float]) -> list[list[float]]:
    """Candidates for eps of each of ``ks``, all distances from one search."""
    far = kth_distances(points, x, y, ks).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("run"), F.col(f"distance_{k}").alias("distance")) for i, k in enumerate(ks)])))
    names = {f"q{i}": p for i, p in enumerate(shares)}
    got = {r["run"]: [r[n] for n in names] for r in exact_quantiles(stored(far), "distance", names, by=["run"]).collect()}
    return [got.get(i, []) for i in range(len(ks))]


def density_cluster(df: DataFrame, key: str, x: str, y: str, eps: float, min_samples: int) -> DataFrame:
    """Density clusters in the plane (two components): ``cluster`` is a cell-based id, null for noise.

    Cells have a diagonal of eps, so all points of a cell are neighbours: a full cell needs no look at pairs,
    and components are found between cells, not between points. Equal coordinates are one point with a count.
    Two cells are joined without pairs when their boxes of core points lie within eps of each other; the
    others are looked at part by part (``_linked_cells``).
    """
    final = _density_runs(_coordinates(df, x, y), [(min_samples, eps)]).drop("run")
    joined = df.withColumns({"_x": F.col(x).cast("double"), "_y": F.col(y).cast("double")})
    return joined.join(final.withColumnsRenamed({"x": "_x", "y": "_y"}), ["_x", "_y"], "left").select(*df.columns, "cluster")


def _coordinates(df: DataFrame, x: str, y: str) -> DataFrame:
    """x, y and the number of rows there; rows without a coordinate are left out."""
    at = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    return stored(at.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))


def _density_runs(spots: DataFrame, runs: Sequence[tuple[int, float]]) -> DataFrame:
    """run (place in ``runs``: min_samples, eps), x, y and cluster of the coordinates that are in one. All runs go through the same
    steps together, so that the number of steps is that of one run. With an eps of 0 only equal coordinates are neighbours."""
    of = lambda values: F.get(F.array(*[F.lit(v) for v in values]), "run")
    least, eps = of([int(m) for m, _ in runs]), of([float(e) for _, e in runs])
    side = of([e / math.sqrt(2) * (1 - 1e-9) for _, e in runs])
    still, moving = ([i for i, (_, e) in enumerate(runs) if (e > 0) == c] for c in (False, True))
    dealt = lambda some: spots.withColumn("run", F.explode(F.array(*[F.lit(i) for i in some]).cast("array<int>")))
    cell = lambda a, b: F.concat_ws(":", F.col(a).cast("string"), F.col(b).cast("string"))
    alone = dealt(still).where(F.col("n") >= least).select("run", "x", "y", cell("x", "y").alias("cluster"))
    if not moving:
        return alone
    flat = stored(dealt(moving).withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)}))
    cells = flat.groupBy("run", "cx", "cy").agg(F.sum("n").alias("cell_n"))
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) != (0, 0)])

    def shift(d: DataFrame) -> DataFrame:
        return d.withColumn("o", F.explode(ring)).withColumns({"tx": F.col("cx") + F.col("o.i"), "ty": F.col("cy") + F.col("o.j")}).drop("o")

    sized = flat.join(cells, ["run", "cx", "cy"])
    full = sized.where(F.col("cell_n") >= least)
    thin = sized.where(F.col("cell_n") < least)  # fewer than min_samples coordinates per cell
    other = flat.select("run", F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    gap = F.sqrt(dx * dx + dy * dy) <= eps  # eps may be such a distance
    near = shift(thin).join(other, ["run", "tx", "ty"]).where(gap).groupBy("run", "x", "y").agg(F.sum("n2").alias("near"))
    counted = thin.join(near, ["run", "x", "y"], "left").withColumn("total", F.col("cell_n") + F.coalesce("near", F.lit(0)))
    core = full.select("run", "x", "y", "cx", "cy").unionByName(counted.where(F.col("total") >= least).select("run", "x", "y", "cx", "cy"))
    core = stored(core)
    boxes = core.groupBy("run", "cx", "cy").agg(F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by"))
    right = boxes.select("run", F.col("cx").alias("tx"), F.col("cy").alias("ty"), *[F.col(c).alias(f"{c}2") for c in ("ax", "bx", "ay", "by")])
    later = (F.col("tx") > F.col("cx")) | ((F.col("tx") == F.col("cx")) & (F.col("ty") > F.col("cy")))
    both = shift(boxes).where(later).join(right, ["run", "tx", "ty"])
    lo = [F.greatest(F.col("ax2") - F.col("bx"), F.col("ax") - F.col("bx2"), F.lit(0.0)),
          F.greatest(F.col("ay2") - F.col("by"), F.col("ay") - F.col("by2"), F.lit(0.0))]
    hi = [F.greatest(F.col("bx2") - F.col("ax"), F.col("bx") - F.col("ax2")), F.greatest(F.col("by2") - F.col("ay"), F.col("by") - F.col("ay2"))]
    both = both.withColumns({"least": lo[0] * lo[0] + lo[1] * lo[1], "most": hi[0] * hi[0] + hi[1] * hi[1]})
    ends = ["run", "cx", "cy", "tx", "ty"]
    both = stored(both.where(F.sqrt("least") <= eps).select(*ends, (F.sqrt("most") <= eps).alias("sure")))
    proven = _linked_cells(both.where("not sure").select(*ends), core, side, eps)
    node = lambda a, b: F.struct("run", cell(a, b).alias("cell"))
    edges = both.where("sure").select(*ends).unionByName(proven).select(node("cx", "cy").alias("a"), node("tx", "ty").alias("b"))
    labels = connected_components(boxes.select(node("cx", "cy").alias("node")), edges)
    owned = core.withColumn("node", node("cx", "cy")).join(labels, "node").select("run", "x", "y", "cx", "cy", F.col("component.cell").alias("cluster"))
    owned = stored(owned)
    border = (
        flat.select("run", "x", "y", "cx", "cy").join(core.select("run", "x", "y"), ["run", "x", "y"], "left_anti")
    )
    reach = shift(border).unionByName(border.withColumns({"tx": F.col("cx"), "ty": F.col("cy")}))
    goal = owned.select("run", F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cluster")
    touched = reach.join(goal, ["run", "tx", "ty"]).where(gap).groupBy("run", "x", "y").agg(F.min("cluster").alias("cluster"))
    return owned.select("run", "x", "y", "cluster").unionByName(touched).unionByName(alone)


def _linked_cells(pairs: DataFrame, core: DataFrame, side: Column, eps: Column, split: int = 8) -> DataFrame:
    """Pairs of cells with at least one pair of core points within eps.

    Each cell is cut into parts. Two parts that lie wholly within eps prove the link, as dense cells nearly
    always do; points are compared only in parts that straddle eps, and only for pairs without such a proof.
    """
    cells = ["run", "cx", "cy", "tx", "ty"]
    placed = core.withColumns({"sx": F.floor(F.col("x") * split / side), "sy": F.floor(F.col("y") * split / side)})
    left = placed.groupBy("run", "cx", "cy", "sx", "sy").agg(
        F.min("x").alias("ax"), F.max("x").alias("bx"), F.min("y").alias("ay"), F.max("y").alias("by"))
    turned = {"cx": "tx", "cy": "ty", "sx": "ux", "sy": "uy"}
    right = left.withColumnsRenamed({**turned, **{c: f"{c}2" for c in ("ax", "bx", "ay", "by")}})
    dx = F.greatest(F.col("ax2") - F.col("bx"), F.col("ax") - F.col("bx2"), F.lit(0.0))
    dy = F.greatest(F.col("ay2") - F.col("by"), F.col("ay") - F.col("by2"), F.lit(0.0))
    wx = F.greatest(F.col("bx2") - F.col("ax"), F.col("bx") - F.col("ax2"))
    wy = F.greatest(F.col("by2") - F.col("ay"), F.col("by") - F.col("ay2"))
    near = pairs.join(left, ["run", "cx", "cy"]).join(right, ["run", "tx", "ty"]).withColumn("whole", F.sqrt(wx * wx + wy * wy) <= eps)
    near = stored(near.where(F.sqrt(dx * dx + dy * dy) <= eps).select(*cells, "sx", "sy", "ux", "uy", "whole"))
    sure = near.where("whole").select(*cells).distinct()
    rest = near.where(~F.col("whole")).join(sure, cells, "left_anti")
    goal = placed.withColumnsRenamed({**turned, "x": "x2", "y": "y2"})
    gx, gy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    close = F.sqrt(gx * gx + gy * gy) <= eps
    met = rest.join(placed, ["run", "cx", "cy", "sx", "sy"]).join(goal, ["run", "tx", "ty", "ux", "uy"]).where(close).select(*cells).distinct()
    return sure.unionByName(met)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node name of each component: a class of nodes follows the smallest class that one of its members touches, then
    the class of that class, until nothing changes. Each round is written: a checkpoint keeps the size that was estimated for it,
    a product over all joins so far, a number with four times the digits every round."""
    links = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = stored(nodes.select("node", F.col("node").alias("component")))
    while True:
        seen = links.join(state.withColumnsRenamed({"node": "b", "component": "c"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = state.join(seen, "node", "left").select(F.col("component").alias("old"), F.least("component", "c").alias("c"))
        led = stored(step.groupBy("old").agg(F.min("c").alias("c")))
        jump = led.select(F.col("old").alias("c"), F.col("c").alias("c2"))
        led = stored(led.where("old != c").join(jump, "c").select("old", F.least("c", "c2").alias("new")))
        if led.isEmpty():
            return state
        state = stored(state.join(led.withColumnRenamed("old", "component"), "component", "left").select("node", F.coalesce("new", "component").alias("component")))


def density_grid(df: DataFrame, key: str, x: str, y: str, min_samples: Sequence[int], eps_list: Sequence[float] | None = None) -> DataFrame:
    """Clusters and noise share for every (eps, min_samples); eps from the k-distances of each ``min_samples`` if not given."""
    far = [eps_list] * len(min_samples) if eps_list is not None else _distances(df, x, y, min_samples, EPS_SHARES)
    runs = [(m, float(e)) for m, some in zip(min_samples, far) for e in some if e is not None]
    total, got = df.count(), {}
    if runs:
        spots = _coordinates(df, x, y)
        found = _density_runs(spots, runs).join(spots, ["x", "y"])
        got = {r[0]: r[1:] for r in found.groupBy("run").agg(F.count_distinct("cluster"), F.sum("n")).collect()}
    rows = [(m, e, *(got.get(i) or (0, 0))) for i, (m, e) in enumerate(runs)]
    rows = [(m, e, int(n), (total - held) / total if total else None) for m, e, n, held in rows]
    return df.sparkSession.createDataFrame(rows, "min_samples int, eps double, n_clusters int, noise_share double")
