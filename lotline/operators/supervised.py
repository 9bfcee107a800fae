"""Leakage-safe supervised models: group folds, out-of-fold scores, thresholds, importance, counterfactuals."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotline.operators.ordinals import ordinal_rank, value_positions, with_bucket
from lotline.operators.ranked import hash_share
from lotline.runtime import cut, scalar, stored

#: Rows times trees of the forests that are grown at the same time, one at least: each keeps a count and a node for every row and tree.
GROWN = 400_000_000


def group_folds(df: DataFrame, group: str, label: str, k: int = 5, tie: str | None = None) -> DataFrame:
    """Rows with a 0-based ``fold``; a group is in one fold only. Groups are dealt out in a snake by their
    number of positives, so the folds get near-equal positives (stratified group folds)."""
    groups = df.groupBy(group).agg(F.sum(F.col(label).cast("long")).alias("_p"))
    groups = groups.withColumn("_t", F.col(tie or group).cast("double") if tie or df.schema[group].dataType.simpleString() in
                               ("int", "bigint", "double") else F.xxhash64(group))
    placed = ordinal_rank(groups, "_p", "_t", "_r", descending=True, then=[group])
    at = (F.col("_r") - 1) % (2 * k)
    fold = F.when(at < k, at).otherwise(2 * k - 1 - at).cast("int")
    return df.join(placed.select(group, fold.alias("fold")), group)


def encoder(num: Sequence[str], cat: Sequence[str], onehot: bool = False) -> list:
    """Stages from raw columns to ``features``; unseen categories get their own index, text is never ordered."""
    stages = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="alphabetAsc") for c in cat]
    inputs = [f"{c}__i" for c in cat]
    if onehot and cat:
        stages.append(OneHotEncoder(inputCols=inputs, outputCols=[f"{c}__v" for c in cat], dropLast=True))
        inputs = [f"{c}__v" for c in cat]
    return [*stages, VectorAssembler(inputCols=[*num, *inputs], outputCol="features", handleInvalid="keep")]


def balanced(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """n / (2 * n_class) per row."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    n, p = row["n"], row["p"] or 0
    one, zero = n / (2 * max(p, 1)), n / (2 * max(n - p, 1))
    return df.withColumn(name, F.when(F.col(label) == 1, F.lit(one)).otherwise(F.lit(zero)))


def fold_grams(df: DataFrame, num: Sequence[str], y: str, cat: Sequence[str] = ()) -> dict[int, np.ndarray]:
    """For each fold the Gram matrix of (1, features, y), from one pass over the rows: tasks add up their own and send
    columns x columns numbers a fold. Train = total minus fold, so every model and penalty is fitted without reading the rows again."""
    packed = Pipeline(stages=encoder(num, cat, onehot=True)).fit(df).transform(df.where(F.col(y).isNotNull()))
    rows = packed.select("fold", vector_to_array("features").alias("x"), F.col(y).cast("double").alias("y"))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: dict[int, np.ndarray] = {}
        for batch in batches:
            fold, y_ = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            full = np.column_stack([np.ones(len(x)), x, y_])
            full = full[np.isfinite(full).all(axis=1)]
            fold = fold[np.isfinite(x).all(axis=1) & np.isfinite(y_)]
            for f in np.unique(fold).tolist():
                own = full[fold == f]
                grams[f] = grams.get(f, 0) + own.T @ own
        flat = [(f, i, float(v)) for f, g in grams.items() for i, v in enumerate(g.ravel())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat) if flat else [[]] * 3, (pa.int32(), pa.int32(), pa.float64()))], ["fold", "i", "v"])

    sums = rows.mapInArrow(part, "fold int, i int, v double").groupBy("fold", "i").agg(F.sum("v").alias("v")).collect()
    cells: dict[int, dict[int, float]] = {}
    for r in sums:
        cells.setdefault(r.fold, {})[r.i] = r.v
    side = math.isqrt(len(next(iter(cells.values())))) if cells else 0
    return {f: np.array([v[i] for i in range(side * side)]).reshape(side, side) for f, v in sorted(cells.items())}


def solve_gram(gram: np.ndarray, model: str, alpha: float, sweeps: int = 1000) -> np.ndarray:
    """Intercept and weights: ridge (squares + alpha |w|^2) in closed form, lasso (mean squares / 2 + alpha |w|) by coordinate descent on
    the centred matrix; the intercept is free. Columns without variance get no weight."""
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0]
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = centred[:-1, :-1], centred[:-1, -1]
    if model == "ridge":
        w = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy) if len(xx) else xy
    else:
        w = np.zeros(len(xx))
        flat = np.diag(xx) <= 1e-12 * n
        for _ in range(sweeps):
            before = w.copy()
            for j in range(len(w)):
                if not flat[j]:
                    rho = xy[j] - xx[j] @ w + xx[j, j] * w[j]
                    w[j] = math.copysign(max(abs(rho) - n * alpha, 0.0), rho) / xx[j, j]
            if np.abs(w - before).max(initial=0) <= 1e-12 * max(np.abs(w).max(initial=0), 1e-300):
                break
    return np.append(mean[-1] - mean[:-1] @ w, w)


def gram_r2(gram: np.ndarray, weights: np.ndarray) -> float:
    """R2 of fixed weights on the rows behind a Gram matrix."""
    wide = np.append(weights, -1.0)
    error, total = float(wide @ gram @ wide), float(gram[-1, -1] - gram[0, -1] ** 2 / gram[0, 0])
    return 1 - error / total if total > 0 else float("nan")


def cv_linear(df: DataFrame, num: Sequence[str], y: str, cat: Sequence[str] = (), ridge: float = 1.0, lasso: float = 0.01) -> DataFrame:
    """R2 per fold of ridge and lasso, both from one pass over the rows."""
    grams = fold_grams(df, num, y, cat)
    total = sum(grams.values())
    rows = [(model, fold, gram_r2(gram, solve_gram(total - gram, model, alpha))) for model, alpha in (("ridge", ridge), ("lasso", lasso)) for fold, gram in grams.items()]
    return df.sparkSession.createDataFrame(rows, "model string, fold int, r2 double")


def cv_forest(df: DataFrame, num: Sequence[str], y: str, cat: Sequence[str] = (), trees: int = 200, depth: int = 8, seed: int = 42) -> DataFrame:
    """R2 per fold of a forest, on rows dealt evenly to all cores: a level of the trees is a pass over all rows, whose slowest task
    all others wait for. Rows keep the nodes they have reached; of small tables several folds run at the same time."""
    spark = df.sparkSession
    dealt = stored(df.select("fold", y, *num, *cat).repartition(spark.sparkContext.defaultParallelism))

    def one(fold: int) -> tuple[str, int, float]:
        train, test = dealt.where(F.col("fold") != fold), dealt.where(F.col("fold") == fold)
        forest = RandomForestRegressor(labelCol=y, numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True)
        scored = Pipeline(stages=[*encoder(num, cat, onehot=True), forest]).fit(train).transform(test)
        return "forest", fold, float(RegressionEvaluator(labelCol=y, metricName="r2").evaluate(scored))

    folds = [r[0] for r in dealt.select("fold").distinct().orderBy("fold").collect()]
    at_once = max(1, min(len(folds), GROWN // max(1, dealt.count() * trees)))
    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), folds))
    return spark.createDataFrame(rows, "model string, fold int, r2 double")


def ordered_target_rate(
    df: DataFrame, key: str, category: str, y: str, name: str = "rate", weight: float = 1.0, seed: int = 42, part_rows: int = 100_000,
) -> DataFrame:
    """Mean target of the rows of the same category that come before a row in a hash permutation of ``key``, drawn to the overall mean by
    ``weight`` rows: a category as a number that no row's own target leaks into. Null is a category of its own.

    The permutation is cut into equal parts by hash; sums of earlier parts come from counts per (category, part), so a category
    with a third of all rows is many windows.
    """
    most = df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // part_rows))
    u = hash_share([key], seed)
    placed = df.withColumns({"__u": u, "__p": F.floor(u * parts).cast("int"), "__c": F.coalesce(F.concat(F.lit("="), F.col(category).cast("string")), F.lit(""))})
    known, value = F.col(y).isNotNull().cast("long"), F.coalesce(F.col(y).cast("double"), F.lit(0.0))
    cells = placed.groupBy("__c", "__p").agg(F.sum(value).alias("__s"), F.sum(known).alias("__n"))
    ahead = W.partitionBy("__c").orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("__c", "__p", F.coalesce(F.sum("__s").over(ahead), F.lit(0.0)).alias("__s0"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__n0"))
    before = W.partitionBy("__c", "__p").orderBy("__u", key).rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumns({"__s1": F.coalesce(F.sum(value).over(before), F.lit(0.0)), "__n1": F.coalesce(F.sum(known).over(before), F.lit(0))})
    mean = scalar(df, F.avg(F.col(y).cast("double")))
    met = own.join(cells, ["__c", "__p"])
    return met.select(*df.columns, ((F.col("__s0") + F.col("__s1") + weight * mean) / (F.col("__n0") + F.col("__n1") + weight)).alias(name))


def fold_target_rate(df: DataFrame, fold: int, key: str, category: str, y: str, name: str, weight: float = 1.0, seed: int = 42) -> DataFrame:
    """The same as a per-fold feature: training rows see the rows before them, rows of ``fold`` all training rows."""
    train, test = df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)
    mean = scalar(train, F.avg(F.col(y).cast("double")))
    whole = train.groupBy(F.col(category).alias("__c")).agg(F.sum(F.col(y).cast("double")).alias("__s"), F.count(y).alias("__n"))
    met = test.join(whole, F.col(category).eqNullSafe(F.col("__c")), "left")
    rate = (F.coalesce("__s", F.lit(0.0)) + weight * mean) / (F.coalesce("__n", F.lit(0)) + weight)
    return ordered_target_rate(train, key, category, y, name, weight, seed).unionByName(met.select(*df.columns, rate.alias(name)))


def classifier(kind: str, y: str, n: int, seed: int = 42, **params):
    if kind == "logistic":
        return LogisticRegression(labelCol=y, weightCol="weight", regParam=1.0 / max(n, 1), maxIter=params.get("iterations", 100))
    return GBTClassifier(labelCol=y, weightCol="weight", maxIter=params.get("iterations", 800), maxDepth=params.get("depth", 6),
                         stepSize=params.get("rate", 0.08), maxBins=params.get("bins", 64), seed=seed)


def fit_classifier(df: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, kind: str = "boosted", **params) -> PipelineModel:
    """One model on all given rows with balanced class weights."""
    train = balanced(df.withColumn(y, F.col(y).cast("double")), y)
    stages = [*encoder(num, cat, onehot=kind == "logistic"), classifier(kind, y, df.count(), **params)]
    return Pipeline(stages=stages).fit(train)


def score(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Probability of the positive class."""
    return model.transform(df).withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def out_of_fold(df: DataFrame, num: Sequence[str], cat: Sequence[str], y: str, kind: str = "boosted",
                per_fold: Callable[[DataFrame, int], DataFrame] | None = None, **params) -> DataFrame:
    """Every row scored by a model that never saw its group. ``per_fold`` adds columns that must be
    computed for each fold (J9)."""
    parts = []
    for fold in [r[0] for r in df.select("fold").distinct().orderBy("fold").collect()]:
        data = per_fold(df, fold) if per_fold else df
        model = fit_classifier(data.where(F.col("fold") != fold), num, cat, y, kind, **params)
        parts.append(score(model, data.where(F.col("fold") == fold)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stored(out)


def roc_auc(df: DataFrame, y: str, score_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the rank formula (ties count half)."""
    cells = df.groupBy(*by, score_col).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(y).cast("long")).alias("p"))
    ranks = value_positions(cells, score_col, by, count="c").select(*by, score_col, "avg_rank")
    pos, n = F.sum("p").cast("double"), F.sum("c").cast("double")
    auc = (F.sum(F.col("p") * F.col("avg_rank")) - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0.0))
    return cells.join(ranks, [*by, score_col]).groupBy(*by).agg(auc.alias("roc_auc"))


def average_precision(df: DataFrame, y: str, score_col: str) -> DataFrame:
    """Step-wise average precision: recall gain times precision at every distinct score."""
    cells = df.groupBy(score_col).agg(F.count(F.lit(1)).alias("c"), F.sum(F.col(y).cast("long")).alias("p"))
    everyone = value_positions(cells, score_col, count="c").select(score_col, (F.col("smaller")).alias("less"))
    positives = value_positions(cells, score_col, count="p").select(score_col, F.col("smaller").alias("less_p"))
    n, pos = scalar(cells, F.sum("c")), scalar(cells, F.sum("p"))
    joined = cells.join(everyone, score_col).join(positives, score_col)
    precision = (pos - F.col("less_p")) / (n - F.col("less"))
    return joined.agg(F.sum(F.col("p") / pos * precision).alias("average_precision"))


def fold_metrics(df: DataFrame, y: str, score_col: str) -> DataFrame:
    """Size, positive share and AUC per fold."""
    base = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate"))
    return base.join(roc_auc(df, y, score_col, ["fold"]), "fold", "left")


def threshold_scan(df: DataFrame, y: str, score_col: str, grid: Sequence[float] | None = None) -> DataFrame:
    """Confusion counts and rates at every threshold from one histogram of the scores."""
    grid = sorted(float(t) for t in (grid or [round(0.05 + 0.01 * i, 2) for i in range(91)]))
    scored = df.where(F.col(score_col).isNotNull()).withColumn("__s", F.col(score_col).cast("double"))
    hist = with_bucket(scored, "__s", grid, "k").groupBy("k").agg(
        F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) == 0).cast("long")).alias("q"))
    # at most len(grid) + 1 entries; bucket k holds the scores that reach exactly k thresholds
    one = hist.agg(F.collect_list(F.struct("k", "p", "q")).alias("h"))
    spread = one.select("h", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "threshold"))

    def total(field: str, above: bool):
        hit = (lambda x: x["k"] > F.col("i")) if above else (lambda x: x["k"] <= F.col("i"))
        return F.aggregate(F.filter("h", hit), F.lit(0).cast("long"), lambda acc, x: acc + x[field])

    table = spread.select("threshold", total("p", True).alias("tp"), total("q", True).alias("fp"),
                          total("q", False).alias("tn"), total("p", False).alias("fn"))

    def share(a: str, b: str):
        return F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))

    def f_beta(b: float):
        p, r = F.col("precision"), F.col("recall")
        return F.coalesce(F.when((p > 0) & (r > 0), (1 + b * b) * p * r / (b * b * p + r)), F.lit(0.0))

    out = table.withColumns({
        "precision": share("tp", "fp"), "recall": share("tp", "fn"), "specificity": share("tn", "fp"), "npv": share("tn", "fn")})
    return out.withColumns({
        "f1": f_beta(1), "f2": f_beta(2), "f05": f_beta(0.5), "youden": F.col("recall") + F.col("specificity") - 1,
        "n_flagged": F.col("tp") + F.col("fp")})


def threshold_picks(scan: DataFrame) -> DataFrame:
    """The thresholds with the best F1, Youden, F2 and F0.5 (ties: the smallest threshold)."""
    goals = {"best f1": "f1", "balanced": "youden", "recall first": "f2", "precision first": "f05"}
    parts = []
    for purpose, col in goals.items():
        best = scan.agg(F.max(F.struct(F.col(col).alias("v"), (-F.col("threshold")).alias("t"))).alias("b"))
        parts.append(best.select(F.lit(purpose).alias("purpose"), (-F.col("b.t")).alias("threshold"), F.col("b.v").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def permutation_importance(
    model: PipelineModel, df: DataFrame, key: str, y: str, groups: dict[str, Sequence[str]], repeats: int = 3, seed: int = 42,
) -> DataFrame:
    """Mean AUC drop when the columns of a group are shuffled together, its deviation and its share of all
    positive drops.

    Rows are numbered once in a hash order; a shuffle is then the map i -> (a * i + b) mod n with a prime to n,
    so each is one equi join and no sort.
    """
    n = df.count()
    placed = cut(ordinal_rank(df.withColumn("_h", hash_share([key], seed)), "_h", key, "_i").drop("_h"))
    base = roc_auc(score(model, placed), y, "score").first()[0]
    rows = []
    for g, (name, cols) in enumerate(groups.items()):
        drops = []
        for r in range(repeats):
            a = (2 * (seed + 7919 * (g * repeats + r)) + n // 3) % n or 1
            while math.gcd(a, n) != 1:
                a += 1
            other = placed.select(((F.lit(a) * F.col("_i") + F.lit(seed + r)) % n).alias("_j"), *[F.col(c).alias(f"_{c}") for c in cols])
            shuffled = placed.withColumn("_j", F.col("_i") % n).join(other, "_j").withColumns(
                {c: F.col(f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])
            drops.append(base - roc_auc(score(model, shuffled), y, "score").first()[0])
        mean = sum(drops) / len(drops)
        rows.append((name, mean, math.sqrt(sum((d - mean) ** 2 for d in drops) / max(len(drops) - 1, 1))))
    total = sum(max(m, 0) for _, m, _ in rows)
    rows = [(v, m, s, max(m, 0) / total * 100 if total else 0.0) for v, m, s in rows]
    return df.sparkSession.createDataFrame(rows, "variable string, auc_drop double, auc_drop_std double, importance_pct double")


def oof_target_rate(shares: DataFrame, rows: DataFrame, key: str, category: str, share: str, y: str, name: str = "expected") -> DataFrame:
    """Share-weighted mean target per category computed without the own fold, mixed by the shares of the row.

    Statistics of the other folds = total minus own fold, so one aggregation per (category, fold) is enough.
    """
    joined = shares.select(key, category, share).join(rows.select(key, "fold", y), key)
    cell = joined.groupBy(category, "fold").agg(F.sum(F.col(share) * F.col(y)).alias("s"), F.sum(share).alias("w"))
    total = cell.groupBy(category).agg(F.sum("s").alias("ts"), F.sum("w").alias("tw"))
    folds = rows.select("fold").distinct()
    pairs = total.select(category, "ts", "tw", F.explode(folds.agg(F.collect_set("fold")).scalar()).alias("fold"))
    rates = pairs.join(cell, [category, "fold"], "left").select(
        category, "fold",
        ((F.col("ts") - F.coalesce("s", F.lit(0.0))) / F.greatest(F.col("tw") - F.coalesce("w", F.lit(0.0)), F.lit(1e-9))).alias("rate"))
    mixed = joined.join(rates, [category, "fold"]).groupBy(key).agg(F.sum(F.col(share) * F.col("rate")).alias(name))
    return rows.join(mixed, key, "left")


def nested_sets(df: DataFrame, sets: Sequence[tuple[str, Sequence[str], Sequence[str]]], y: str, kind: str = "boosted", **params) -> DataFrame:
    """AUC of growing feature sets (name, numeric, categorical) on the same folds, with the gain of each step."""
    rows, before = [], None
    for name, num, cat in sets:
        scored = out_of_fold(df, num, cat, y, kind, **params)
        auc = roc_auc(scored, y, "score").first()[0]
        ap = average_precision(scored, y, "score").first()[0]
        rows.append((name, len(num) + len(cat), auc, ap, None if before is None else auc - before))
        before = auc
    return df.sparkSession.createDataFrame(rows, "feature_set string, n_features int, roc_auc double, pr_auc double, gain double")


def counterfactual_mean(
    model: PipelineModel, df: DataFrame, col: str, y: str, values: Sequence = (0, 1), by: str | None = None,
    min_n: int = 1000, min_hits: int = 100,
) -> DataFrame:
    """Mean prediction with a column set to each value, overall and per group, beside the raw difference.
    Groups with too few rows or too few rows of the second value are left out."""
    keyed = df.withColumn("_g", F.explode(F.array(F.lit("all"), F.col(by)) if by else F.array(F.lit("all"))))
    low, high = values
    out = keyed.groupBy("_g").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(col) == high).alias("n_hits"),
        F.avg(F.when(F.col(col) == low, F.col(y))).alias("raw_low"), F.avg(F.when(F.col(col) == high, F.col(y))).alias("raw_high"),
    ).where((F.col("n") >= min_n) & (F.col("n_hits") >= min_hits))
    for name, v in (("low", low), ("high", high)):
        kind = df.schema[col].dataType
        set_to = keyed.withColumn(col, F.lit(v).cast(kind))
        means = score(model, set_to).groupBy("_g").agg(F.avg("score").alias(f"adjusted_{name}"))
        out = out.join(means, "_g")
    return out.withColumnRenamed("_g", "segment").withColumns({
        "raw_diff": F.col("raw_high") - F.col("raw_low"), "adjusted_diff": F.col("adjusted_high") - F.col("adjusted_low")})


def compare_encodings(df: DataFrame, label_col: str, raw_cols: Sequence[str], y_num: str, y_bin: str, trees: int = 200) -> DataFrame:
    """One-hot cluster label against the raw features behind it: R2 of three regressors and AUC of a logistic
    model, mean and deviation over the folds. The label itself is never part of the raw features."""
    parts = []
    labelled = df.withColumn("_label", F.col(label_col).cast("string"))
    for name, num, cat in (("cluster", [], ["_label"]), ("raw", [c for c in raw_cols if c != label_col], [])):
        r2 = cv_linear(labelled, num, y_num, cat).union(cv_forest(labelled, num, y_num, cat, trees))
        parts.append(r2.groupBy("model").agg(F.avg("r2").alias("mean"), F.stddev_pop("r2").alias("std")).select(
            F.lit(name).alias("features"), "model", F.lit("r2").alias("metric"), "mean", "std"))
        scored = out_of_fold(labelled, num, cat, y_bin, "logistic")
        parts.append(fold_metrics(scored, y_bin, "score").agg(
            F.lit(name).alias("features"), F.lit("logistic").alias("model"), F.lit("auc").alias("metric"),
            F.avg("roc_auc").alias("mean"), F.stddev_pop("roc_auc").alias("std")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grade_lift(df: DataFrame, grade: str, label: str) -> DataFrame:
    """Size, true rate and lift per grade."""
    base = scalar(df, F.avg(F.col(label).cast("double")))
    return df.groupBy(grade).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("rate")).withColumn(
        "lift", F.col("rate") / base)
