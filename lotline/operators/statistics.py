"""Tests and effect sizes as aggregations; ranks come from value counts, never from a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotline.functions.special import chi_square_tail, f_tail
from lotline.operators.ordinals import exact_quantiles, value_positions
from lotline.runtime import pinned, scalar


def chi_square_v(df: DataFrame, a: str, b: str, yates: bool = True) -> DataFrame:
    """H1: chi-square of independence, its p-value and Cramer's V from the contingency counts.

    The continuity correction is applied only for one degree of freedom. Cells without rows still
    count through the margins: their expected value is the sum over all margins minus the seen cells.
    """
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("o"))
    rows = cells.groupBy(a).agg(F.sum("o").alias("r"))
    cols = cells.groupBy(b).agg(F.sum("o").alias("c"))
    total = scalar(cells, F.sum("o"))
    n_rows, n_cols = scalar(rows, F.count(F.lit(1))), scalar(cols, F.count(F.lit(1)))
    e = F.col("r") * F.col("c") / total
    dof1 = (n_rows - 1) * (n_cols - 1) == 1
    shift = F.when(F.lit(yates) & dof1, F.least(F.lit(0.5), F.abs(F.col("o") - e))).otherwise(0.0)
    off = F.abs(F.col("o") - e) - shift
    # an unseen cell adds (0 - e)^2 / e = e. In a 2 x 2 table all |o - e| are equal, so the corrected
    # part of an unseen cell follows from the seen ones.
    d = F.max(F.abs(F.col("o") - e))
    corrected = (F.lit(4) - F.count(F.lit(1))) * F.pow(d - F.least(F.lit(0.5), d), 2) / F.nullif(d, F.lit(0.0))
    unseen = F.when(F.lit(yates) & dof1, F.coalesce(corrected, F.lit(0.0))).otherwise(total - F.sum(e))
    seen = cells.join(rows, a).join(cols, b)
    out = seen.agg((F.sum(off * off / e) + unseen).alias("chi2"), F.sum("o").alias("n"))
    dof = (n_rows - 1) * (n_cols - 1)
    lesser = F.least(n_rows, n_cols) - 1
    return out.select(
        "chi2", dof.alias("dof"), F.col("n").cast("long").alias("n"),
        F.sqrt(F.col("chi2") / (F.col("n") * F.nullif(lesser, F.lit(0)))).alias("cramers_v"),
    ).withColumn("p_value", chi_square_tail(F.col("chi2"), F.col("dof")))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """H2: Kruskal-Wallis H with tie correction, its p-value and epsilon squared (H - k + 1) / (n - k)."""
    return kruskal_by(df.withColumn("__all", F.lit(0)), "__all", group, value).drop("__all")


def kruskal_by(df: DataFrame, by: str, group: str, value: str) -> DataFrame:
    """The same for every ``by`` at once (the features of a stacked table): one set of ranks over (by, value)."""
    known = df.where(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    cells = known.groupBy(by, group, value).agg(F.count(F.lit(1)).alias("c"))
    ranks = value_positions(cells, value, [by], count="c").select(by, value, "avg_rank", F.col("n").alias("t"))
    ties = ranks.groupBy(by).agg(F.sum(F.col("t").cast("double") * (F.col("t").cast("double") * F.col("t") - 1)).alias("ties"))
    groups = cells.join(ranks, [by, value]).groupBy(by, group).agg(
        F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * F.col("avg_rank")).alias("r")
    )
    one = groups.groupBy(by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    n = F.col("n")
    plain = F.try_divide(F.lit(12.0), n * (n + 1)) * F.col("s") - 3 * (n + 1)
    h = F.try_divide(plain, 1 - F.try_divide(F.col("ties"), n * n * n - n))
    return one.join(ties, by).select(by, h.alias("h"), F.col("k"), n.cast("long").alias("n")).withColumn(
        "epsilon2", F.try_divide(F.col("h") - F.col("k") + 1, F.col("n") - F.col("k"))
    ).withColumn("p_value", chi_square_tail(F.col("h"), F.col("k") - 1))


def anova_eta(df: DataFrame, group: str, value: str) -> DataFrame:
    """H3: one-way F, its p-value, eta squared and the share of variance within groups, from n, mean and variance per group."""
    known = df.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    per = known.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")
    )
    grand = scalar(per, F.sum(F.col("n") * F.col("m")) / F.sum("n"))
    one = per.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col("m") - grand, 2)).alias("between"),
    )
    return one.select(
        F.try_divide(F.try_divide("between", F.col("k") - 1), F.try_divide("within", F.col("n") - F.col("k"))).alias("f"),
        F.try_divide("between", F.col("between") + F.col("within")).alias("eta2"),
        F.try_divide("within", F.col("between") + F.col("within")).alias("within_share"),
        F.col("n").cast("long").alias("n"), "k",
    ).withColumn("p_value", f_tail(F.col("f"), F.col("k") - 1, F.col("n") - F.col("k")))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """H4 for one pair: correlation of average ranks over rows where both are known."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).cast("double").alias("x_"), F.col(y).cast("double").alias("y_")
    )
    cells = known.groupBy("x_", "y_").agg(F.count(F.lit(1)).alias("c"))
    ra = value_positions(cells, "x_", count="c").select("x_", F.col("avg_rank").alias("ra"))
    rb = value_positions(cells, "y_", count="c").select("y_", F.col("avg_rank").alias("rb"))
    c, a, b = F.col("c"), F.col("ra"), F.col("rb")
    ranked = cells.join(ra, "x_").join(rb, "y_")
    middle = (scalar(cells, F.sum("c")) + 1) / 2.0  # the mean of average ranks, exactly
    return ranked.agg(
        F.sum(c).alias("n"),
        (F.sum(c * (a - middle) * (b - middle))
         / F.sqrt(F.sum(c * (a - middle) * (a - middle)) * F.sum(c * (b - middle) * (b - middle)))).alias("rho"),
    )


def spearman_table(df: DataFrame, cols: Sequence[str], target: str, min_n: int = 10) -> DataFrame:
    """H4: rho of every feature with the target, strongest first; features with too few pairs are left out."""
    parts = [spearman(df, c, target).withColumn("feature", F.lit(c)) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("n") >= min_n).select("feature", "rho", "n").orderBy(F.abs("rho").desc())


def group_cv(df: DataFrame, key: str, value: str) -> DataFrame:
    """H5: variation coefficient in percent per group (groups with a positive mean)."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
        .where(F.col("mean") > 0).withColumn("cv_pct", F.col("std") / F.col("mean") * 100)
    )


def cv_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """H5: mean, median and size-weighted mean of the group coefficients, and the overall one."""
    per = group_cv(df, key, value)
    weighted = F.sum(F.when(F.col("cv_pct").isNotNull(), F.col("cv_pct") * F.col("n"))) / F.sum(
        F.when(F.col("cv_pct").isNotNull(), F.col("n")))
    overall = scalar(df, F.stddev_samp(value) / F.avg(value) * 100)
    middle = exact_quantiles(per, "cv_pct", {"m": 0.5})
    return per.agg(
        F.avg("cv_pct").alias("cv_mean"), weighted.alias("cv_weighted"), F.count(F.lit(1)).alias("n_groups")
    ).select("cv_mean", middle.scalar().alias("cv_median"), "cv_weighted", overall.alias("cv_overall"), "n_groups")


def survival_table(df: DataFrame, duration: str, event: str) -> DataFrame:
    """H6: deaths, rows at risk and S(t) at every observed duration.

    Durations are whole periods, so the table has at most as many rows as the grid has periods.
    """
    counts = pinned(df.where(F.col(duration).isNotNull()).groupBy(F.col(duration).alias("t")).agg(
        F.sum(F.col(event).cast("int")).alias("d"), F.count(F.lit(1)).alias("c")
    ))
    ahead = W.orderBy("t").rowsBetween(W.currentRow, W.unboundedFollowing)
    so_far = W.orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    risk = counts.withColumn("at_risk", F.sum("c").over(ahead))
    step = F.col("d") / F.col("at_risk")
    gone = F.max(F.when(step >= 1, 1).otherwise(0)).over(so_far)
    log_s = F.sum(F.when(step < 1, F.log1p(-step)).otherwise(0.0)).over(so_far)
    return risk.select("t", "d", "at_risk", F.when(gone == 1, F.lit(0.0)).otherwise(F.exp(log_s)).alias("survival"))


def kaplan_meier(df: DataFrame, duration: str, event: str, at: Sequence[int]) -> DataFrame:
    """H6: S(t) at chosen times: the last step at or before t, 1 before the first step."""
    steps = survival_table(df, duration, event)
    one = steps.agg(*[F.max_by("survival", F.when(F.col("t") <= t, F.col("t"))).alias(f"s{i}") for i, t in enumerate(at)])
    pairs = F.array(*[
        F.struct(F.lit(t).alias("at"), F.coalesce(f"s{i}", F.lit(1.0)).alias("survival")) for i, t in enumerate(at)
    ])
    return one.select(F.inline(pairs))


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """H7: Pearson correlation of every pair of columns, strongest first (rows without nulls)."""
    matrix = correlation_matrix(df, cols)
    rows = [(cols[i], cols[j], float(matrix[i][j])) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    out = df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    return out.orderBy(F.abs("r").desc(), "a", "b")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> list[list[float]]:
    """H7: the matrix itself (columns x columns numbers on the driver)."""
    packed = VectorAssembler(inputCols=list(cols), outputCol="_v", handleInvalid="skip").transform(df.select(*cols))
    return Correlation.corr(packed, "_v").first()[0].toArray().tolist()


def vif(corr: Sequence[Sequence[float]], cols: Sequence[str]) -> dict[str, float]:
    """H8: variance inflation = diagonal of the inverse correlation matrix (infinite when singular)."""
    import numpy as np

    m = np.array(corr, dtype=float)
    try:
        inverse = np.linalg.inv(m)
    except np.linalg.LinAlgError:
        return {c: float("inf") for c in cols}
    return {c: float(inverse[i, i]) for i, c in enumerate(cols)}


def share_below(df: DataFrame, value: str, limit: Column, name: str) -> DataFrame:
    """H6: naive share of rows below a limit (closed within so many quarters)."""
    return df.agg(F.avg((F.col(value) < limit).cast("double")).alias(name), F.count(F.lit(1)).alias("n"))
