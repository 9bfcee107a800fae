"""Group reports: statistics, shares, cross tabs, weighted means, compositions.

Aggregates that hold all distinct values of a group in one buffer (mode, median, sets) are built from
counts instead, because one group may own a third of all rows. ``bounded`` marks metrics whose number
of distinct values is limited by the period grid; only for those the exact built-in median is used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotline.operators.ordinals import exact_quantiles, quantile_values, weighted_quantile
from lotline.runtime import keyed_join, scalar


def _nulls_last(col: str, descending: bool = False) -> Column:
    return F.col(col).desc_nulls_last() if descending else F.col(col).asc_nulls_last()


def group_stats(
    df: DataFrame, keys: Sequence[str], specs: dict[str, tuple[str, str]], bounded: Sequence[str] = (),
) -> DataFrame:
    """Named aggregates ``{out: (column, how)}``; how is one of size, count, sum, mean, min, max, std,
    median, first (smallest row value is not implied; any value of a constant column), nunique, any, share."""
    makers = {
        "size": lambda c: F.count(F.lit(1)), "count": F.count, "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max,
        "std": F.stddev_samp, "first": F.any_value, "nunique": F.count_distinct, "any": F.bool_or,
        "share": lambda c: F.avg(F.col(c).cast("int")), "median": F.median,
    }
    far = {o: c for o, (c, how) in specs.items() if how == "median" and c not in bounded}
    plain = [makers[how](c).alias(o) for o, (c, how) in specs.items() if o not in far]
    out = df.groupBy(*keys).agg(*(plain or [F.count(F.lit(1)).alias("__n")]))
    for name, col in far.items():
        middle = exact_quantiles(df, col, {name: 0.5}, by=keys)
        out = keyed_join(out, middle, keys, "left") if keys else out.withColumn(name, middle.scalar())
    return out.select(*keys, *specs)


def conditional_share(df: DataFrame, keys: Sequence[str], value: str, condition: Column, name: str) -> DataFrame:
    """Number and share of rows that meet a condition, over the rows whose value is known."""
    known = F.col(value).isNotNull()
    return df.groupBy(*keys).agg(
        F.count_if(known).alias("n_known"),
        F.count_if(known & condition).alias(f"n_{name}"),
        F.try_divide(F.count_if(known & condition).cast("double"), F.count_if(known)).alias(f"share_{name}"),
    )


def group_mode(df: DataFrame, keys: Sequence[str], col: str, name: str | None = None) -> DataFrame:
    """D3: most frequent non-null value; ties go to the smallest value; null if there is none."""
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    rank = F.when(F.col(col).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v")))
    return counts.groupBy(*keys).agg(F.min(rank)["v"].alias(name or f"mode_{col}"))


def distinct_per_group(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """Rows and distinct values per group, with a flag for more than one value."""
    pairs = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy(*keys).agg(
        F.sum("_n").alias("n_rows"), F.count(col).alias("n_values"), (F.count(col) > 1).alias("varies")
    )


def varying_share(per_group: DataFrame) -> DataFrame:
    """Share of groups with more than one row / more than one value."""
    return per_group.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.avg((F.col("n_rows") > 1).cast("int")).alias("share_multi_row"),
        F.avg(F.col("varies").cast("int")).alias("share_varies"),
    )


def frequency(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Count and share per value (nulls are left out, as in a value count)."""
    known = df.where(F.col(col).isNotNull())
    counts = known.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    out = counts.withColumn("share", F.try_divide(F.col("n"), scalar(counts, F.sum("n"))))
    return out if top is None else out.orderBy(F.desc("n"), F.asc(col)).limit(top)


def cross_tab(
    df: DataFrame, row: str, col: str, values: Sequence, normalize: bool = False, margins: bool = False,
) -> DataFrame:
    """Counts per row value and listed column value; row-normalised, or with an "All" row and column.

    Listing the column values keeps the plan to one pass and the schema stable.
    """
    cells = [F.count_if(F.col(col) == F.lit(v)).alias(str(v)) for v in values]
    known = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    if margins:
        out = known.rollup(row).agg(*cells, F.count(F.lit(1)).alias("All"), F.grouping(row).alias("_g"))
        return out.withColumn(row, F.when(F.col("_g") == 1, "All").otherwise(F.col(row).cast("string"))).drop("_g")
    out = known.groupBy(row).agg(*cells, F.count(F.lit(1)).alias("All"))
    if not normalize:
        return out.drop("All")
    return out.select(row, *[(F.col(str(v)) / F.col("All")).alias(str(v)) for v in values])


def drilldown(df: DataFrame, hierarchy: Sequence[str], specs: dict[str, Column], fill: str = "unassigned") -> DataFrame:
    """The same metrics at every level of a hierarchy in one pass; unknown members are named, not lost.

    ``level`` is the number of hierarchy columns in force (0 = everything).
    """
    named = df.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in hierarchy})
    depth = sum((F.lit(1) - F.grouping(c).cast("int") for c in hierarchy), F.lit(0))
    return named.rollup(*hierarchy).agg(depth.alias("level"), *[c.alias(n) for n, c in specs.items()])


def group_rate(df: DataFrame, axis: str, flag: str) -> DataFrame:
    """Size, flagged rows, rate and deviation from the overall rate per value of an axis."""
    overall = scalar(df, F.avg(F.col(flag).cast("double")))
    return (
        df.groupBy(axis)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(flag).cast("int")).alias("n_flag"),
             F.avg(F.col(flag).cast("double")).alias("rate"))
        .withColumn("deviation", F.col("rate") - overall)
    )


def composition_shift(df: DataFrame, col: str, keep: str) -> DataFrame:
    """Share of each value before and after keeping only flagged rows, and the shift in points.

    A value that disappears has share 0 after.
    """
    known = df.where(F.col(col).isNotNull())
    counts = known.groupBy(col).agg(
        F.count(F.lit(1)).alias("n_all"), F.sum(F.col(keep).cast("int")).alias("n_kept")
    )
    total, kept = scalar(counts, F.sum("n_all")), scalar(counts, F.sum("n_kept"))
    return counts.select(
        col, (F.try_divide("n_all", total) * 100).alias("before_pct"), (F.try_divide("n_kept", kept) * 100).alias("after_pct"),
        (F.try_divide("n_kept", kept) * 100 - F.try_divide("n_all", total) * 100).alias("shift_pp"),
    )


def deviation_flags(rates: dict[str, tuple[DataFrame, str]], min_abs: float) -> DataFrame:
    """Stack rate tables (axis name -> (table, value column)) and keep deviations of at least ``min_abs``."""
    parts = [
        t.select(F.lit(axis).alias("axis"), F.col(c).cast("string").alias("value"), "n", "rate", "deviation")
        for axis, (t, c) in rates.items()
    ]
    return reduce(DataFrame.unionByName, parts).where(F.abs("deviation") >= min_abs)


def weighted_mean_expr(value: str, weight: str, skip_null_weight: bool = False) -> Column:
    """sum(v*w)/sum(w). A null value adds nothing above but keeps its weight below, unless told to skip."""
    below = F.when(F.col(value).isNotNull(), F.col(weight)) if skip_null_weight else F.col(weight)
    return F.coalesce(F.sum(F.col(value) * F.col(weight)), F.lit(0.0)) / F.nullif(F.sum(below), F.lit(0.0))


def weighted_mean(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str = "w_mean", skip_null_weight: bool = False,
) -> DataFrame:
    return df.groupBy(*keys).agg(weighted_mean_expr(value, weight, skip_null_weight).alias(name))


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str = "w_median") -> DataFrame:
    """Lower weighted median; null values and weights do not count."""
    return weighted_quantile(df, value, weight, name, by=keys, q=0.5)


def weighted_baseline(
    df: DataFrame, keys: Sequence[str], weight: str, flag: str, means: dict[str, str], medians: dict[str, str],
) -> DataFrame:
    """Weighted size, weighted flagged size and their ratio, weighted means and medians of one level."""
    out = df.groupBy(*keys).agg(
        F.sum(weight).alias("n_w"), F.sum(F.col(weight) * F.col(flag)).alias("n_flag_w"),
        *[weighted_mean_expr(v, weight).alias(n) for n, v in means.items()],
    ).withColumn("flag_ratio", F.col("n_flag_w") / F.col("n_w"))
    for name, value in medians.items():
        out = keyed_join(out, weighted_median(df, keys, value, weight, name), keys, "left")
    return out


def between_group_std(df: DataFrame, outer: Sequence[str], value: str, name: str = "between_std") -> DataFrame:
    """Standard deviation of a per-group statistic over the groups of one outer key."""
    return df.groupBy(*outer).agg(F.stddev_samp(value).alias(name))


def share_and_dominant(df: DataFrame, *, key: Sequence[str], category: str, measure: str) -> DataFrame:
    """Share of each category within its key and a flag on the largest (ties: smallest name).

    Expects one row per key and category; a key then has no more rows than there are categories.
    """
    whole = W.partitionBy(*key)
    return df.withColumn("share", F.try_divide(F.col(measure), F.sum(measure).over(whole))).withColumn(
        "is_dominant", F.row_number().over(whole.orderBy(F.desc(measure), F.asc(category))) == 1
    )


def top_categories_text(df: DataFrame, key: Sequence[str], category: str, n: int = 3, name: str = "top") -> DataFrame:
    """D16: "a(5), b(3), c(1)" of the n most frequent categories; ties by name."""
    counts = df.where(F.col(category).isNotNull()).groupBy(*key, category).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy(*key).orderBy(F.desc("_n"), F.asc(category))
    top = counts.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    piece = F.struct("_r", F.concat(F.col(category), F.lit("("), F.col("_n").cast("string"), F.lit(")")).alias("t"))
    return top.groupBy(*key).agg(F.array_sort(F.collect_list(piece)).alias("_p")).select(
        *key, F.array_join(F.transform("_p", lambda p: p["t"]), ", ").alias(name)
    )


def within_group_range(df: DataFrame, keys: Sequence[str], rate: str, name: str = "range") -> DataFrame:
    """Largest minus smallest rate of a group."""
    return df.groupBy(*keys).agg(
        F.count(rate).alias("n_members"), F.min(rate).alias("low"), F.max(rate).alias("high"),
        (F.max(rate) - F.min(rate)).alias(name),
    )


def two_stage_mean(df: DataFrame, keys: Sequence[str], time: str, sum_cols: Sequence[str]) -> DataFrame:
    """Sum over everything else per (key, time), then mean over the times. A sum of nulls only is 0."""
    per_time = df.groupBy(*keys, time).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sum_cols])
    return per_time.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in sum_cols])


def growth_and_cv(df: DataFrame, key: Sequence[str], time: str, value: str) -> DataFrame:
    """Last over first non-null value minus 1, and sample deviation over mean."""
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*key).agg(
        (F.max_by(value, time) / F.nullif(F.min_by(value, time), F.lit(0.0)) - 1).alias("growth"),
        (F.stddev_samp(value) / F.nullif(F.avg(value), F.lit(0.0))).alias("cv"),
    )


def composition_indices(df: DataFrame, key: Sequence[str], share: str, top: int = 3) -> DataFrame:
    """Entropy (natural log, zero shares ignored), HHI and sum of the ``top`` largest shares."""
    p = F.col(share)
    order = W.partitionBy(*key).orderBy(F.desc(share))
    big = (
        df.where(p.isNotNull()).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
        .groupBy(*key).agg(F.sum(share).alias(f"top{top}_share"))
    )
    base = df.groupBy(*key).agg(
        (-F.sum(F.when(p > 0, p * F.ln(p)))).alias("entropy"), F.sum(p * p).alias("hhi")
    )
    return keyed_join(base, big, key, "left")


def row_entropy(cols: Sequence[str]) -> Column:
    """D21 on a wide row: entropy of several share columns."""
    terms = F.array(*[F.when(F.col(c) > 0, -F.col(c) * F.ln(c)) for c in cols])
    return F.aggregate(F.filter(terms, lambda t: t.isNotNull()), F.lit(0.0), lambda a, t: a + t)


def pivot_fill(
    df: DataFrame, key: Sequence[str], category: str, value: str, values: Sequence[str], prefix: str = "", fill: float = 0.0,
) -> DataFrame:
    """Long to wide over listed categories; missing cells take ``fill``."""
    wide = df.groupBy(*key).agg(
        *[F.sum(F.when(F.col(category) == F.lit(v), F.col(value))).alias(f"{prefix}{v}") for v in values]
    )
    return wide.select(*key, *[F.coalesce(F.col(f"`{prefix}{v}`"), F.lit(fill)).alias(f"{prefix}{v}") for v in values])


def describe_exact(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max."""
    base = df.groupBy(*by).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"),
    )
    if by:
        quartiles = exact_quantiles(df, col, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by=by)
        return keyed_join(base, quartiles, by, "left")
    values = quantile_values(df, col, [0.25, 0.5, 0.75])
    return base.withColumns({q: F.lit(v).cast("double") for q, v in zip(("q25", "q50", "q75"), values)})


def set_overlap(df: DataFrame, flag_a: str, flag_b: str) -> DataFrame:
    """Sizes of both flags, of their intersection and union, and Jaccard (0 when the union is empty)."""
    a, b = F.coalesce(F.col(flag_a).cast("int"), F.lit(0)) == 1, F.coalesce(F.col(flag_b).cast("int"), F.lit(0)) == 1
    return df.agg(
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("n_both"),
        F.count_if(a | b).alias("n_any"),
        (F.count_if(a & b) / F.greatest(F.count_if(a | b), F.lit(1))).alias("jaccard"),
    )


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """D24 on key sets: distinct keys only in a, only in b, in both."""
    both = (
        a.select(key).distinct().withColumn("_a", F.lit(1))
        .join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    )
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"),
    )


def min_sample(df: DataFrame, n_col: str, n: int, flag: str | None = None) -> DataFrame:
    """Keep groups of at least n rows, or only mark them."""
    return df.where(F.col(n_col) >= n) if flag is None else df.withColumn(flag, F.col(n_col) >= n)


def coverage_rate(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of non-null values per column in one pass, as rows (column, n, n_known, rate)."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"k_{c}") for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"k_{c}").alias("n_known")) for c in cols])
    return one.select("n", F.explode(pairs).alias("p")).select(
        F.col("p.column"), "n", F.col("p.n_known"), F.try_divide(F.col("p.n_known").cast("double"), F.col("n")).alias("rate")
    )


def group_center_offset(df: DataFrame, good: Column, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Mean of the bad rows minus the mean of the good rows of the same group."""
    ok = F.coalesce(good, F.lit(False))
    aggs = [F.count_if(~ok).alias("n_bad")]
    for c in cols:
        aggs += [F.avg(F.when(~ok, F.col(c))).alias(f"_bad_{c}"), F.avg(F.when(ok, F.col(c))).alias(f"_good_{c}")]
    out = df.groupBy(*by).agg(*aggs).where(F.col("n_bad") > 0)
    return out.select(*by, "n_bad", *[(F.col(f"_bad_{c}") - F.col(f"_good_{c}")).alias(f"offset_{c}") for c in cols])
