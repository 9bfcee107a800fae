"""Variable screening for clustering: scans on Spark, the greedy removal on a small matrix on the driver."""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.operators.ordinals import quantile_values
from lotline.operators.statistics import correlation_matrix, vif


def outlier_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Largest |z| per column in one pass."""
    one = df.agg(*[
        F.greatest((F.max(c) - F.avg(c)) / F.nullif(F.stddev_samp(c), F.lit(0.0)),
                   (F.avg(c) - F.min(c)) / F.nullif(F.stddev_samp(c), F.lit(0.0))).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("max_abs_z")) for c in cols])
    return one.select(F.inline(pairs))


def winsorise(df: DataFrame, cols: Sequence[str], z: float = 8.0, low: float = 0.01, high: float = 0.99) -> tuple[DataFrame, list[tuple]]:
    """Clip columns whose largest |z| exceeds ``z`` to their exact low / high quantiles."""
    far = {r["column"]: r["max_abs_z"] for r in outlier_report(df, cols).collect() if (r["max_abs_z"] or 0) > z}
    log, changes = [], {}
    for c, worst in far.items():
        a, b = quantile_values(df, c, [low, high])
        changes[c] = F.when(F.col(c).isNotNull(), F.greatest(F.lit(a), F.least(F.lit(b), F.col(c))))
        log.append((c, "winsorised", f"max |z| {worst:.1f}, clipped to [{a:g}, {b:g}]"))
    return (df.withColumns(changes) if changes else df), log


def variation_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Deviation and share of the most frequent value per column; values are counted in long form."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]))).where(F.col("v").isNotNull())
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("column").agg((F.max("n") / F.sum("n")).alias("mode_share"))
    spread = long.groupBy("column").agg(F.stddev_samp("v").alias("std"))
    return top.join(spread, "column")


def screen_variables(
    df: DataFrame, cols: Sequence[str], *, compositions: dict[str, Sequence[str]] | None = None, keep: Sequence[str] = (),
    max_z: float = 8.0, max_mode: float = 0.95, max_corr: float = 0.8, max_vif: float = 10.0, log_suffix: str = "_log",
) -> tuple[DataFrame, list[str], list[tuple[str, str, str]]]:
    """H9: (winsorised frame, columns kept, action log).

    ``compositions`` maps the reference category of each share vector to its columns: the reference is
    dropped, the others stay and take no part in the later steps. Then: winsorise, drop low variance, drop
    one of each pair correlated above ``max_corr`` (forced columns stay, the log twin stays, otherwise the one
    with the higher mean correlation goes), drop the largest VIF above ``max_vif`` until none is left.
    """
    log: list[tuple[str, str, str]] = []
    shares: list[str] = []
    for reference, members in (compositions or {}).items():
        for c in members:
            log.append((c, "dropped", "reference category") if c == reference else (c, "kept", "share"))
            if c != reference:
                shares.append(c)
    members = {c for group in (compositions or {}).values() for c in group}
    work = [c for c in cols if c not in members]
    df, clipped = winsorise(df, work, max_z)
    log += clipped
    flat = {
        r["column"]: r for r in variation_report(df, work).collect()
        if r["column"] not in keep and (not r["std"] or r["mode_share"] > max_mode)
    }
    for c, r in flat.items():
        log.append((c, "removed", f"low variance: mode share {r['mode_share']:.3f}, std {r['std'] or 0:.4g}"))
    work = [c for c in work if c not in flat]
    matrix = correlation_matrix(df, work) if len(work) > 1 else [[1.0]]
    corr = {(a, b): matrix[i][j] for i, a in enumerate(work) for j, b in enumerate(work)}
    while len(work) > 1:
        a, b = max(itertools.combinations(work, 2), key=lambda p: abs(corr[p]))
        r = abs(corr[a, b])
        if not r > max_corr:
            break
        if a in keep or b in keep:
            gone, why = (b if a in keep else a), "correlated with a forced column"
        elif a.removesuffix(log_suffix) == b.removesuffix(log_suffix):
            gone, why = (b if a.endswith(log_suffix) else a), "log twin preferred"
        else:
            mean = {c: sum(abs(corr[c, o]) for o in work if o != c) for c in (a, b)}
            gone, why = (a if mean[a] >= mean[b] else b), "higher mean correlation"
        work.remove(gone)
        log.append((gone, "removed", f"|r| {r:.3f} with {b if gone == a else a}: {why}"))
    while len(work) > 1:
        factors = vif([[corr[a, b] for b in work] for a in work], work)
        open_ = {c: v for c, v in factors.items() if c not in keep}
        if not open_ or max(open_.values()) <= max_vif:
            break
        gone = max(open_, key=open_.get)
        work.remove(gone)
        log.append((gone, "removed", f"vif {open_[gone]:.2f}"))
    log += [(c, "final", "passed") for c in work]
    return df, [*work, *shares], log


def candidate_sets(
    cols: Sequence[str], categories: dict[str, Sequence[str]], sizes: Sequence[int] = (4, 5, 6), cap: int = 100, seed: int = 42,
    whole_small: bool = False,
) -> list[tuple[str, str, list[str]]]:
    """(set id, group, features) for every single category, pair and the union of all; combinations of the
    given sizes, at most ``cap`` sampled ones per group and size. The first keyword hit decides the category.
    ``whole_small`` adds a pool smaller than the smallest size as one set."""
    def category(name: str) -> str | None:
        return next((c for c, words in categories.items() if any(w in name for w in words)), None)

    pools = {c: [v for v in cols if category(v) == c] for c in categories}
    draw = random.Random(seed)
    out: list[tuple[str, str, list[str]]] = []
    for width in range(1, len(pools) + 1):
        for names in itertools.combinations(pools, width):
            pool = [v for n in names for v in pools[n]]
            if whole_small and 0 < len(pool) < min(sizes):
                out.append((f"S{len(out) + 1:04d}", "+".join(names), pool))
                continue
            for size in sizes:
                combos = list(itertools.combinations(pool, size))
                if len(combos) > cap:
                    combos = draw.sample(combos, cap)
                for combo in combos:
                    out.append((f"S{len(out) + 1:04d}", "+".join(names), list(combo)))
    return out
