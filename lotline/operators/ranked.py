"""Records by rank: latest, representative, top n, histories, samples, grades, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotline.functions.columns import cut_bins
from lotline.operators.episodes import detect_episodes, period_grid
from lotline.operators.ordinals import ordinal_rank, quantile_values
from lotline.runtime import keyed_join, scalar


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group. Spark limits each group before the shuffle, so a hot group is small."""
    placed = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return placed.where(F.col(rank) <= n)


def latest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The listed columns of the last record per key; the full order is the tie-break."""
    best = F.max(F.struct(*order, *[c for c in cols if c not in order]))
    return df.groupBy(*key).agg(best.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def earliest_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The same for the first record."""
    best = F.min(F.struct(*order, *[c for c in cols if c not in order]))
    return df.groupBy(*key).agg(best.alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def repair_representative(
    df: DataFrame, key: Sequence[str], order: str, cols: Sequence[str], valid: Column,
) -> DataFrame:
    """Latest valid value of the key, else null; with diagnostics (any valid, how many different)."""
    ok = F.coalesce(valid, F.lit(False))
    pick = F.struct(*[F.col(c) for c in cols])
    out = df.groupBy(*key).agg(
        F.max(F.when(ok, F.struct(F.col(order).alias("_o"), pick.alias("_v")))).alias("_best"),
        F.bool_or(ok).alias("any_valid"),
        (F.max(pick) != F.min(pick)).alias("varies"),
    )
    return out.select(*key, *[F.col(f"_best._v.{c}").alias(c) for c in cols], "any_valid", "varies")


def representative_row(df: DataFrame, key: Sequence[str], by: str, attrs: Sequence[str], tie: str) -> DataFrame:
    """All attributes from the one row with the largest ``by`` (nulls last), plus group sum and size."""
    order = F.struct(F.coalesce(F.col(by).cast("double"), F.lit(-1.0)).alias("_by"), (-F.col(tie)).alias("_t"))
    pick = F.struct(F.col(by), *[F.col(a) for a in attrs])
    return df.groupBy(*key).agg(
        F.max_by(pick, order).alias("_r"), F.sum(by).alias(f"{by}_total"), F.count(F.lit(1)).alias("n_rows")
    ).select(*key, F.col(f"_r.{by}").alias(by), *[F.col(f"_r.{a}").alias(a) for a in attrs], f"{by}_total", "n_rows")


def ordered_diff(df: DataFrame, order: str, value: str, name: str = "diff") -> DataFrame:
    """Value minus the value of the preceding order place. The places are numbered first, so that
    neighbours meet by an equi join."""
    grid = period_grid(df, order)
    placed = df.join(grid, order)
    previous = placed.select((F.col("idx") + 1).alias("idx"), F.col(value).alias("_p"))
    return placed.join(previous, "idx", "left").withColumn(name, F.col(value) - F.col("_p")).drop("idx", "_p")


def value_history(
    df: DataFrame, key: Sequence[str], values: Sequence[str], period: str, runs: bool = False,
) -> DataFrame:
    """First and last period of each value combination per key and whether the key ever changed.

    Default: one range per combination (A-B-A gives overlapping ranges). ``runs=True`` gives true runs.
    """
    if runs:
        packed = df.withColumn("_v", F.to_json(F.struct(*values)))
        eps = detect_episodes(packed, key=key, period=period, value="_v")
        schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in values)
        out = eps.select(*key, F.from_json("_v", schema).alias("_s"), F.col("start").alias("first_q"), F.col("end").alias("last_q"))
        out = out.select(*key, *[F.col(f"_s.{c}").alias(c) for c in values], "first_q", "last_q")
    else:
        out = df.groupBy(*key, *values).agg(F.min(period).alias("first_q"), F.max(period).alias("last_q"))
    changed = out.select(*key, *values).distinct().groupBy(*key).agg((F.count(F.lit(1)) > 1).alias("changed"))
    return keyed_join(out, changed, key)


def grade(
    df: DataFrame, score: str, tie: str, labels: Sequence[str],
    quantiles: Sequence[float] = (0.10, 0.30, 0.70, 0.90, 1.0), edges: Sequence[float] | None = None, name: str = "grade",
) -> DataFrame:
    """Labels by share of the ordinal rank, or by fixed score edges (right-closed)."""
    if edges is not None:
        return df.withColumn(name, cut_bins(score, edges, labels)["label"])
    total = scalar(df.where(F.col(score).isNotNull()), F.count(F.lit(1)))
    ranked = ordinal_rank(df.where(F.col(score).isNotNull()), score, tie, "_rank")
    bins = cut_bins(F.col("_rank") / total, [-0.001, *quantiles], labels)
    return ranked.withColumn(name, bins["label"]).drop("_rank")


def quantile_bins(df: DataFrame, col: str, q: int, name: str = "bin") -> DataFrame:
    """Equal-count bins by exact quantile edges; repeated edges are dropped; nulls get no bin.

    ``bin`` is a struct (bin_idx, label) with the 0-based bin as text label.
    """
    edges = [e for e in quantile_values(df, col, [i / q for i in range(q + 1)]) if e is not None]
    edges = sorted(set(edges))
    if len(edges) < 2:
        return df.withColumn(name, F.lit(None).cast("struct<bin_idx:int,label:string>"))
    labels = [f"q{i + 1}" for i in range(len(edges) - 1)]
    return df.withColumn(name, cut_bins(col, edges, labels, include_lowest=True))


def sort_by(df: DataFrame, order: Sequence[tuple[str, str]]) -> DataFrame:
    """global range-partitioned sort; (column, "asc" | "desc" | "abs"), nulls last."""
    makers = {
        "asc": lambda c: F.col(c).asc_nulls_last(), "desc": lambda c: F.col(c).desc_nulls_last(),
        "abs": lambda c: F.abs(F.col(c)).desc_nulls_last(),
    }
    return df.orderBy(*[makers[how](c) for c, how in order])


def top_n(df: DataFrame, order: Sequence[tuple[str, str]], n: int) -> DataFrame:
    """first n rows overall (TakeOrderedAndProject: each task keeps n rows)."""
    return sort_by(df, order).limit(n)


def distinct_on(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """distinct combinations."""
    return df.select(*cols).distinct()


def union_named(dfs: Sequence[DataFrame]) -> DataFrame:
    """rows of several results by column name."""
    out = dfs[0]
    for other in dfs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def key_set_ops(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """every key of either side with its place: both, only_a, only_b."""
    left = a.select(key).distinct().withColumn("_a", F.lit(1))
    right = b.select(key).distinct().withColumn("_b", F.lit(1))
    where = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")
    return left.join(right, key, "full").select(key, where.alias("side"))


def hash_share(keys: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) that depends only on the key and the seed."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample_groups(df: DataFrame, keys: Sequence[str], frac: float, seed: int = 42) -> DataFrame:
    """a share of the groups with all their rows; a hash of the key decides, so no join is needed."""
    return df.where(hash_share(keys, seed) < frac)


def sample_rows(df: DataFrame, key: str, seed: int = 42, frac: float | None = None, n: int | None = None) -> DataFrame:
    """a share of the rows, or exactly n rows, by the hash of a unique key (repeatable)."""
    share = hash_share([key], seed)
    if frac is not None:
        return df.where(share < frac)
    return df.withColumn("_h", share).orderBy("_h", key).limit(n).drop("_h")


def recommend_top_k(
    df: DataFrame, keys: Sequence[str], item: str, outcome: str, k: int, min_n: int, fallback: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """F8: best k items per key by mean outcome with at least min_n rows; the same for the fallback key.

    Joining the first with the second where it is missing is C6's business.
    """

    def best(by: Sequence[str]) -> DataFrame:
        rates = df.groupBy(*by, item).agg(F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("rate")).where(F.col("n") >= min_n)
        return top_per_group(rates, by, [F.desc("rate"), F.desc("n"), F.asc(item)], k)

    return best(keys), best(fallback)


def recommendations_for(
    rows: DataFrame, full: DataFrame, floor: DataFrame, keys: Sequence[str], fallback: Sequence[str], item: str,
    labels: tuple[str, str] = ("full", "fallback"),
) -> DataFrame:
    """F8: attach the ranked items as an array (at most k entries), falling back to the coarser key."""

    def packed(best: DataFrame, by: Sequence[str], name: str) -> DataFrame:
        entry = F.struct("rank", F.col(item).alias("item"), "rate", "n")
        return best.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias(name))

    out = keyed_join(rows, packed(full, keys, "_full"), keys, "left")
    out = keyed_join(out, packed(floor, fallback, "_floor"), fallback, "left")
    return out.withColumn("basis", F.when(F.col("_full").isNotNull(), labels[0]).otherwise(labels[1])).withColumn(
        "recommended", F.coalesce("_full", "_floor")
    ).drop("_full", "_floor")


def alternatives(df: DataFrame, keys: Sequence[str], id_col: str, score: str, k: int, cols: Sequence[str] = ()) -> DataFrame:
    """the k safest other rows of the same group for every row: k+1 per group, minus the row itself."""
    entry = F.struct(F.col("_r"), F.col(id_col).alias("id"), F.col(score).alias("score"), *[F.col(c) for c in cols])
    best = (
        top_per_group(df, keys, [F.asc(score), F.asc(id_col)], k + 1, rank="_r")
        .groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_best"))
    )
    out = keyed_join(df, best, keys, "left")
    others = F.filter("_best", lambda x: x["id"] != F.col(id_col))
    return out.withColumn("alternatives", F.slice(others, 1, k)).drop("_best")


def nested_history(df: DataFrame, key: Sequence[str], order: str, fields: Sequence[str], name: str = "history") -> DataFrame:
    """records of a key as an array sorted by ``order`` (episodes per place are bounded by the grid)."""
    entry = F.struct(order, *[f for f in fields if f != order])
    return df.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias(name))
