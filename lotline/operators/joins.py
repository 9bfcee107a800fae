"""Joins. Side inputs carry no broadcast hints: Catalyst and AQE decide on the real size, and AQE splits
skewed partitions; where a key repeats on the dimension side the operator says so instead of fanning out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.runtime import keyed_join


def attach(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of a dimension."""
    return df.join(dim, list(on), "left")


def inner_on(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join."""
    return df.join(other, list(on), "inner")


def outer_features(dfs: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer join of several feature tables on one key, which appears once."""
    return reduce(lambda a, b: a.join(b, list(on), "full"), dfs)


def lookup(df: DataFrame, dim: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """C4: bring columns of a keyed table; a repeated key on the table side is an error, not a fan-out."""
    checked = dim.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in cols])
    guard = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("lookup key repeats: "), F.col(key).cast("string"))))
    checked = checked.withColumn("_g", guard.cast("int")).where(F.col("_g").isNull()).drop("_n", "_g")
    return df.join(checked, key, "left")


def keep_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose (possibly composite) key is in the other table."""
    return df.join(keys.select(*on), list(on), "left_semi")


def keep_not_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the other table (null keys stay)."""
    return df.join(keys.select(*on), list(on), "left_anti")


def flag_in(df: DataFrame, keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Membership as a column."""
    marked = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(marked, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def join_with_fallback(
    df: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str], str]], values: Sequence[str],
    basis: str = "basis", none: str = "none",
) -> DataFrame:
    """Take the values from the first level (table, keys, label) that has the first value; name that level.

    Each level table has one row per key.
    """
    out = df
    for i, (table, keys, _) in enumerate(levels):
        side = table.select(*keys, *[F.col(v).alias(f"_{i}_{v}") for v in values])
        out = keyed_join(out, side, list(keys), "left")
    lead = values[0]
    chosen = [F.col(f"_{i}_{lead}").isNotNull() for i in range(len(levels))]
    for v in values:
        pick = None
        for i, hit in enumerate(chosen):
            pick = F.when(hit, F.col(f"_{i}_{v}")) if pick is None else pick.when(hit, F.col(f"_{i}_{v}"))
        out = out.withColumn(v, pick)
    label = None
    for (_, _, text), hit in zip(levels, chosen):
        label = F.when(hit, F.lit(text)) if label is None else label.when(hit, F.lit(text))
    return out.withColumn(basis, label.otherwise(F.lit(none))).drop(
        *[f"_{i}_{v}" for i in range(len(levels)) for v in values]
    )


def expand_span(df: DataFrame, start: str, end: str, grid: DataFrame, period: str = "period") -> DataFrame:
    """C11: one row per grid period inside a closed span, through the places in the grid (equi joins only)."""
    a = grid.select(F.col(period).alias(start), F.col("idx").alias("_a"))
    z = grid.select(F.col(period).alias(end), F.col("idx").alias("_z"))
    return (
        df.join(a, start).join(z, end)
        .withColumn("idx", F.explode(F.sequence("_a", "_z"))).drop("_a", "_z")
        .join(grid, "idx")
    )


def pair_before_after(df: DataFrame, key: str, order_first: str, order_last: str, cols: Sequence[str], cut) -> DataFrame:
    """Last record before ``cut`` and first record from ``cut`` on for keys that have both."""
    value = F.struct(*[F.col(c) for c in cols])
    sides = df.groupBy(key).agg(
        F.max_by(value, F.when(F.col(order_first) < cut, F.struct(order_last, *cols))).alias("old"),
        F.min_by(value, F.when(F.col(order_last) >= cut, F.struct(order_first, *cols))).alias("new"),
    )
    return sides.where(F.col("old").isNotNull() & F.col("new").isNotNull()).select(
        key, *[F.col(f"old.{c}").alias(f"{c}_old") for c in cols], *[F.col(f"new.{c}").alias(f"{c}_new") for c in cols]
    )
