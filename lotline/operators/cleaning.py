"""Cleaning and data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.functions.columns import null_out
from lotline.operators.aggregates import group_mode
from lotline.runtime import scalar

VERIFIED = "verified"


def reverse_code_map(facts: DataFrame, names: Sequence[str], code: str, how: str = "mode") -> DataFrame:
    """B2: names to code. ``mode`` takes the most frequent code, ``last`` the largest one
    (the order of rows is not a tie-break here)."""
    known = facts.where(F.col(code).isNotNull())
    for n in names:
        known = known.where(F.col(n).isNotNull())
    if how == "mode":
        return group_mode(known, names, code, name=code)
    return known.groupBy(*names).agg(F.max(code).alias(code))


def exceed_limit_count(df: DataFrame, value: str, limit: str) -> DataFrame:
    """How many numeric values lie above their limit."""
    number = F.col(value).cast("string").try_cast("double")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(number > F.col(limit)).alias("n_exceeding")
    )


def flag_cascade(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "reliability", start: str = VERIFIED) -> DataFrame:
    """Ordered downgrades; the first rule that holds decides, a row without any stays ``start``.

    A row already downgraded is never relabelled, so one ordered CASE says the same as repeated updates.
    """
    label = None
    for text, rule in rules:
        rule = F.coalesce(rule, F.lit(False))
        label = F.when(rule, F.lit(text)) if label is None else label.when(rule, F.lit(text))
    return df.withColumn(name, label.otherwise(F.lit(start)) if label is not None else F.lit(start))


def rare_to_other(df: DataFrame, col: str, min_share: float = 0.005, other: str = "other", missing: str = "missing",
                  name: str | None = None) -> DataFrame:
    """Categories below a share of the known rows become ``other``, nulls ``missing``."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    keep = counts.where(F.col("_n") / scalar(counts, F.sum("_n")) >= min_share).select(
        F.col(col).alias("_c"), F.lit(True).alias("_keep")
    )
    joined = df.join(keep, F.col(col) == F.col("_c"), "left")
    value = F.when(F.col(col).isNull(), missing).when(F.col("_keep"), F.col(col)).otherwise(other)
    return joined.withColumn(name or col, value).drop("_c", "_keep")


def null_out_invalid(df: DataFrame, rules: dict[str, Sequence[Column]]) -> DataFrame:
    """Null the listed columns where one of their rules holds."""
    return df.withColumns({c: null_out(c, *tests) for c, tests in rules.items()})


def building_rules() -> dict[str, Sequence[Column]]:
    """Area above a million or above footprint x floors x 3, not positive; approval year out of range."""
    floors = F.greatest(F.coalesce("floors_up", F.lit(0)) + F.coalesce("floors_down", F.lit(0)), F.lit(1))
    footprint = F.col("footprint")
    return {
        "area": [F.col("area") <= 0, F.col("area") > 1_000_000,
                 (F.col("area") > footprint * floors * 3) & (footprint > 0)],
        "approval_year": [~F.col("approval_year").between(1900, 2026)],
    }


def pick_columns_by_pattern(df: DataFrame, candidates: dict[str, Sequence[str]]) -> DataFrame:
    """For each wanted name the first column whose lower-cased name contains a candidate;
    the order of candidates is the priority. Latitude and longitude are swapped when the median latitude
    lies above 90."""
    found = {}
    for want, patterns in candidates.items():
        for pattern in patterns:
            hits = [c for c in df.columns if pattern in c.lower()]
            if hits:
                found[want] = hits[0]
                break
        else:
            raise ValueError(f"no column for {want}: tried {list(patterns)}")
    out = df.select(*[F.col(f"`{c}`").alias(w) for w, c in found.items()])
    if {"lat", "lon"} <= set(found):
        middle = df.select(F.col(f"`{found['lat']}`").cast("double").alias("v")).approxQuantile("v", [0.5], 0.01)
        if middle and middle[0] > 90:
            out = out.withColumnsRenamed({"lat": "_x", "lon": "lat"}).withColumnRenamed("_x", "lon")
    return out


def dropna_report(df: DataFrame, subset: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows without nulls in the subset, and one row per column with its nulls and the rows lost."""
    any_null = F.lit(False)
    for c in subset:
        any_null = any_null | F.col(c).isNull()
    one = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(any_null).alias("n_lost"),
        *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in subset],
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n_null")) for c in subset])
    report = one.select("n_rows", "n_lost", F.explode(pairs).alias("p")).select(
        F.col("p.column"), F.col("p.n_null"), "n_lost", "n_rows"
    )
    return df.na.drop(subset=list(subset)), report


def zero_variance_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standard deviation per column in one pass, with a flag for zero."""
    one = df.agg(*[F.stddev_samp(c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("std")) for c in cols])
    return one.select(F.explode(pairs).alias("p")).select(
        F.col("p.column"), F.col("p.std"), F.coalesce(F.col("p.std") == 0, F.lit(False)).alias("zero")
    )


def membership_report(a: DataFrame, b: DataFrame, key: str, check: Sequence[str]) -> DataFrame:
    """Rows of a that are / are not in b, with nulls of the checked columns in each part."""
    marked = a.join(b.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    return marked.groupBy(F.coalesce("_in", F.lit(False)).alias("in_other")).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in check]
    )
