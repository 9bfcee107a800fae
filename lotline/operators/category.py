"""Category systems that change over time: detection of the revision and a crosswalk learned from survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.operators.aggregates import group_mode, share_and_dominant
from lotline.operators.episodes import period_grid
from lotline.operators.joins import pair_before_after


def category_changes(df: DataFrame, period: str, category: str) -> DataFrame:
    """Number of category names that appear or vanish against the preceding period."""
    pairs = df.where(F.col(category).isNotNull()).select(period, F.col(category).cast("string").alias("c")).distinct()
    placed = pairs.join(period_grid(df, period), period).select("idx", "c")
    now = placed.where(F.col("idx") > 0).withColumn("_now", F.lit(1))
    before = placed.withColumn("idx", F.col("idx") + 1).withColumn("_before", F.lit(1))
    changed = (
        now.join(before, ["idx", "c"], "full")
        .groupBy("idx").agg(F.count_if(F.col("_now").isNull() | F.col("_before").isNull()).alias("n_changed"))
    )
    return changed.join(period_grid(df, period), "idx").select(period, "n_changed")


def detect_category_revision(df: DataFrame, period: str, category: str, min_changed: int = 3) -> DataFrame:
    """First period whose set of category names differs in at least ``min_changed`` names
    (one row, null if there is none)."""
    return category_changes(df, period, category).agg(
        F.min(F.when(F.col("n_changed") >= min_changed, F.col(period))).alias("revision")
    )


def compress(df: DataFrame, key: str, period: str, categories: list[str]) -> DataFrame:
    """First and last period per (key, categories): the small form every later step works on."""
    return df.groupBy(key, *categories).agg(F.min(period).alias("first_q"), F.max(period).alias("last_q"))


def category_crosswalk(comp: DataFrame, key: str, category: str, others: list[str], revision: int) -> DataFrame:
    """Old category to the new category most survivors moved to, with that share and a weak mark (< 0.5)."""
    both = pair_before_after(comp, key, "first_q", "last_q", [category, *others], revision)
    moves = both.groupBy(f"{category}_old", f"{category}_new").agg(F.count(F.lit(1)).alias("n_keys"))
    best = share_and_dominant(moves, key=[f"{category}_old"], category=f"{category}_new", measure="n_keys")
    return best.where("is_dominant").select(
        F.col(f"{category}_old").alias("old_category"), F.col(f"{category}_new").alias("new_category"), "n_keys", "share",
        (F.col("share") < 0.5).alias("weak"),
    )


def apply_crosswalk(
    comp: DataFrame, crosswalk: DataFrame, key: str, category: str, major: str, revision: int, default: str = "other",
) -> DataFrame:
    """Final category per key. Keys seen after the revision keep their last one; the others are
    translated (untranslatable names stay); the major group is the modal one of the new side."""
    new_side = comp.where(F.col("last_q") >= revision)
    last = comp.groupBy(key).agg(
        F.max(F.struct("last_q", "first_q", category)).alias("_any"),
        F.max(F.when(F.col("last_q") >= revision, F.struct("last_q", "first_q", category))).alias("_new"),
    ).select(key, F.col(f"_any.{category}").alias("_old"), F.col(f"_new.{category}").alias("_new"))
    joined = last.join(crosswalk.select("old_category", "new_category"), F.col("_old") == F.col("old_category"), "left")
    final = joined.select(key, F.coalesce("_new", "new_category", "_old").alias(category))
    majors = group_mode(new_side, [category], major, name=major)
    return final.join(majors, category, "left").select(
        key, category, F.coalesce(major, F.lit(default)).alias(major)
    )
