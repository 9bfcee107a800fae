"""Tenancy episodes on an ordinal period axis: detection, gap diagnosis, repair, vacancy.

Periods are compared by their place in the grid of observed periods, never by calendar arithmetic.
A place has at most one tenant per period, so a place owns at most as many rows as the grid has
periods; windows and arrays per place are bounded by that number however many rows came in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lotline.operators.ordinals import dense_index
from lotline.runtime import pinned, scalar

OPEN, CLOSED = "open", "closed"


def one_tenant(panel: DataFrame, key: Sequence[str], period: str, value: str) -> DataFrame:
    """One row per place and period (smallest tenant wins), combined before the shuffle."""
    return panel.groupBy(*key, period).agg(F.min(value).alias(value))


def period_grid(panel: DataFrame, period: str) -> DataFrame:
    """Observed periods with their 0-based place: columns (period, idx)."""
    return dense_index(panel, period, "idx")


def detect_episodes(
    panel: DataFrame, *, key: Sequence[str], period: str, value: str,
    unique: bool = False, last_period: Column | None = None,
) -> DataFrame:
    """Runs of the same tenant at a place, in observed periods.

    A-B-A gives three episodes. A missing period does not end a run (that is E4's business).
    ``unique=True`` says the panel already has one row per place and period and saves a shuffle.
    """
    cells = panel.select(*key, period, value) if unique else one_tenant(panel, key, period, value)
    last = last_period if last_period is not None else scalar(panel, F.max(period))
    # one shuffle and one sort: both windows share partitioning and order, and only first rows of runs go on
    order = W.partitionBy(*key).orderBy(period)
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.lag(value).over(order)
    firsts = (
        cells.withColumns({
            "__first": before.isNull() | (before != F.col(value)), "__row": F.row_number().over(order),
            "__prev": F.lag(period).over(order), "__last": F.max(period).over(whole), "__n": F.count(F.lit(1)).over(whole),
        })
        .where("__first")
    )
    runs = firsts.withColumns({
        "episode_id": F.row_number().over(order).cast("long"), "start": F.col(period),
        "end": F.coalesce(F.lead("__prev").over(order), F.col("__last")),
        "surv_q": (F.coalesce(F.lead("__row").over(order), F.col("__n") + 1) - F.col("__row")).cast("long"),
    })
    return runs.select(
        *key, "episode_id", value, "start", "end", "surv_q",
        F.when(F.col("end") == last, OPEN).otherwise(CLOSED).alias("state"),
    )


def location_metrics(episodes: DataFrame, *, key: Sequence[str], length: str = "surv_q") -> DataFrame:
    """Observed quarters = sum of episode lengths; turnover = episodes - 1; rate over (observed - 1).

    The rate is null when only one quarter was observed.
    """
    out = episodes.groupBy(*key).agg(
        F.sum(length).alias("obs_quarters"),
        (F.count(F.lit(1)) - 1).alias("turnover_cnt"),
        F.avg(length).alias("mean_surv"),
        F.max(length).alias("max_surv"),
    )
    rate = F.col("turnover_cnt") / F.greatest(F.col("obs_quarters") - 1, F.lit(1))
    return out.withColumn("turnover_rate", F.when(F.col("obs_quarters") > 1, rate))


def calendar(grid: DataFrame, bad: DataFrame | None = None, period: str = "period") -> DataFrame:
    """The grid with a ``bad`` flag and the running number of good periods (``good_upto``).

    As many rows as there are snapshot periods, hence one ordered window over it is small.
    """
    marked = grid.withColumn("bad", F.lit(False)) if bad is None else grid.join(
        bad.select(period).distinct().withColumn("bad", F.lit(True)), period, "left"
    ).withColumn("bad", F.coalesce("bad", F.lit(False)))
    good = F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(W.orderBy("idx"))
    return pinned(marked.withColumn("good_upto", good).select(period, "idx", "bad", "good_upto"))


def _span(episodes: DataFrame, cal: DataFrame, period: str = "period") -> DataFrame:
    """Adds start_idx, end_idx and the number of good periods before the span (good_before) and up to its end (good_end)."""
    first = cal.select(
        F.col(period).alias("start"), F.col("idx").alias("start_idx"),
        (F.col("good_upto") - F.when(F.col("bad"), 0).otherwise(1)).alias("_good_before"),
    )
    last = cal.select(F.col(period).alias("end"), F.col("idx").alias("end_idx"), F.col("good_upto").alias("_good_end"))
    return (
        episodes.join(first, "start").join(last, "end")
        .withColumnsRenamed({"_good_end": "good_end", "_good_before": "good_before"})
    )


def gap_check(episodes: DataFrame, grid: DataFrame, period: str = "period") -> DataFrame:
    """Expected periods between start and end by the grid against the observed number."""
    starts = grid.select(F.col(period).alias("start"), F.col("idx").alias("start_idx"))
    ends = grid.select(F.col(period).alias("end"), F.col("idx").alias("end_idx"))
    return (
        episodes.join(starts, "start").join(ends, "end")
        .withColumn("expected_q", (F.col("end_idx") - F.col("start_idx") + 1).cast("long"))
        .withColumn("gap_q", F.col("expected_q") - F.col("surv_q"))
    )


def missing_period_counts(
    episodes: DataFrame, panel: DataFrame, grid: DataFrame, *,
    key: Sequence[str], value: str, period: str = "period",
) -> DataFrame:
    """E5: how often each period is missing inside a gapped episode.

    Only the first gapped episode of a (place, tenant) pair counts; a period counts as observed
    when the pair was seen in it at all.
    """
    pair = [*key, value]
    first = (
        gap_check(episodes, grid, period).where(F.col("gap_q") > 0)
        .groupBy(*pair)
        .agg(F.min_by(F.struct("start_idx", "end_idx"), "start_idx").alias("s"))
        .select(*pair, F.explode(F.sequence("s.start_idx", "s.end_idx")).alias("idx"))
    )
    seen = panel.select(*pair, period).join(grid, period).select(*pair, "idx")
    return (
        first.join(seen, [*pair, "idx"], "left_anti")
        .groupBy("idx").agg(F.count(F.lit(1)).alias("n_missing"))
        .join(grid, "idx").select(period, "n_missing")
    )


def structural_bad_periods(counts: DataFrame, ratio: float = 0.2, period: str = "period") -> DataFrame:
    """Periods whose missing count reaches ``ratio`` of the largest one; empty when nothing is missing."""
    counts = pinned(counts)
    return counts.where(F.col("n_missing") >= scalar(counts, F.max("n_missing")) * F.lit(ratio)).select(period)


def merge_gap_episodes(
    episodes: DataFrame, cal: DataFrame, *, key: Sequence[str], value: str, detail: bool = False,
) -> DataFrame:
    """An episode wholly inside bad periods, between two episodes of one tenant, is swallowed.

    One pass with a stack of finished episodes gives the same end state as repeating single merges
    until nothing changes: a merge only ever changes the top two entries. The array of a place holds
    at most one entry per period of the grid. A merged span counts every good period of the grid between its
    ends, also one that nobody was seen in. With ``detail`` one row per place comes back with
    the number of merges and the swallowed spans.
    """
    item = F.struct(
        F.col("start_idx").alias("si"), F.col("end_idx").alias("ei"), F.col("start").alias("s"), F.col("end").alias("e"),
        F.col(value).alias("v"), F.col("good_before").cast("long").alias("g0"), F.col("good_end").cast("long").alias("g1"),
    )
    spans = _span(episodes, cal)
    rows = spans.select(*key, item.alias("x")).groupBy(*key).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    entry = spans.select(item.alias("x")).schema["x"].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        n = F.size(acc["stack"])
        top, under = F.get(acc["stack"], n - 1), F.get(acc["stack"], n - 2)
        hit = (n >= 2) & (under["v"] == x["v"]) & (top["g0"] == top["g1"])
        joined = F.struct(
            under["si"].alias("si"), x["ei"].alias("ei"), under["s"].alias("s"), x["e"].alias("e"),
            under["v"].alias("v"), under["g0"].alias("g0"), x["g1"].alias("g1"),
        )
        merged = F.struct(
            F.concat(F.slice(acc["stack"], 1, n - 2), F.array(joined)).alias("stack"),
            (acc["merges"] + 1).alias("merges"),
            F.concat(acc["eaten"], F.array(F.struct(top["si"].alias("si"), top["ei"].alias("ei")))).alias("eaten"),
        )
        kept = F.struct(
            F.concat(acc["stack"], F.array(x)).alias("stack"), acc["merges"].alias("merges"), acc["eaten"].alias("eaten"),
        )
        return F.when(hit, merged).otherwise(kept)

    start = F.struct(
        F.array().cast(f"array<{entry}>").alias("stack"),
        F.lit(0).alias("merges"),
        F.array().cast("array<struct<si:int,ei:int>>").alias("eaten"),
    )
    folded = rows.select(*key, F.aggregate("xs", start, step).alias("f"))
    if detail:
        return folded.select(*key, F.col("f.merges").alias("merges"), F.col("f.eaten").alias("eaten"))
    return folded.select(*key, F.posexplode("f.stack").alias("pos", "x")).select(
        *key, (F.col("pos") + 1).cast("long").alias("episode_id"), F.col("x.v").alias(value),
        F.col("x.s").alias("start"), F.col("x.e").alias("end"),
    )


def merge_summary(merged_detail: DataFrame) -> DataFrame:
    """E7 report: how many places had how many merges."""
    return merged_detail.groupBy("merges").agg(F.count(F.lit(1)).alias("n_locations"))


def swallowed_period_counts(merged_detail: DataFrame, grid: DataFrame, period: str = "period") -> DataFrame:
    """E7 report: how often each period was swallowed by a merge."""
    return (
        merged_detail.select(F.explode("eaten").alias("x"))
        .select(F.explode(F.sequence("x.si", "x.ei")).alias("idx"))
        .groupBy("idx").agg(F.count(F.lit(1)).alias("n_swallowed"))
        .join(grid, "idx").select(period, "n_swallowed")
    )


def recount_survival(
    episodes: DataFrame, panel: DataFrame, cal: DataFrame, *,
    key: Sequence[str], value: str, period: str = "period",
) -> DataFrame:
    """Periods of the span in which the pair was seen or which are bad.

    The good periods seen by a pair form a set no larger than the grid; bad ones are counted by
    the running number of good periods, so no span is unrolled.
    """
    pair = [*key, value]
    seen = (
        panel.join(cal.where(~F.col("bad")), period).groupBy(*pair)
        .agg(F.collect_set("idx").alias("_seen"))
    )
    spans = _span(episodes, cal)
    inside = F.size(F.filter("_seen", lambda i: (i >= F.col("start_idx")) & (i <= F.col("end_idx"))))
    bad_in_span = F.col("end_idx") - F.col("start_idx") + 1 - (F.col("good_end") - F.col("good_before"))
    last = scalar(cal, F.max(period))
    return (
        spans.join(seen, pair, "left")
        .withColumn("surv_q_fixed", (F.coalesce(F.when(F.col("_seen").isNotNull(), inside), F.lit(0)) + bad_in_span).cast("long"))
        .withColumn("state", F.when(F.col("end") == last, OPEN).otherwise(CLOSED))
        .drop("_seen", "start_idx", "end_idx", "good_end", "good_before")
    )


def correction_diff(
    before: DataFrame, after: DataFrame, on: Sequence[str], before_col: str = "surv_q", after_col: str = "surv_q_fixed",
) -> DataFrame:
    """Lengths before and after the correction for the same (place, tenant), with their difference.

    A pair with several episodes on both sides meets in every combination, as a plain join does.
    """
    left = before.select(*on, F.col(before_col).alias("before_q"))
    right = after.select(*on, F.col(after_col).alias("after_q"))
    return left.join(right, list(on)).withColumn("diff_q", F.col("after_q") - F.col("before_q"))


def prior_count(df: DataFrame, *, key: Sequence[str], order: str, name: str = "prior_tenants") -> DataFrame:
    """Number of earlier episodes at the same place (episodes of a place are bounded by the grid)."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*key).orderBy(order)) - 1)


def vacancy(episodes: DataFrame, cal: DataFrame, *, key: Sequence[str], period: str = "period") -> DataFrame:
    """Vacant share between the first start and the last end of a place.

    Expected periods leave out bad ones in which nobody was there. Occupied periods are a set, so
    overlapping episodes count once. The rate is null when no period is expected.
    """
    at = cal.select(F.col(period).alias("start"), F.col("idx").alias("start_idx"))
    to = cal.select(F.col(period).alias("end"), F.col("idx").alias("end_idx"))
    occupied = (
        episodes.join(at, "start").join(to, "end")
        .select(*key, F.explode(F.sequence("start_idx", "end_idx")).alias("idx")).distinct()
    )
    # the first and the last period of a place are occupied, so the running number of good periods
    # there is the smallest and the largest one seen
    good = F.when(F.col("bad"), 0).otherwise(1)
    busy = occupied.join(cal, "idx").groupBy(*key).agg(
        F.min(period).alias("first_q"), F.max(period).alias("last_q"), F.count(F.lit(1)).alias("_busy"),
        F.count_if(F.col("bad")).alias("_busy_bad"), F.max("good_upto").alias("_good_z"),
        F.min(F.col("good_upto") - good).alias("_good_a"),
    )
    good_span = F.col("_good_z") - F.col("_good_a")
    return (
        busy.withColumn("span_q", (good_span + F.col("_busy_bad")).cast("long"))
        .withColumn("vacant_q", (F.col("span_q") - F.col("_busy")).cast("long"))
        .withColumn("vacancy_rate", F.when(F.col("span_q") > 0, F.col("vacant_q") / F.col("span_q")))
        .select(*key, "first_q", "last_q", "span_q", "vacant_q", "vacancy_rate")
    )
