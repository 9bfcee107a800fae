"""Exact order statistics without a global sort in one task.

A value range is cut into buckets at approximate quantiles. Counts per bucket are small, so the
position of a rank is found on them; only the bucket that holds it is looked at value by value.
Equal values are counted before they are ordered, hence a value held by a third of all rows is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.runtime import SMALL_ROWS, keyed_join, pinned

_ALL = "__all"


def value_splits(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Inner bucket edges of a numeric column (one sketch pass; at most ``buckets`` numbers)."""
    if buckets is None:
        buckets = min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16), 1000)
    probabilities = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.approxQuantile(value, probabilities, 0.5 / buckets)))


def with_bucket(df: DataFrame, value: str, splits: Sequence[float], name: str = "__o_b") -> DataFrame:
    """Monotone bucket number of a non-null numeric column."""
    if not splits:
        return df.withColumn(name, F.lit(0))
    edges = [float("-inf"), *splits, float("inf")]
    out = Bucketizer(splits=edges, inputCol=value, outputCol="__bucket").transform(df)
    return out.withColumn(name, F.col("__bucket").cast("int")).drop("__bucket")


def _is_number(value: str) -> Column:
    """Not null and not NaN, which stands for no value here."""
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def _with_keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, list(by)
    return df.withColumn(_ALL, F.lit(0)), [_ALL]


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of ``probs``; nulls are left out."""
    names = list(probs)
    rows, keys = _with_keys(
        df.where(_is_number(value)).select(*by, F.col(value).cast("double").alias("__o_v")), by
    )
    rows = with_bucket(rows, "__o_v", value_splits(rows, "__o_v", buckets))
    whole = W.partitionBy(*keys)
    hist = (
        rows.groupBy(*keys, "__o_b").agg(F.count(F.lit(1)).alias("__o_n"))
        .withColumn("__o_upto", F.sum("__o_n").over(whole.orderBy("__o_b")))
        .withColumn("__o_total", F.sum("__o_n").over(whole))
        .withColumn("__o_before", F.col("__o_upto") - F.col("__o_n"))
    )
    wanted = []
    for name, q in probs.items():
        place = (F.col("__o_total") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            wanted.append(
                F.struct(F.lit(f"{name}|{side}").alias("what"), rank.cast("long").alias("rank"),
                         (place - F.floor(place)).alias("frac"))
            )
    hits = (
        hist.withColumn("__o_t", F.filter(F.array(*wanted), lambda t: (t["rank"] >= F.col("__o_before"))
                                       & (t["rank"] < F.col("__o_upto"))))
        .where(F.size("__o_t") > 0)
        .select(*keys, "__o_b", "__o_before", "__o_t")
    )
    hits = pinned(hits)  # a few rows per group: the rows are then filtered where they are read
    inside = (
        keyed_join(rows, hits, [*keys, "__o_b"])
        .groupBy(*keys, "__o_b", "__o_v")
        .agg(F.count(F.lit(1)).alias("__o_n"), F.any_value("__o_before").alias("__o_before"), F.any_value("__o_t").alias("__o_t"))
        .withColumn("__o_upto", F.col("__o_before") + F.sum("__o_n").over(W.partitionBy(*keys, "__o_b").orderBy("__o_v")))
        .withColumn("__o_hit", F.explode(F.filter("__o_t", lambda t: (t["rank"] < F.col("__o_upto"))
                                               & (t["rank"] >= F.col("__o_upto") - F.col("__o_n")))))
    )
    columns = []
    for name in names:
        low = F.max(F.when(F.col("__o_hit.what") == f"{name}|lo", F.col("__o_v")))
        high = F.max(F.when(F.col("__o_hit.what") == f"{name}|hi", F.col("__o_v")))
        frac = F.max(F.when(F.col("__o_hit.what") == f"{name}|lo", F.col("__o_hit.frac")))
        columns.append((low + (high - low) * frac).alias(name))
    out = inside.groupBy(*keys).agg(*columns)
    return out.drop(_ALL) if not by else out


def quantile_values(df: DataFrame, value: str, probs: Sequence[float]) -> list[float | None]:
    """The same as a short driver-side list (edges of bins, thresholds)."""
    names = {f"q{i}": p for i, p in enumerate(probs)}
    row = exact_quantiles(df, value, names).first()
    return [None if row is None else row[n] for n in names]


def weighted_quantile(
    df: DataFrame, value: str, weight: str, name: str, by: Sequence[str] = (), q: float = 0.5
) -> DataFrame:
    """Lower weighted quantile: first value whose cumulative weight reaches ``q`` of the total.

    Rows with a null value or weight do not count (unlike in the weighted mean). Sums are compared
    with a relative slack of 1e-9, so that the order of summation cannot move the answer.
    """
    rows, keys = _with_keys(
        df.where(_is_number(value) & _is_number(weight))
        .select(*by, F.col(value).cast("double").alias("__o_v"), F.col(weight).cast("double").alias("__o_w")), by
    )
    rows = with_bucket(rows, "__o_v", value_splits(rows, "__o_v"))
    whole = W.partitionBy(*keys)
    goal = F.col("__o_total") * F.lit(float(q)) - F.col("__o_total") * F.lit(1e-9)
    hits = (
        rows.groupBy(*keys, "__o_b").agg(F.sum("__o_w").alias("__o_s"))
        .withColumn("__o_upto", F.sum("__o_s").over(whole.orderBy("__o_b")))
        .withColumn("__o_total", F.sum("__o_s").over(whole))
        .withColumn("__o_goal", goal)
        .where(F.col("__o_upto") >= F.col("__o_goal"))
        .withColumn("__o_rn", F.row_number().over(whole.orderBy("__o_b")))
        .where(F.col("__o_rn") == 1)
        .select(*keys, "__o_b", "__o_goal", (F.col("__o_upto") - F.col("__o_s")).alias("__o_before"))
    )
    hits = pinned(hits)
    out = (
        keyed_join(rows, hits, [*keys, "__o_b"])
        .groupBy(*keys, "__o_b", "__o_v")
        .agg(F.sum("__o_w").alias("__o_s"), F.any_value("__o_before").alias("__o_before"), F.any_value("__o_goal").alias("__o_goal"))
        .withColumn("__o_upto", F.col("__o_before") + F.sum("__o_s").over(W.partitionBy(*keys, "__o_b").orderBy("__o_v")))
        .groupBy(*keys)
        .agg(F.coalesce(F.min(F.when(F.col("__o_upto") >= F.col("__o_goal"), F.col("__o_v"))), F.max("__o_v")).alias(name))
    )
    return out.drop(_ALL) if not by else out


def value_positions(df: DataFrame, value: str, by: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """Distinct values with their count, the number of smaller rows and the average rank.

    ``count`` names a column of pre-aggregated counts. Columns: by, value, n, smaller, avg_rank.
    """
    weight = F.sum(count) if count else F.count(F.lit(1))
    rows, keys = _with_keys(df.where(_is_number(value)), by)
    counts = rows.groupBy(*keys, value).agg(weight.cast("long").alias("n"))
    counts = counts.withColumn("__o_v", F.col(value).cast("double"))
    counts = with_bucket(counts, "__o_v", value_splits(counts, "__o_v"))
    offsets = counts.groupBy(*keys, "__o_b").agg(F.sum("n").alias("__o_s")).withColumn(
        "__o_before", F.sum("__o_s").over(W.partitionBy(*keys).orderBy("__o_b")) - F.col("__o_s")
    )
    running = F.sum("n").over(W.partitionBy(*keys, "__o_b").orderBy(value)) - F.col("n")
    out = (
        keyed_join(counts.withColumn("__o_run", running), pinned(offsets.select(*keys, "__o_b", "__o_before")), [*keys, "__o_b"])
        .withColumn("smaller", F.col("__o_before") + F.col("__o_run"))
        .withColumn("avg_rank", F.col("smaller") + (F.col("n") + 1) / 2.0)
    )
    return out.select(*by, value, "n", "smaller", "avg_rank")


def ordinal_rank(
    df: DataFrame, value: str, tie: str, name: str = "rank", descending: bool = False, then: Sequence[str] = (),
) -> DataFrame:
    """1-based position in the order (value, tie) over all rows; ``tie`` is a number, unique or made so by ``then``.

    Positions inside equal values are counted per bucket of ``tie``, so one value may hold most rows.
    """
    keyed = df.withColumn("__o_k", (-F.col(value) if descending else F.col(value)).cast("double"))
    keyed = keyed.withColumn("__o_t", F.col(tie).cast("double"))
    keyed = with_bucket(keyed, "__o_t", value_splits(keyed, "__o_t"), "__o_tb")
    cells = keyed.groupBy("__o_k", "__o_tb").agg(F.count(F.lit(1)).alias("__o_c"))
    cells = cells.withColumn("__o_in", F.sum("__o_c").over(W.partitionBy("__o_k").orderBy("__o_tb")) - F.col("__o_c"))
    places = value_positions(cells.select("__o_k", "__o_c"), "__o_k", count="__o_c").select("__o_k", "smaller")
    start = cells.join(places, "__o_k").select("__o_k", "__o_tb", (F.col("smaller") + F.col("__o_in")).alias("__o_start"))
    inner = F.row_number().over(W.partitionBy("__o_k", "__o_tb").orderBy(tie, *then))
    return (
        keyed.withColumn("__o_i", inner).join(start, ["__o_k", "__o_tb"])
        .withColumn(name, F.col("__o_start") + F.col("__o_i"))
        .drop("__o_k", "__o_t", "__o_tb", "__o_i", "__o_start")
    )


def text_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, sample: int = 500) -> DataFrame:
    """1-based place of a unique text inside its group, without sorting a group in one task.

    The bucket edges come from a small hash-ordered sample; they only balance the work.
    """
    picks = df.select(value).orderBy(F.xxhash64(value)).limit(sample).toArrow().column(value).to_pylist()
    edges = F.array(*[F.lit(e) for e in sorted(set(picks))]) if picks else F.array().cast("array<string>")
    cut = df.withColumn("__o_b", F.size(F.filter(edges, lambda e: e < F.col(value))))
    sizes = cut.groupBy(*keys, "__o_b").agg(F.count(F.lit(1)).alias("__o_c"))
    sizes = sizes.withColumn("__o_before", F.sum("__o_c").over(W.partitionBy(*keys).orderBy("__o_b")) - F.col("__o_c")).drop("__o_c")
    placed = cut.withColumn("__o_i", F.row_number().over(W.partitionBy(*keys, "__o_b").orderBy(value)))
    return (
        keyed_join(placed, sizes, [*keys, "__o_b"])
        .withColumn(name, (F.col("__o_before") + F.col("__o_i")).cast("long"))
        .drop("__o_b", "__o_i", "__o_before")
    )


def dense_index(df: DataFrame, value: str, name: str = "idx", bound: int = SMALL_ROWS) -> DataFrame:
    """Distinct values of a column with their 0-based place in ascending order.

    Up to ``bound`` values are numbered on the driver and come back as a local relation (a calendar);
    more are numbered by the bucketed running count.
    """
    values = df.select(value).where(F.col(value).isNotNull()).distinct()
    head = values.limit(bound + 1).toArrow()
    if head.num_rows <= bound:
        ordered = head.sort_by(value)
        import pyarrow as pa

        ordered = ordered.append_column(name, pa.array(range(ordered.num_rows), pa.int32()))
        schema = T.StructType([*values.schema.fields, T.StructField(name, T.IntegerType())])
        return df.sparkSession.createDataFrame(ordered, schema)
    return value_positions(values, value).select(value, F.col("smaller").cast("int").alias(name))
