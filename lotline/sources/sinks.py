"""Sinks: partitioned panels, CSV reports, nested JSON documents, GeoJSON features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.runtime import keyed_join, pinned


def write_panel(df: DataFrame, path: str, partition_by: Sequence[str] = ("period",), mode: str = "errorifexists") -> None:
    """Parquet by period. Corrections go to a new path: a table is never overwritten while it is read."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def dealt_by(df: DataFrame, by: str, rows: int = 1_000_000, least: int = 8) -> DataFrame:
    """Rows ready for a partitioned write: tasks hold about ``rows`` rows next to each other in ``by``, a large value being many tasks,
    since the writer sorts what a task holds. ``df`` is read twice and should be read from files."""
    parts = max(least, -(-df.count() // rows))
    return df.repartitionByRange(parts, by, F.xxhash64(*df.columns))


def write_report(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header, UTF-8 (no byte-order mark: every reader here takes UTF-8)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_area_documents(df: DataFrame, area: str, path: str, max_records: int = 100_000, mode: str = "errorifexists") -> None:
    """JSON lines per district folder. A district of more than ``max_records`` rows is dealt to as many tasks as it fills files, by a
    hash of the whole row, so a task never holds more of it than a file or so."""
    parts = F.ceil(F.col("__n") / max_records).cast("int").alias("__parts")
    big = pinned(df.groupBy(area).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_records).select(area, parts))
    salt = F.pmod(F.xxhash64(*df.columns), F.coalesce("__parts", F.lit(1)))
    dealt = keyed_join(df, big, [area], "left").withColumn("__salt", salt).repartition(F.col(area), F.col("__salt"))
    dealt.select(*df.columns).write.mode(mode).option("maxRecordsPerFile", max_records).partitionBy(area).json(path)


def profile_document(profile: DataFrame, variable: str, fields: Sequence[str], header: dict[str, Column]) -> DataFrame:
    """One JSON document: header values and, per variable, the list of its bins (a report-sized table)."""
    bins = F.array_sort(F.collect_list(F.struct(*fields))).alias("bins")
    per = profile.groupBy(variable).agg(bins)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(variable), F.col("bins")))))
    return per.agg(F.to_json(F.struct(*[c.alias(n) for n, c in header.items()], entries.alias("variables"))).alias("document"))


def geojson_features(polygons: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """A10: one GeoJSON feature text per polygon; the ring is closed by its first corner."""
    corner = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    closed = F.concat(corner, F.slice(corner, 1, 1))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*attrs).alias("properties"))
    return polygons.select(*attrs, F.to_json(feature).alias("feature"))
