"""Sources: periodic snapshot files with declared schemas, encodings, XML payloads, drift reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.functions.columns import first_period_of


def read_snapshots(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType, encoding: str | Sequence[str] = "UTF-8",
                   period: str = "period", pattern: str = r"(\d{6})[^/]*$") -> DataFrame:
    """A1: CSV snapshots with a header, columns taken by name (missing ones become null), ``period`` = YYYYMM
    of the file name (the pattern is matched against the path). A file without one raises.

    Ids are declared as text: 25-digit codes and leading zeros survive. Each file is read by its own header.
    """
    files = read_csv_encoded(spark, paths, encoding, schema)
    return files.withColumn(period, first_period_of("_metadata.file_path", pattern)).drop("_metadata")


def read_csv_encoded(spark: SparkSession, paths: str | Sequence[str], encoding: str | Sequence[str] = "UTF-8",
                     schema: T.StructType | None = None) -> DataFrame:
    """A2: CSV in a given charset (``x-windows-949`` for Korean public data; needs
    ``spark.sql.legacy.javaCharsets=true``), or per file in the first of several that decodes it without replacement
    characters; a file that none decodes is an error with its name. With one charset such bytes become replacement characters.

    All columns are read as text by their header name and cast to the declared type. Files are grouped by
    charset and header, so neither the order nor the number of a file's columns matters.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([paths] if isinstance(paths, str) else list(paths))
    files = sorted(r[0] for r in listed.where(F.col("length") > 0).select("path").collect())  # names only
    charsets = [encoding] if isinstance(encoding, str) else list(encoding)
    groups: dict[tuple, list[str]] = {}
    for name, charset in _charset_of(spark, files, charsets).items():
        header = tuple(_reader(spark, charset).csv(name).columns)
        groups.setdefault((charset, header), []).append(name)
    parts = []
    for (charset, header), names in groups.items():
        raw = _reader(spark, charset).csv(names)
        if schema is None:
            parts.append(raw)
            continue
        columns = [
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in header else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
        parts.append(raw.select(*columns, F.col("_metadata")))
    if not parts:
        raise ValueError(f"no file with a header in {paths}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=schema is None)
    return out


def _reader(spark: SparkSession, charset: str):
    return spark.read.option("header", True).option("encoding", charset).option("quote", '"').option("escape", '"')


def _charset_of(spark: SparkSession, files: Sequence[str], charsets: Sequence[str]) -> dict[str, str]:
    """The first charset that decodes each file; one pass over the files still open for each charset but the only one."""
    if len(charsets) == 1:
        return dict.fromkeys(files, charsets[0])
    found: dict[str, str] = {}
    for charset in charsets:
        left = [f for f in files if f not in found]
        if not left:
            break
        lines = spark.read.option("encoding", charset).option("sep", "\u0001").option("quote", "").schema("line string").csv(left)
        bad = lines.where(F.contains("line", F.lit("\ufffd"))).select("_metadata.file_path").distinct()
        broken = {r[0] for r in bad.collect()}
        found.update((f, charset) for f in left if f not in broken and f.replace("file:///", "file:/") not in broken and f.replace("file:/", "file:///") not in broken)
    if missing := [f for f in files if f not in found]:
        raise ValueError(f"none of {list(charsets)} decodes {missing[0]}")
    return found


def header_columns(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Header of each file: (path, columns). One small read per file; only names reach the driver."""
    rows = [(p, spark.read.option("header", True).option("encoding", encoding).csv(p).columns) for p in paths]
    return spark.createDataFrame(rows, "path string, columns array<string>")


def schema_drift_report(headers: DataFrame) -> DataFrame:
    """A3: columns each file lacks or adds against the first file."""
    first = headers.agg(F.min_by("columns", "path")).scalar()
    compared = headers.withColumn("first", first)
    return compared.select(
        "path", F.sort_array(F.array_except("first", "columns")).alias("missing"),
        F.sort_array(F.array_except("columns", "first")).alias("extra"),
    )


def union_snapshots(dfs: Sequence[DataFrame]) -> DataFrame:
    """A4: rows of snapshot tables by column name; columns that one lacks are null there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def read_columns(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """A5: parquet with column projection (pruned in the scan)."""
    return spark.read.parquet(path).select(*cols)


def explode_xml_rows(df: DataFrame, payload: str, fields: Sequence[str], ok_code: str = "INFO-000") -> DataFrame:
    """Landed API pages (one XML text per row) to one row per ``<row>`` element, all fields as text.

    A page whose result code differs from ``ok_code`` raises.
    """
    inner = ", ".join(f"{f}: string" for f in fields)
    schema = f"struct<RESULT: struct<CODE: string>, row: array<struct<{inner}>>>"
    parsed = df.withColumn("_x", F.from_xml(payload, schema))
    code = F.col("_x.RESULT.CODE")
    rows = F.when(code == ok_code, F.col("_x.row")).otherwise(
        F.raise_error(F.concat(F.lit("page failed with "), F.coalesce(code, F.lit("no code")))))
    others = [c for c in df.columns if c != payload]
    return parsed.select(*others, F.explode(rows).alias("_r")).select(*others, *[F.col(f"_r.{f}").alias(f) for f in fields])


def range_overlap(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Smallest, largest and number of distinct periods on both sides, and the shared range (null if none)."""

    def summary(df: DataFrame, side: str) -> DataFrame:
        return df.agg(
            F.min(col).alias(f"{side}_from"), F.max(col).alias(f"{side}_to"), F.count_distinct(col).alias(f"{side}_periods"))

    left, right = summary(a, "a"), summary(b, "b")
    both = left.withColumns({c: right.select(c).scalar() for c in right.columns})
    low, high = F.greatest("a_from", "b_from"), F.least("a_to", "b_to")
    return both.withColumns({"shared_from": F.when(low <= high, low), "shared_to": F.when(low <= high, high)})
