"""Small helpers around the session: tables, scalars, bounded side inputs, shared scratch space."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SMALL_ROWS = 10_000


def session(app: str = "lotline", cores: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the submitter's settings win."""
    cores = cores or str(os.cpu_count() or 8)
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once per process."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = f"{root}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or the one set on the context.

    Only on a local master, where every task sees the same disk, a temporary folder is made if none is named.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    given = context._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    context.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_root(spark)}/lotline-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write a result that several branches need to the shared folder once and read it back."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame, bound: int = SMALL_ROWS) -> DataFrame:
    """Side input of checked size: at most ``bound`` rows become a local relation, so that Catalyst
    knows the size and broadcasts it. A larger one comes back unchanged and is joined by shuffle."""
    rows = df.limit(bound + 1).toArrow()
    if rows.num_rows > bound:
        return df
    return df.sparkSession.createDataFrame(rows, df.schema)


def scalar(df: DataFrame, aggregate: Column) -> Column:
    """A one-row aggregate of ``df`` as an uncorrelated scalar subquery."""
    return df.agg(aggregate).scalar()


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which null keys meet each other (group keys may be null)."""
    if not keys:
        raise ValueError("keyed_join needs at least one key")
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = None
    for key in keys:
        test = left[key].eqNullSafe(renamed[f"__r_{key}"])
        condition = test if condition is None else condition & test
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    if how in ("full", "outer", "right"):
        joined = joined.select(
            *[F.coalesce(left[k], renamed[f"__r_{k}"]).alias(k) for k in keys],
            *[left[c] for c in left.columns if c not in keys],
            *[renamed[c] for c in right.columns if c not in keys],
        )
        return joined
    return joined.drop(*[f"__r_{k}" for k in keys])


def dealt_join(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], size: str, how: str = "inner", pieces: int = 256) -> DataFrame:
    """Join ``rows`` to ``keyed``, which has one row for each non-null key and in ``size`` the number of rows that it meets.

    Keys with more than one in ``pieces`` of all rows, so fewer than ``pieces`` keys, are broadcast with their number of shares; their
    rows are dealt to the shares in turn, and ``keyed`` gets a row for each. Both inputs should be read from files.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    shares = F.ceil(F.col(size) * pieces / F.lit(max(1, total))).cast("int")
    hot = F.col(size) * pieces > total
    counts = keyed.where(hot).select(*keys, shares.alias("__shares"))
    turn = F.pmod(F.monotonically_increasing_id(), F.coalesce("__shares", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(counts), list(keys), "left").withColumn("__share", turn).drop("__shares")
    spread = keyed.withColumn("__share", F.explode(F.sequence(F.lit(0), F.when(hot, shares - 1).otherwise(0))))
    return dealt.join(spread, [*keys, "__share"], how).drop("__share")
