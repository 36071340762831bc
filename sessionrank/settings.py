"""Session settings read at plan time."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS_KEY = "sessionrank.hotRows"
CELL_ITEMS_KEY = "sessionrank.cellItems"


def hot_rows(spark: SparkSession) -> int:
    """A key with more rows than this is split over several tasks."""
    return int(spark.conf.get(HOT_ROWS_KEY, "10000000"))


def cell_items(spark: SparkSession) -> int:
    """A (session, time bucket) with more distinct items than this is joined in slices."""
    return int(spark.conf.get(CELL_ITEMS_KEY, "20000"))


_ROOTS: dict[tuple[str, str], str] = {}
#: Folders handed out inside the innermost ``apart``.
_OWN: ContextVar[list[str] | None] = ContextVar("_OWN", default=None)


def shared_dir(spark: SparkSession) -> str:
    """New folder for intermediate tables, under the cluster's shared checkpoint folder.

    The application's own folder there is removed when it ends. A cluster must name a shared
    folder; only a local master may do without, and takes a temporary one.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    key = (context.applicationId, base or "")
    if key not in _ROOTS:
        if not base and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{(base or tempfile.mkdtemp(prefix='sessionrank-')).rstrip('/')}/{context.applicationId}-{uuid.uuid4().hex}"
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS[key] = root
    path = f"{_ROOTS[key]}/{uuid.uuid4().hex}"
    if (own := _OWN.get()) is not None:
        own.append(path)
    return path


def stage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write an intermediate result once and read it back.

    The written table cuts the lineage, survives the loss of executors, and is scanned
    with column pruning by each of its users. ``codec`` is Spark's default if not given.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``stage`` as a table bucketed and sorted on ``by``, so that joins on these columns need no exchange.

    There are as many buckets as shuffle partitions, and one file in each, packed by zstd. The table's
    files lie in the shared folder; its name leaves the catalogue once it has been read.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"stage_{uuid.uuid4().hex}"
    out = df.repartition(n, *by).write.format("parquet").option("path", shared_dir(spark)).option("compression", "zstd")
    out.bucketBy(n, *by).sortBy(*by).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def apart(make: Callable[[], DataFrame], write: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """Write what ``make`` gives, and delete the tables that were written on the way to it.

    Its result must be the only reader of these tables, and ``write`` must have read it when it returns.
    Spark deletes the files of a shuffle once the driver's JVM has collected the query, so it is asked to.
    """
    own: list[str] = []
    token = _OWN.set(own)
    try:
        made = make()
    finally:
        _OWN.reset(token)
    out = write(made)
    for path in own:
        remove(out.sparkSession, path)
    del made
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def both_dealt(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two tables that both grow with the log: dealt by the keys, never broadcast.

    Spark broadcasts a written table whose file is small, and a file of repeated values may be a
    hundredth of its rows in memory, all of which would pass through the driver.
    """
    return left.hint("merge").join(right, list(on), how)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that its maker has read for the last time."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the operators are designed for; sizes are left to the cluster."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
