"""Writing result tables and submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def save(
    df: DataFrame, name: str, cluster_by: Sequence[str] = ("session",), buckets: int | None = None, path: str | None = None
) -> None:
    """Create or replace a table clustered by some columns.

    With ``buckets`` the table is bucketed, so later joins on the columns need no shuffle.
    Without, files are range-clustered: min/max statistics then prune scans on the first
    column, and a key with very many rows is spread over several files.
    """
    cols = list(cluster_by)
    writer = df if buckets else _clustered(df, cols)
    out = writer.write.mode("overwrite").format("parquet")
    if buckets:
        out = out.bucketBy(buckets, *cols).sortBy(*cols)
    if path is not None:
        out = out.option("path", path)
    out.saveAsTable(name)


def save_files(df: DataFrame, path: str, cluster_by: Sequence[str] = ("session",)) -> None:
    """The same as ``save`` for a plain folder of Parquet files."""
    _clustered(df, list(cluster_by)).write.mode("overwrite").parquet(path)


def _clustered(df: DataFrame, cols: list[str]) -> DataFrame:
    # The row hash as last range column lets the boundaries fall inside a large key.
    return df.repartitionByRange(*cols, F.xxhash64(*df.columns)).sortWithinPartitions(*cols)


def write_submission(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write ``session_type, labels`` as CSV with a header or as Parquet."""
    out = df.select("session_type", "labels").write.mode("overwrite")
    if fmt == "csv":
        out.option("header", True).csv(path)
    elif fmt == "parquet":
        out.parquet(path)
    else:
        raise ValueError(f"unknown submission format: {fmt}")
