"""Reading event logs and item vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionrank.functions import vectors as V
from sessionrank.schema import RAW_EVENTS

CLOCKS = {"ms": F.timestamp_millis, "s": F.timestamp_seconds}


def load_events(
    spark: SparkSession, train_path: str, test_path: str, test_split: str = "valid", ts_unit: str = "ms"
) -> DataFrame:
    """Read two folders of raw Parquet chunks as one log with ``split`` and a timestamp."""
    clock = CLOCKS[ts_unit]

    def part(path: str, split: str) -> DataFrame:
        raw = spark.read.schema(RAW_EVENTS).parquet(path)
        return raw.withColumn("ts", clock("ts")).withColumn("split", F.lit(split))

    return part(train_path, "train").unionByName(part(test_path, test_split))


def map_type(df: DataFrame, col: str, mapping: dict) -> DataFrame:
    """Replace codes by names, or names by codes; values outside the mapping become NULL."""
    value = None
    for key, new in mapping.items():
        hit = F.col(col) == F.lit(key)
        value = F.when(hit, F.lit(new)) if value is None else value.when(hit, F.lit(new))
    return df.withColumn(col, value)


def vectors(df: DataFrame, id_col: str, vec_col: str, normalise: bool = True) -> DataFrame:
    """Rows of an embedding matrix as (aid, vector), at unit length if asked."""
    vec = F.col(vec_col).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias("aid"), vec.alias("vector"))
    return out.withColumn("vector", V.unit("vector")) if normalise else out
