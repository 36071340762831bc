"""Helpers shared by the operators of this package."""

import functools
import pickle
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from sessionrank.settings import stage

__all__ = ["batched", "bounded", "carried", "fresh", "labelled", "read", "stage", "tally", "utf8"]

BATCH_ROWS = 1_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def batched(step):
    """Texts may be long: Arrow batches of ``BATCH_ROWS`` rows at most, in this session from now on (its plans run later)."""

    @functools.wraps(step)
    def run(spark: SparkSession, *rest) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        return step(spark, *rest)

    return run


def carried(spark: SparkSession, value):
    """A function that gives ``value`` in a task, which opens it once.

    Broadcasts pickle classes by name, which workers without this package do not know; this is pickled by value.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    opened: list = []

    def get():
        if not opened:
            opened.append(pickle.loads(sent.value))
        return opened[0]

    return get


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it where the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; it stops counting beyond."""
    return df.limit(rows + 1).count() <= rows


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the n + 1 limits of its texts; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, limits, data = texts.buffers()
    cut = np.frombuffer(limits, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or cut[-1] == cut[0]:
        return np.zeros(0, np.uint8), cut - cut[0]
    return np.frombuffer(data, np.uint8)[cut[0] : cut[-1]], cut - cut[0]


def forget_words() -> None:
    """Free the words that a token count of another stage has left in this process."""
    sys.modules.pop("_ids_of_words", None)


def tally(mask: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """How often ``mask`` holds within each of the texts."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[cut[1:]] - total[cut[:-1]]).astype(np.float64)


def labelled(docs: DataFrame, labels: DataFrame, target: str, rows: int | None = None) -> DataFrame:
    """(text, label, h): the labelled documents, or a bounded sample of at most ``rows`` of them.

    Of a sample, the ids with the smallest hash are taken. Null ids and null labels are left out, of
    several labels of an id the mean is rounded, of several texts the first in order is read,
    and ids without a document or with a null text give nothing.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).groupBy("doc_id")
    few = one.agg(F.round(F.avg(target)).cast("int").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    if rows is not None:
        few = F.broadcast(few.orderBy("h", "doc_id").limit(rows))
    texts = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id")
    return texts.agg(F.min("text").alias("text"), F.first("label").alias("label"), F.first("h").alias("h")).where("text is not null").drop("doc_id")
