"""Quality scores by Bradley-Terry ranking of preference pairs."""

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from sessionrank.llm.common import fresh, labelled, stage, tally, utf8
from sessionrank.llm.toxicity import DIGIT, LETTER, MARK, PRINT, SPACE, UPPER, featured
from sessionrank.operators.dataset import ordered_ids

PAIRS = 40_000
EXACT_ROWS = 100_000
ACCEPT = 0.7


class Shape:
    """What a text looks like: shares of kinds of characters, repetition, lengths."""

    def features(self, texts: pa.Array) -> np.ndarray:
        data, cut = utf8(texts)
        n = len(cut) - 1
        size = np.maximum(1, np.diff(cut)).astype(np.float64)
        up, sign = UPPER[data], PRINT[data]
        twin, tail = np.zeros(len(data), bool), np.zeros(len(data), bool)
        if len(data) > 1:
            twin[1:] = up[1:] & up[:-1]
            tail[1:] = sign[1:] & (data[1:] == data[:-1])
            first = cut[:-1][np.diff(cut) > 0]
            twin[first] = tail[first] = False  # the character before is another text's
        kinds = (up, twin, MARK[data], sign & ~MARK[data], tail, DIGIT[data], LETTER[data], SPACE[data], data == 10, data == 124, data == 33)
        out = np.zeros((n, len(kinds) + 10))
        for k, mask in enumerate(kinds):
            out[:, k] = tally(mask, cut) / size
        flat = data.tobytes()
        for i in range(n):
            words = flat[cut[i] : cut[i + 1]].split()
            w = len(words)
            if not w:
                continue
            distinct = set(words)
            repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
            lines = flat[cut[i] : cut[i + 1]].split(b"\n")
            length = len(b"".join(words)) / w
            out[i, len(kinds) :] = (
                len(distinct) / w,
                min(1.0, len(distinct) / w**0.8),
                repeats / w,
                min(1.0, 10 * repeats / w),
                min(length, 20.0),
                np.log1p(w),
                min(1.0, w / 50),
                len(set(lines)) / len(lines),
                len(max(words, key=len)) / (1 + length),
                1.0,
            )
        return out


def scored(docs: DataFrame, train: DataFrame, labels: DataFrame, rows: int | None = None, pairs: int = PAIRS, accept: float = ACCEPT, name: str = "quality") -> DataFrame:
    """Adds a score from 0 to 1, higher for texts that are likelier to have ``quality`` = 1.

    Learned from ``labels`` (doc_id, quality) and the texts that ``train`` has for them, all of them or
    ``rows`` at most, on pairs of a better and a worse text: each labelled text is in one at least (eight pairs for each
    row up to ``pairs``, and two for each row of larger tables).
    The probability that the better one is preferred is the logistic of the difference of
    their scores, linear in the features. The quantile of all labelled scores at the share of label 0
    is the threshold (beyond ``EXACT_ROWS`` to a millionth of the rows), and gets the value ``accept`` on the logistic scale of the result.

    Null and empty texts are scored as texts without any feature. Where the sample has one
    class only, the score is the smoothed share of label 1; without labels 0. Repeated rows
    and columns of any name pass through; ``name`` gets underscores where the table has it; no
    rows give no rows.
    """
    spark, name = docs.sparkSession, fresh(docs, name)
    run = featured(Shape())
    known = stage(labelled(train, labels, "quality", rows).select("label", "h", run("text").alias("x")))
    n, pos = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not pos or pos == n:
        return docs.withColumn(name, F.lit((pos + 1) / (n + 2) if n else 0.0))

    def placed(label: int, number: str, name: str) -> DataFrame:
        own = known.where(F.col("label") == label)
        return own.join(ordered_ids(own, "h", number), "h").select(number, F.col("x").alias(name))

    good, poor = placed(1, "i", "better"), placed(0, "j", "worse")
    turn, half = F.col("id") % 2, F.floor(F.col("id") / 2)
    # the half of the pairs goes through the better texts, the other through the worse ones
    drawn = spark.range(max(2 * n, min(pairs, 8 * n))).select(
        F.when(turn == 0, half % pos).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(pos))).alias("i"),
        F.when(turn == 1, half % (n - pos)).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n - pos))).alias("j"),
        (half % 2).alias("turn"),
    )
    gap = F.zip_with("better", "worse", lambda a, b: F.when(F.col("turn") == 1, a - b).otherwise(b - a))
    duels = stage(drawn.join(good, "i").join(poor, "j").select(F.col("turn").cast("double").alias("label"), gap.alias("x")))
    duels = duels.select("label", array_to_vector("x").alias("features"))
    model = LogisticRegression(fitIntercept=False, regParam=0.001, maxIter=100).fit(duels)
    weights = [float(w) for w in model.coefficients]

    def value(x):
        return F.aggregate(F.zip_with(x, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    share = min(1.0, max(0.0, (n - pos - 0.5) / (n - 1)))
    raw = known.select(value("x").alias("v"))
    middle = F.percentile("v", F.lit(share)) if n <= EXACT_ROWS else F.percentile_approx("v", F.lit(share), F.lit(1_000_000))
    cut, spread = raw.agg(middle, F.stddev("v")).first()
    slope = 2.0 / spread if spread else 1.0
    base = float(np.log(accept / (1 - accept)))
    margin = (value(run("text")) - cut) * slope + base
    return docs.withColumn(name, 1 / (1 + F.exp(-margin)))


def accepted(docs: DataFrame, train: DataFrame, labels: DataFrame, accept: float = ACCEPT, **options) -> DataFrame:
    """The documents at or above the threshold, with their own columns."""
    found = scored(docs, train, labels, accept=accept, **options)
    name = found.columns[-1]
    return found.where(F.col(name) >= accept).drop(name)
