"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis)."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sessionrank.operators.order import in_order
from sessionrank.llm.common import bounded, fresh, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
FEW_SOURCES = 50_000
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Share of letters and white space among the characters, 0.1 at least."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]", ""))
    return F.greatest(F.lit(0.1), F.coalesce(kept / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))


def _keyed(docs: DataFrame, weight: Column | None, seed: str, *carry: str) -> DataFrame:
    """doc_id, source, size, key and tie of every row: what decides on it."""
    text = F.col("text")
    tie = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    u = (F.conv(F.substring(tie, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    return docs.select(
        "doc_id",
        "source",
        word_count(text).alias("size"),
        (-F.log(u) / (quality_weight(text) if weight is None else weight)).alias("key"),
        tie.alias("tie"),
        *carry,
    )


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of the total by weight, in code point order.

    A target above ``cap`` times its source stops there and the rest is shared anew. With the
    sources ordered by the level at which they stop, the level of those that do not stop is
    what remains over the weights that remain, at the first source that reaches it.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    parts = F.array(*[F.lit(int(w)) for w in weights])
    weighed = sources.withColumn("weight", F.element_at(parts, (place % len(weights) + 1).cast("int")).cast("long"))
    limit = F.col("source_size") * cap
    order = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rest = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weights_left"),
        F.row_number().over(order).alias("at"),
    )
    holds = limit * F.col("weights_left") >= F.col("weight") * F.col("words_left")
    level = F.min(F.when(holds, F.struct("at", "words_left", "weights_left"))).over(everything)
    shared = F.col("weight") * F.col("level.words_left") / F.col("level.weights_left")
    return rest.withColumn("level", level).select(
        *sources.columns,
        F.when(F.col("at") < F.col("level.at"), limit.cast("double")).otherwise(F.coalesce(shared, F.lit(0.0))).alias("target"),
    )


def plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, weight: Column | None = None, seed: str = SEED):
    """Keys of all rows, and for each source its size, target, whole epochs and where its last epoch stops."""
    rows = stage(_keyed(docs, weight, seed))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = stage(
        targets(sums, weights, cap)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.ceil(F.sqrt("n")))
        .withColumnRenamed("source", "name")
    )
    sources = F.broadcast(sources) if bounded(sources, FEW_SOURCES) else sources
    in_bucket = _bucketed(rows, sources)
    piles = in_bucket.groupBy("name", "bucket").agg(F.sum("size").alias("words"), F.first("part").alias("part"))
    w = Window.partitionBy("name").orderBy("bucket")
    piles = piles.withColumn("before", F.sum("words").over(w) - F.col("words"))
    # the bucket in which the words of the last epoch run out
    last = stage(
        piles.where("before < part")
        .groupBy("name")
        .agg(F.max(F.struct("bucket", "before")).alias("x"))
        .select("name", F.col("x.bucket").alias("stop"), F.col("x.before").alias("before"))
    )
    last = F.broadcast(last) if bounded(last, FEW_SOURCES) else last
    edge = in_bucket.join(last.withColumnRenamed("name", "name2"), F.expr("name <=> name2 and bucket = stop"))
    peers = edge.groupBy("name", "key", "tie").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("part").alias("part"))
    # where low weights fill the last bucket it is ordered in stretches
    peers = stage(peers.withColumn("pile", F.coalesce(F.concat(F.lit("="), "name"), F.lit(""))))
    peers = in_order(peers, ["pile"], "key", ["tie"], want={"run": "running"}, flag="size")
    cuts = (
        peers.withColumn("upto", F.col("before") + F.col("run") - F.col("size") / 2)
        .where("upto <= part")
        .groupBy("name")
        .agg(F.max(F.struct("key", "tie")).alias("cut"))
        .withColumnRenamed("name", "name3")
    )
    full = (
        sources.join(last.withColumnRenamed("name", "name2"), F.expr("name <=> name2"), "left")
        .join(cuts, F.expr("name <=> name3"), "left")
        .select("name", "source_size", "target", "epochs", "buckets", "stop", "cut")
    )
    full = stage(full)
    return rows, F.broadcast(full) if bounded(full, FEW_SOURCES) else full


def _bucketed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source and the bucket of their key; buckets are in key order."""
    at = F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets"))
    return rows.join(sources, F.expr("source <=> name")).withColumn("bucket", at)


def _copies(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``copies``: the whole epochs, and one more for keys before the cut."""
    more = F.coalesce(F.expr("bucket < stop or (bucket = stop and struct(key, tie) <= cut)"), F.lit(False))
    return _bucketed(rows, sources).withColumn("copies", (F.col("epochs") + more.cast("long")).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source, source_size, target, copies, taken.

    ``docs`` has doc_id, text and source. Sources in code point order (null last) have the
    given weights in turn and share as many words as there are; a target stops at ``cap``
    times its source. A document's key is -ln(u) / weight, with u from the MD5 of doc_id and
    text, and ``weight`` a quality (the share of letters unless given). Every document is
    taken once for each whole epoch in the target; the rest goes to the smallest keys until
    the words run out, to the nearest document.

    Keys are dealt into sqrt(n) buckets a source, about even for weights near 1; sums of buckets find the bucket with the
    cut, and only its rows are ordered. Low weights crowd the last bucket: one with very many rows is ordered in
    stretches of its keys, in several tasks.
    Null texts have size 0. Rows equal in doc_id and text have one key and are taken alike.
    No rows give no rows; a source without words has target 0. Other columns are not read.
    """
    rows, sources = plan(docs, weights, cap, weight, seed)
    return _copies(rows, sources).select(
        "doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """The documents themselves, each as often as ``mix`` takes it, with the columns of ``docs``."""
    _, sources = plan(docs, weights, cap, weight, seed)
    keep = fresh(docs, "row_kept")
    packed = docs.withColumn(keep, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    taken = _copies(_keyed(packed, weight, seed, keep), sources).where("copies > 0")
    return taken.select(keep, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(f"{keep}.*")
