"""A corpus from documents: toxic texts out, one of each near-duplicate group, no benchmark text, mixed, as token files."""

from pyspark.sql import DataFrame, SparkSession

from sessionrank.llm import decontaminate, mixing, simhash, tokenfile, toxicity
from sessionrank.llm.common import batched, read, stage
from sessionrank.llm.entries import dealt
from sessionrank.settings import shared_dir


@batched
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below 0.5.

    Null and empty texts have the score of a text without features and stay unless that is 0.5 or more; repeated rows are decided alike; rows without doc_id
    are scored like others and give no label. Without usable labels nothing goes. No rows give no rows; extra columns stay.
    """
    return toxicity.mild(docs, docs, read(spark, sf_dir, "labels").where(~dealt(5, 0)))


@batched
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id.

    Null, empty and wordless texts are copies of each other. Of repeated rows one stays; rows without doc_id stay
    only as the one of a group that has no id. No rows give no rows; extra columns stay.
    """
    return simhash.one_each(docs)


@batched
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows and rows without doc_id are decided by their text. An
    empty benchmark takes nothing away. No rows give no rows; extra columns stay.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


@batched
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: whole epochs of its source, and a weighted choice for the rest.

    The null source is one of the sources, the last. Texts without words have size 0: they are taken with the epochs of their source, and
    not at all where it has no words. Rows equal in doc_id and text are taken alike. No rows give no rows; extra columns stay.
    """
    return mixing.mixed(docs)


@batched
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row, read back from the written token files.

    Null and empty texts have the end id alone. Rows without doc_id come first; repeated rows each have their ids, in the order
    of their text. No rows give no rows; other columns are not read.
    """
    path = shared_dir(spark)
    tokenfile.write(docs, path)
    return tokenfile.read_back(spark, path)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing", mixed),
    ("token files", token_files),
]

#: XXH64 fingerprints, trained trees and the tokenizer have no SQL form; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each on what its predecessor has kept; the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs)
    return docs
