"""The corpus pipeline: reject toxic documents, drop exact and near copies, mix the
sources to their target weights, and encode what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of documents, extra ones and such with clashing names included. An empty table gives an
empty one in every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wareweave.llm import bpe, exact_dedup, mixing, simhash, toxicity
from wareweave.llm.common import shared_folder, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine predicts not toxic.

    Every text is read whole; null and blank ones have no terms and stay, as nulls and
    blanks; repeated rows are judged alike; a score of exactly 0.5 counts as toxic.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest, then first, document of equal texts.

    Null, empty and white-space texts are equal; texts of any length are hashed whole;
    of rows that tie (repeated rows) one stays; a null doc_id comes last.
    """
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates: the smallest doc_id.

    Texts without words have fingerprint zero and form a group; a null doc_id comes last;
    rows that share a doc_id are judged apart by their texts, ties go by the hash of all
    columns, and rows equal in every column count as one.
    """
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document as often as its source's target asks for.

    A null source is a source; null texts have size 0 and may be taken, adding nothing;
    repeated rows are sampled as rows, each up to three times.
    """
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded bytes.

    A null text counts as empty and has no ids; texts of any length are encoded whole;
    repeated rows give a row each.
    """
    return bpe.digests(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level bpe", encode),
]
#: The first stage is a fitted classifier, which SQL can't express.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table lies in the shared checkpoint folder.

    A stage's table is removed when the next one is written; the last one, which the
    result reads, stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
