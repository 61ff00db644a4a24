"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept and returns the columns of documents, the last one packed
pieces. run() writes each stage's result to the shared folder and reads it again for the next.
Stages that read texts have the session move them in small batches, as all of them share executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, neardup_text, packing, pii, toxicity
from .common import id_crc, read, small_batches, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model of op1 gives 0.7 or more; its labels are those whose crc32(doc_id) mod 3 is not 1."""
    small_batches(spark)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), F.pmod(id_crc("doc_id"), F.lit(3)) != 1)
    return toxicity.without_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document, or the same one earlier, has within the few edits of linededup."""
    small_batches(spark)
    return linededup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of smallest id."""
    return neardup_text.keep_one(docs)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With personal data replaced by its kind."""
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("minhash near-dedup", drop_near_copies),
    ("pii", mask_personal),
    ("packing", pack),
]

#: SQL can express neither the models nor the tokenizer; tests/llm/test_stages.py holds run() to the stages' own work done in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
