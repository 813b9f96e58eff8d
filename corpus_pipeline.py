"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept: the quality
classifier drops what it rejects, near-duplicate classes keep their first document, documents that
contain a benchmark item go, personal data is replaced, and what is left is packed.

Defined results: a null text is judged as an empty one, is near to nothing, holds no item and no span, and is packed as
the end id alone; rows without a doc_id are judged and packed each on its own; rows that repeat an id and its
text stay once from the second stage on; of texts that tie the least doc_id stays; an empty table gives no
row; other columns of documents are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallscope.functions.tables import dropped, written
from stallscope.llm import dart_minhash, decontamination, packing, personal_data, quality
from stallscope.llm.common import table


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the classifier takes for good; labels that are null or contradict each other teach nothing."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the least doc_id of each class; rows without an id or a word stay."""
    return dart_minhash.without_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of documents in which no item of the benchmark is contained; rows without an id stay."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, spans of personal data replaced by their kind, and n_chars with them."""
    return personal_data.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of 2048 ids; an empty text is the end id."""
    pieces = packing.pack_documents(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality", good_text),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii", redact),
    ("pack", pack),
]
# Classifier, signatures and packing are not expressible in SQL; brute-force tests stand in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        dropped(before)
    return docs
