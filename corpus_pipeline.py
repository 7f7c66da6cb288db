"""A training corpus in five stages; each works on all that the one before it kept, written as Parquet and read again.

1. quality: documents that fail the quality policy go.
2. near_duplicates: of each group of near copies (SimHash) one document stays.
3. decontaminate: documents with a benchmark passage go.
4. mix: sources are brought to their target weights; a document stands in the result as often as the mix takes it.
5. tokens: token ids go to binary files; the result is what a reader of the files finds, one row a document.

Empty input stays empty; null texts are empty texts, which stage 1 rejects; columns beyond those of documents are kept up to stage 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from resolva.llm import decontaminate, mixing, quality, simhash, token_store
from resolva.llm.common import stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.query(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("tokens", tokens_stage),
]

#: Fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = stage(docs, f"pipeline-{name}")
    return docs
