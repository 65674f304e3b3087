"""A corpus pipeline of five stages over the table documents.

1. toxicity: texts that the string-kernel machine rejects go; the rest stay as they are.
2. near_duplicates: of every class of near copies (five-word shingles, similarity 0.8) one document stays.
3. private_data: every span of personal data is replaced by its kind.
4. mixture: sources are brought to their target weights; a row is repeated or left out by the seeded mix.
5. sentencepiece: every document is encoded, and decoded again.

Each stage is written as Parquet into the shared folder that ``spark.checkpoint.dir`` names and read
again by the next one, so a lost executor never costs more than a stage. All but the last return the
columns of documents. Null texts pass through as such; rows without an id are never dropped as near
copies; an empty table gives an empty result.

The expected rows can't be written in SQL (trained machines, tokenizers): ``tests/llm`` compares every
stage with a brute-force version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepjudge.llm import jaccard, mixing, private, sentencepiece_table, toxicity
from stepjudge.llm.common import free_name, learnable, table
from stepjudge.session import checkpoint_dir

ORACLE_SQL = None


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what scores below the rejection threshold. Labels are learned from the original documents."""
    machine = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(learnable("doc_id", 3, 1)))
    score = free_name(docs, "_score")
    return docs.withColumn(score, toxicity.score("text", machine)).where(F.col(score) < toxicity.TOXIC).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def private_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return private.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, the ids and the decoded text."""
    from stepjudge.llm.queries import piece_model

    return sentencepiece_table.encoded(docs, piece_model())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("private_data", private_data_stage),
    ("mixture", mixture_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
