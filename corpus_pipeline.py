"""The corpus pipeline over documents, in stages that each call one operator of quarry.llm.

Each stage gets all that its predecessor kept, read again from Parquet in the
shared folder, and its decision takes effect: documents that the quality
classifier rejects go, then the later copies of equal texts, all but one document
of each group of near duplicates (five-word shingles, a similarity of 0.8 or
more), and documents that hold a benchmark passage. The last stage tokenises what
is left. Null texts count as empty; an empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, quality
from quarry.llm.decontaminate import drop_contaminated
from quarry.llm.exact_dedup import drop_duplicates
from quarry.llm.shared import materialise
from quarry.llm.simhash import drop_near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select_good(docs, quality.train(docs, labels))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return bpe.encode(docs, vocabulary, digests=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("BPE encoding", tokenize_stage),
]
ORACLE_SQL = None  # a trained classifier, a tokenizer and covering hashes are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
