"""Corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes its result as
Parquet below the shared checkpoint folder and reads it again for the next one.  All stages but the last
return the columns of documents.

1. toxicity: documents scored 0.7 or more go (model fitted on the labels' training folds).
2. near_duplicates: one document of each component of 4-word-shingle Jaccard links >= 0.85 stays.
3. decontamination: documents that hold half of a benchmark item go.
4. secrets: found spans are masked; every document stays.
5. packing: token sequences of at most 2048 ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from protolens.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from protolens.llm.common import table, written
from protolens.llm.queries import tokenizer_path

#: no SQL form: a fitted model, tiling, compressed sizes and a tokenizer are among the stages
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, length_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
