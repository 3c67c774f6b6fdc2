"""A training-data pipeline: five stages over the documents table, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandtally.llm import content_sort, ngram_join, packing, pii, quality_rules
from strandtally.llm.shared import new_path

#: The pipeline's near-duplicates: five words, a similarity of 0.8.
NEAR = ngram_join.JoinRules(size=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that pass the quality rules. Null and empty texts go; null language or source is a group of its own;
    repeated rows are judged one by one; an empty table stays empty. Further columns are kept, whatever their names."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id. Null counts as empty; a null doc_id stays only if there is no
    other; of rows equal in both, any one stays. An empty table stays empty; further columns are kept."""
    return content_sort.distinct_rows(docs, keep="smallest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the one with the smallest doc_id. Null texts and such without words all stay; of rows equal in
    doc_id and text one stays; a null doc_id stays only if its group has no other. An empty table stays empty."""
    return ngram_join.distinct_rows(docs, NEAR)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by tags, one for spans that overlap; n_chars follows. A null text stays null; repeated rows
    and further columns are kept; an empty table stays empty."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: the pieces of all texts with their ids and places. A null text is the end id alone; repeated rows
    are packed as rows of their own; an empty table gives no pieces; only doc_id and text are read."""
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("PII", private), ("best-fit packing", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
