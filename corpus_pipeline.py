"""From raw documents to sharded training data: each stage applies one operator to all that is left.

Stages take (spark, docs, sf_dir). All but the last return the columns of ``docs``; the last returns the
documents' columns but the text, with their shard, place in the shard and the shard they would have with one
shard more. Columns of the input that are named like one of those give way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm import decontaminate, jaccard, mixing, quality, sharding
from tallyframe.session import cut_lineage
from tallyframe.sources.readers import read_parquet

SHARDS = 8
NEAR_WORDS, NEAR_PERCENT = 5, 80  # what links near copies here; op4's own query has other values
SHARD_COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the full rule policy keeps."""
    return quality.passing(docs, quality.STRICT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest doc_id; rows are told apart by doc_id and text."""
    return jaccard.one_text_per_group(docs, width=NEAR_WORDS, percent=NEAR_PERCENT)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose own text has no passage of a benchmark item."""
    return decontaminate.clean_documents(docs, read_parquet(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated, once or not at all."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document belongs; copies of a document share a shard. Texts need not move for it."""
    keep = [c for c in docs.columns if c not in ("doc_id", "text", *SHARD_COLUMNS)]
    return sharding.assign_shards(docs, [1.0] * SHARDS, keep=keep)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]

# Links among word sets have no practical SQL: the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_parquet(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
