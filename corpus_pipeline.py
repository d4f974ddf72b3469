"""From raw documents to token ids: five stages, each over all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import decontaminate, language, mixing, neardup, tokens
from ferrule.llm._work import Workspace, read


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language."""
    return language.keep_identified(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity 0.8."""
    return neardup.keep_one(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, read back from the shards."""
    return tokens.encode(docs, tokens.tokenizer_path())


STAGES = [("language_id", identified), ("near_dedup", deduplicated), ("decontamination", decontaminated), ("mixing", mixed), ("token_ids", encoded)]
ORACLE_SQL = None  # no stage but the fourth is within SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that the stages keep: doc_id, start, n_tokens, ids_crc32.

    Rows with null or letterless texts go at the first stage; null doc_id, source and lang stay as they are. Equal
    rows are near-duplicates of each other, so one stays, the least doc_id (null first); the mix may repeat it. An
    empty table, or one of which nothing stays, gives an empty result. Other columns go along up to the last stage.
    """
    docs, work = read(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
