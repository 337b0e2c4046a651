"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import ann, chat, merkle, neardup, packing, pieces, pii, quality, sharding, toxicity

#: Regions by capacity, four racks of eight shards each; and the same after a rack was doubled and a shard drained.
BEFORE = sharding.grid({"ap": 1, "eu": 2, "us": 3}, 4, 8)
AFTER = sharding.grid({"ap": 1, "eu": 2, "us": 3}, 4, 8, {"eu/r2": 2, "us/r1/s3": 0})
#: Searches ask for the rows whose id is divisible by this, against all rows.
QUERY_EVERY = 50


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op2_anisotropic_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("id") % QUERY_EVERY == 0)
    return found.select(F.col("id").alias("vec_id"), "rank", "neighbour", "score")


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare(_table(spark, sf_dir, "documents"))


def op4_weighted_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.moves(_table(spark, sf_dir, "documents"), BEFORE, AFTER)


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = chat.reply_trees(_table(spark, sf_dir, "conversations"))
    return chat.conversations(messages).select(F.col("tree").alias("conv_id"), "branch", "n_messages", "score", "text")


def op6_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(_table(spark, sf_dir, "documents"))


def op7_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(_table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_rows", "n_links", "keep")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_offsets": op1_pii_offsets,
    "op2_anisotropic_ann": op2_anisotropic_ann,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_weighted_sharding": op4_weighted_sharding,
    "op5_reply_trees": op5_reply_trees,
    "op6_sentencepiece_scan": op6_sentencepiece_scan,
    "op7_pu_quality": op7_pu_quality,
    "op8_best_two_fit": op8_best_two_fit,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_neardup": op10_minhash_neardup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_merkle_fingerprints": merkle.COMPARE_SQL,
    "op4_weighted_sharding": sharding.moves_sql(BEFORE, AFTER),
    "op5_reply_trees": chat.CHAT_SQL,
}
