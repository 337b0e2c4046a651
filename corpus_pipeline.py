"""Documents to packed training sequences, a stage at a time.

``run`` writes what each stage kept as Parquet to the shared folder and gives
the reread table to the next one.  All stages but the last return the columns
of documents; the last returns packed sequences, whose ``doc_ids`` say what
went into them.

Each stage takes any table with ``doc_id`` and ``text``, whatever other columns
it has, and keeps these as they are; an empty table gives an empty one.  Repeated
rows are documents like any others until near-duplicates go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import neardup, packing, pii, quality, toxicity
from docloom.llm.common import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Between the documents of a sequence.
SEPARATOR = "<|endoftext|>"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go.

    Null, empty and blank texts are never toxic and stay; without labels of both
    classes nothing can be told apart and all stay.  Repeated rows share their fate.
    """
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null, empty and blank texts hold no word and go; without trusted positives
    every document with a word stays.  Repeated rows share their fate.
    """
    return quality.keep_good(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of lowest doc_id, null ids last, and one of its repeated rows.

    Documents without a word (null, empty, blank) are groups of their own and stay.
    """
    return neardup.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays.

    ``n_chars`` follows the text, where the table has that column.  Null and
    empty texts stay as they are; repeated rows give equal rows.
    """
    out = pii.redacted(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(seq_id, used, doc_ids, starts, lengths, text): one row per training sequence.

    ``used`` is the length of ``text``, separators included, and at most
    ``packing.CAPACITY``.  Null and empty texts are in no sequence; repeated rows
    are packed one by one.
    """
    found = packing.sequences(docs, keep_text=True, separator=len(SEPARATOR))
    return found.withColumn("text", F.array_join("texts", SEPARATOR)).drop("texts")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean_language),
    ("quality classifier", good_quality),
    ("MinHash near-dedup", near_duplicates),
    ("PII", without_personal_data),
    ("best-fit packing", packed),
]

#: Trained models and sketches aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs
