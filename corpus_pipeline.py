"""A training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recall_engine.llm import near_dedup, packing, quality, secrets, suffix_dedup
from recall_engine.llm.stage import written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the trees reject go.

    Null and empty texts have no words and go; texts are judged whole; repeated
    rows stay or go alike; other columns stay; an empty table stays empty, and
    without labels the base rules decide alone."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train_quality(docs, labels))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles,
    0.8): the one of the smallest id.

    Repeated rows count once, null and empty texts stay, a null id is the
    smallest; texts are compared whole; other columns stay."""
    return near_dedup.keep_one_each(docs, near_dedup.MinHash(words=5, percent=80))


#: Passages of 50 words are what should go.  Of documents that share one, 99 %
#: share a string of 240 bytes, 94 % one of 320 and 83 % one of 400.
REPEAT_BYTES = 240


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of REPEAT_BYTES that occur elsewhere are cut out.

    Null, empty and shorter texts stay as they are, repeated rows repeat each
    other, long texts are read whole; other columns stay."""
    return _counted(suffix_dedup.remove_repeats(docs, REPEAT_BYTES))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark.

    Texts without any, null and empty ones stay as they are, long ones are
    scanned whole, repeated rows are treated alike; other columns stay."""
    return _counted(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024.

    Null and empty texts hold the end id alone, long ones are cut into pieces,
    repeated rows are packed each; an empty table gives no rows."""
    pieces = packing.cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return packing.pack(pieces)


STAGES = [
    ("quality rules", keep_good),
    ("MinHash near-dedup", keep_one),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", hide_secrets),
    ("best-fit packing", pack_sequences),
]

#: Trees, signatures and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i + 1}")
    return docs
