"""The corpus pipeline: each stage works on all that the stage before it kept, and its decisions take effect.

All stages but the last return the columns of ``documents``, whatever their names; the last returns the packed pieces.
Texts are read whole.  Null texts count as empty: they are not toxic, are scored as texts without words for quality,
equal each other as exact copies, and are packed as one end id.  Repeated rows are copies of each other; of copies the
row with the most characters, then the smallest doc_id stays.  Without labels of both kinds a classifier rejects
nothing.  An empty table goes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boardsift.llm import exact_dedup, minhash, packing, quality, toxicity
from boardsift.llm.common import read_table, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the toxicity network rejects go."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the quality classifier rejects go."""
    return quality.drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts one document stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of each class of near duplicates one document stays."""
    return minhash.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: what is left is packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("exact-dedup", drop_exact_copies),
    ("near-dedup", drop_near_copies),
    ("packing", pack),
]

#: SQL can express neither the classifiers nor the packing; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
