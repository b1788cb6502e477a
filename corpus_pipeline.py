"""The corpus pipeline: quality, near-duplicates, repeated passages, personal data, packing.

Each stage works on all rows that its predecessor kept and returns the
columns of documents; the last returns the pieces of packed sequences.
Stages that change text set n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinarium.llm import minhash, packing, pii, quality, repeats
from opinarium.llm.common import table, written


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return minhash.first_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat, in one text or several, go from the texts, all their copies."""
    return _counted(repeats.clean(docs))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to marks."""
    return _counted(pii.redact_pii(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("near-duplicates", one_of_each), ("repeated passages", without_repeats), ("personal data", without_pii), ("packing", packed)]

#: The stages run trees, sketches, suffix arrays and a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
