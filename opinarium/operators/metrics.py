"""Counts and rates as one-row tables, or carried by the job that makes the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.regexes import ustrip
from ..functions.text import given


def says(col: Column, word: str) -> Column:
    """Whether a flag column says a word, ignoring case and space; null doesn't."""
    return F.coalesce(F.lower(ustrip(given(col))) == word, F.lit(False))


class Counts:
    """Aggregates that a job's own pass computes: what of() returns carries them, and result() has them once an action on it has ended.

    Only the first action counts; nothing is computed again for them.
    """

    def __init__(self):
        self.seen: list[Observation] = []

    def of(self, df: DataFrame, *aggregates: Column) -> DataFrame:
        self.seen.append(Observation())
        return df.observe(self.seen[-1], *aggregates)

    def result(self) -> dict:
        """All aggregates by their names; it waits for the action."""
        return {k: v for seen in self.seen for k, v in seen.get.items()}


def with_job_counts(df: DataFrame, counts: Counts, sentiment: str | None = None) -> DataFrame:
    """A finished job's rows (with is_drop and rule_code), which carry their counts: rows, drops, keeps, rule_drops and sentiments."""
    says_drop = says(F.col("is_drop"), "yes")
    labels = [F.count_if(F.col(sentiment) == s).alias(s) for s in ("positive", "negative", "neutral")] if sentiment else []
    return counts.of(df, F.count("*").alias("rows"), F.count_if(says_drop).alias("drops"), F.count_if(~says_drop).alias("keeps"), F.count("rule_code").alias("rule_drops"), *labels)


def job_counts(counts: Counts, seconds: float | None = None, batch_size: int = 6) -> dict:
    """What counts has seen, with llm_calls and, for the seconds that the job took, rates."""
    out = counts.result()
    if "rule_drops" in out:
        out["llm_calls"] = out.pop("batches", math.ceil((out["rows"] - out["rule_drops"]) / batch_size))
    return out | ({"total_s": seconds, "comments_per_s": out["rows"] / max(seconds, 1e-9)} if seconds is not None else {})


def rule_stats(df: DataFrame, batch_size: int = 6) -> DataFrame:
    """rows, rule_drops and llm_calls of a table with rule_code."""
    drops = F.count("rule_code")
    return df.agg(F.count("*").alias("rows"), drops.alias("rule_drops"), F.ceil((F.count("*") - drops) / batch_size).cast("long").alias("llm_calls"))


def job_stats(df: DataFrame, seconds: float, batch_size: int = 6, latency: str | None = None) -> DataFrame:
    """rule_stats() with total_s, comments_per_s and the mean batch latency (null: none)."""
    mean = F.avg(latency) if latency else F.lit(None).cast("double")
    drops = F.count("rule_code")
    calls = F.ceil((F.count("*") - drops) / batch_size).cast("long")
    return df.agg(F.count("*").alias("rows"), drops.alias("rule_drops"), calls.alias("llm_calls"), F.lit(float(seconds)).alias("total_s"), (F.count("*") / max(seconds, 1e-9)).alias("comments_per_s"), mean.alias("mean_batch_latency_s"))


def drop_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_if(says(F.col("is_drop"), "yes")).alias("drops"), F.count_if(~says(F.col("is_drop"), "yes")).alias("keeps"))


def sentiment_counts(df: DataFrame, col: str = "sentiment") -> DataFrame:
    return df.agg(*(F.count_if(F.col(col) == s).alias(s) for s in ("positive", "negative", "neutral")))


def category_stats(df: DataFrame, source: str, use_refs: bool, top_k: int) -> DataFrame:
    classified = F.count_if(F.col(source).isin("llm", "rag_llm"))
    return df.agg(F.count("*").alias("rows"), classified.alias("classified"), F.count_if(F.col(source) == "skip_drop").alias("skipped_drop"), F.lit(use_refs).alias("use_rag"), F.lit(top_k).alias("top_k"))


def class_counts(df: DataFrame, label: str, classes: int = 3) -> DataFrame:
    """Rows of each class from 0, zero for absent ones."""
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    counts = df.where(F.col(label).between(0, classes - 1)).groupBy(F.col(label).cast("int").alias(label)).agg(F.count("*").alias("n"))
    return every.join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n"))


def accuracy_coverage(df: DataFrame, truth: str, pred: str, passed: str) -> DataFrame:
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return df.agg(rate(F.col(truth) == F.col(pred)).alias("accuracy"), rate(F.col(passed)).alias("coverage"))


def by_group(df: DataFrame, *keys: str | Column, label: str = "sentiment") -> DataFrame:
    """Counts of drops and sentiments by time, source or any other keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(says(F.col("is_drop"), "yes")).alias("drops"), *(F.count_if(F.col(label) == s).alias(s) for s in ("positive", "negative", "neutral")))
