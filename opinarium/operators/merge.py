"""Answers joined to the rows they were asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_answers(answers: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One answer for each key: the last in response order."""
    return answers.groupBy(key).agg(F.max_by(value, order).alias(value))


def merge_actions(rows: DataFrame, answers: DataFrame, key: str = "row_id", order: str = "pos", default: str = "keep") -> DataFrame:
    """rows (with asked) with action: drops by rule stay, answers count for asked rows only, the rest is default."""
    told = last_answers(answers, key, "action", order).withColumnRenamed("action", "_answer")
    out = rows.join(told, key, "left")
    return out.withColumn("action", F.when(~F.col("asked"), "drop").otherwise(F.coalesce("_answer", F.lit(default)))).drop("_answer")


def merge_labels(rows: DataFrame, answers: DataFrame, value: str, key: str = "row_id", order: str = "pos", strict: bool = False) -> DataFrame:
    """rows with value; strict: an unanswered row fails the job."""
    out = rows.join(last_answers(answers, key, value, order), key, "left")
    if strict:
        told = F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit("no answer for row "), F.col(key).cast("string")))).otherwise(F.col(value))
        out = out.withColumn(value, told)
    return out
