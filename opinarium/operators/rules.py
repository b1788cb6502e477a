"""Sure drops: ordered lists of patterns, tried before any model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexes import let, valid
from ..functions.text import ordered_matches
from ..plans.config import BrandProfile

CODES = ("hiring", "near_brand", "pr_reply", "homonym_noise")


def rule_lists(profile: BrandProfile) -> list[tuple[str, list[str]]]:
    return list(zip(CODES, (profile.sure_drop_patterns, profile.brand_sure_drop, profile.pr_reply_markers, profile.homonym_noise)))


def sure_drop(col: Column, profile: BrandProfile) -> Column:
    """A struct rule_code, pattern of the first rule that matches; null for none and for empty text.

    Patterns that don't compile are skipped on the driver.
    """
    lists = [(code, kept) for code, patterns in rule_lists(profile) if (kept := valid(patterns))]
    if not lists:
        return F.lit(None).cast("struct<rule_code: string, pattern: string>")

    def named(code: str):
        return lambda hit: F.when(hit.isNotNull(), F.struct(F.lit(code).alias("rule_code"), hit.alias("pattern")))

    def first(text: Column) -> Column:
        return F.when(text != "", F.coalesce(*(let(ordered_matches(text, kept), named(code)) for code, kept in lists)))

    return let(col, first)


def with_rules(df: DataFrame, text: str, profile: BrandProfile) -> DataFrame:
    """df with rule_code, pattern and is_drop (Yes or No) by rules alone."""
    hit = sure_drop(F.col(text), profile)
    out = df.withColumn("_rule", hit)
    return out.withColumns({"rule_code": F.col("_rule.rule_code"), "pattern": F.col("_rule.pattern"), "is_drop": F.when(F.col("_rule").isNotNull(), "Yes").otherwise("No")}).drop("_rule")
