"""Answers of language models: the JSON in free text, and its checked rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RELEVANCE = "results array<struct<global_idx: long, action: string>>"
SENTIMENT = "results array<struct<global_idx: long, label: string>>"
CATEGORY = "results array<struct<global_idx: long, category: string>>"


def json_span(col: Column) -> Column:
    """From the first opening to the last closing brace; null: none."""
    return F.nullif(F.regexp_extract(col, r"(?s)\{.*\}", 0), F.lit(""))


def results(col: Column, schema: str) -> Column:
    """The rows of results, null for text without valid JSON."""
    return F.from_json(json_span(col), schema)["results"]


def checked(rows: Column, field: str, allowed: list[str]) -> Column:
    """The rows whose field is one of the allowed."""
    return F.filter(rows, lambda r: r[field].isin(allowed) & r["global_idx"].isNotNull())
