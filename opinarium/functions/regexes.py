"""Python-style regular expressions for Spark's Java engine, and Unicode stripping."""

from __future__ import annotations

import re

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: White space as Python knows it; Java's Unicode class lacks the four separators.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
UNICODE = "(?uUd)"
UNICODE_IGNORING_CASE = "(?iuUd)"


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with the flags and spellings under which Java matches as Python does."""
    out = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    return (UNICODE_IGNORING_CASE if ignore_case else UNICODE) + out


def compiles(pattern: str, spark: SparkSession | None = None) -> bool:
    """Whether both Python and Java take the pattern. Without a session only Python is asked."""
    try:
        re.compile(pattern, re.IGNORECASE)
    except re.error:
        return False
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return True
    try:
        spark._jvm.java.util.regex.Pattern.compile(java(pattern, True))
    except Exception as e:  # py4j wraps PatternSyntaxException
        if "PatternSyntaxException" in str(e):
            return False
        raise
    return True


def valid(patterns: list[str], spark: SparkSession | None = None) -> list[str]:
    """The patterns that compile, in order; others are skipped as single bad lines of a profile."""
    return [p for p in patterns or [] if compiles(p, spark)]


def alternatives(patterns: list[str]) -> str:
    return "|".join(patterns)


def literal(text: str) -> str:
    """A pattern for a literal that no word character touches; blank gives none."""
    text = (text or "").strip()
    return rf"(?<!\w){re.escape(text)}(?!\w)" if text else ""


def ustrip(col: Column) -> Column:
    """col without Unicode white space at its ends."""
    return F.regexp_replace(col, rf"(?Ud)\A{SPACE}+|{SPACE}+\z", "")


def matches(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    return col.rlike(java(pattern, ignore_case))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)
