"""Vectors as array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import let

EPSILON = 1e-12


def doubles(col: Column) -> Column:
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(col: Column) -> Column:
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(col: Column) -> Column:
    """col over its length plus a tiny number, so that zero stays zero."""
    return let(doubles(col), lambda v: let(norm(v) + EPSILON, lambda length: F.transform(v, lambda x: x / length)))
