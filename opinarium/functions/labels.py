"""Labels: parsing, badges, mapping to allowed categories."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regexes import ustrip
from .text import given, norm_label

SENTIMENTS = ("negative", "neutral", "positive")
#: The class of texts below their threshold.
OTHER = 3

# Spellings of the three classes.
SPELLINGS = {
    0: ["0", "neg", "negative", "негатив", "нег", "плохо", "bad", "-1"],
    1: ["1", "neu", "neutral", "нейтрал", "нейтр", "нейтрально", "ok", "okay", "0.0"],
    2: ["2", "pos", "positive", "позитив", "поз", "хорошо", "good", "+1"],
}


def parse_label(col: Column, kind: str) -> Column:
    """Class 0, 1 or 2 of a label column of Spark type kind, or null.

    Integers count only as 0, 1 and 2. Others are compared as text, so the
    float 0.0 is spelt like class 1 and 1.0 like none.
    """
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.when(col.isin(0, 1, 2), col.cast("int"))
    text = F.lower(ustrip(col.cast("string")))
    out = F.lit(None).cast("int")
    for label, names in SPELLINGS.items():
        out = F.when(text.isin(names), F.lit(label)).otherwise(out)
    return out


def label_name(col: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SENTIMENTS)), F.when((col >= 0) & (col < len(SENTIMENTS)), col.cast("int") + 1))


def badge(col: Column) -> Column:
    """Colour and caption of a sentiment; anything unknown is neutral."""
    text = F.lower(ustrip(given(col)))
    pair = lambda colour, caption: F.struct(F.lit(colour).alias("colour"), F.lit(caption).alias("caption"))
    return F.when(text == "positive", pair("green", "POSITIVE")).when(text == "negative", pair("red", "NEGATIVE")).otherwise(pair("gray", "NEUTRAL"))


def exact_or_prefix(raw: Column, allowed: list[str]) -> Column:
    """The allowed category equal to raw, else the first that it begins with or that begins with it (four characters or more)."""
    text = ustrip(given(raw))
    name = norm_label(raw)
    out = F.lit(None).cast("string")
    for c in reversed(allowed):
        n = norm_label(F.lit(c))
        out = F.when((n != "") & ((n.startswith(name) & (F.length(name) >= 4)) | (name.startswith(n) & (F.length(n) >= 4))), F.lit(c)).otherwise(out)
    return F.when(text.isin(allowed), text).when(name == "", None).otherwise(out) if allowed else F.lit(None).cast("string")


def best_allowed(df: DataFrame, raw: str, allowed: list[str], to: str, least: float = 0.6) -> DataFrame:
    """df with the allowed category that raw stands for, or null.

    Prefixes win in list order over ratios, so a ratio is only needed where
    no category matches natively: it is computed once for each distinct name.
    """
    native = df.select(raw).distinct().withColumn("_native", exact_or_prefix(F.col(raw), allowed)).withColumn("_name", norm_label(F.col(raw)))
    names = [n for n in allowed]

    @F.pandas_udf("string")
    def nearest(name: pd.Series, normed: pd.Series) -> pd.Series:
        # normed: the allowed names' normal forms, joined by line ends
        out = []
        for n, all_normed in zip(name, normed):
            best, score = None, 0.0
            for c, cn in zip(names, all_normed.split("\n")):
                ratio = SequenceMatcher(None, n, cn).ratio() if n and cn else 0.0
                if ratio > score:
                    best, score = c, ratio
            out.append(best if score >= least else None)
        return pd.Series(out, dtype=object)

    normed = F.array_join(F.array(*(norm_label(F.lit(c)) for c in names)), "\n") if names else F.lit("")
    mapped = native.withColumn(to, F.coalesce("_native", nearest(F.when(F.col("_native").isNull(), F.col("_name")).otherwise(""), normed)))
    key = F.col(raw)
    told = mapped.select(key.alias("_raw"), to)
    return df.join(told, df[raw].eqNullSafe(told["_raw"]), "left").drop("_raw")
