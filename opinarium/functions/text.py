"""Cleaning and gating of comments as column expressions.

Everything but full HTML entities is a Catalyst expression; entities go
through an Arrow UDF that is handed only the texts with an ampersand.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable

from . import words
from .regexes import NOT_SPACE, SPACE, alternatives, java, let, matches, ustrip

TOKEN = "[A-Za-zА-Яа-яЁё0-9]+"
CYRILLIC = "[А-Яа-яЁё]"


def given(col: Column, compat_nan: bool = False) -> Column:
    """A comment as text: null is empty, or 'nan' as a stringified missing cell."""
    return F.coalesce(col.cast("string"), F.lit("nan" if compat_nan else ""))


def prepare_comment(col: Column, truncate: int = 800) -> Column:
    """Stripped, then cut to truncate code points (0: not)."""
    out = ustrip(given(col))
    return F.substring(out, 1, truncate) if truncate else out


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape(col: Column) -> Column:
    """Character references decoded, all of HTML5's, in one pass."""
    if spark := SparkSession.getActiveSession():
        importable(spark)
    return F.coalesce(_unescape(F.when(col.contains("&"), col)), col)


def lines(col: Column) -> Column:
    return F.split(col, "\n")


def joined(col: Column) -> Column:
    return F.array_join(col, "\n")


def clean_line(line: Column) -> Column:
    """Mentions keep their names, hashtags their words; links, handles and tags go; some punctuation and runs of space are one space."""
    out = F.regexp_replace(ustrip(line), r"\[([^\]|]+)\|([^\]]+)\]", "$2")
    out = F.regexp_replace(out, rf"(?U)https?://{NOT_SPACE}+", " ")
    out = F.regexp_replace(out, r"(?U)#(\w+)", "$1")
    out = F.regexp_replace(out, r"(?U)@\w+", " ")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    out = F.translate(out, words.PUNCTUATION, " " * len(words.PUNCTUATION))
    return ustrip(F.regexp_replace(out, rf"(?U){SPACE}+", " "))


def basic_clean(col: Column, entities: bool = True) -> Column:
    """Lines cleaned, blank ones dropped. entities: decode character references first."""
    text = given(col)
    text = F.replace(unescape(text) if entities else text, F.lit("\r"), F.lit("\n"))
    return joined(F.filter(F.transform(lines(text), clean_line), lambda x: x != ""))


def strip_noise(col: Column, brand: str, noise: list[str] = words.NOISE_PHRASES) -> Column:
    """Lines without noise phrases; a line that names the brand stays."""
    pattern = alternatives(noise)
    keep = lambda line: ~matches(F.lower(line), pattern) | matches(line, brand)
    return ustrip(joined(F.filter(lines(given(col)), keep)))


def drop_lines_without_letters(col: Column) -> Column:
    return ustrip(joined(F.filter(lines(given(col)), lambda line: line.rlike(r"\p{L}"))))


def squash_repeats(col: Column, most: int = 3) -> Column:
    """Runs of one character cut to most."""
    return F.regexp_replace(col, rf"(?d)(.)\1{{{most},}}", "$1" * most)


def script_gate(col: Column, script: str | None = CYRILLIC) -> Column:
    """Null for a text without the script; no script: no gate."""
    return let(col, lambda x: F.when(x.rlike(script), x)) if script else col


def tokens(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(col), F.lit(TOKEN), F.lit(0))


def content(toks: Column, stop: list[str] = words.STOP_WORDS) -> Column:
    """The tokens that aren't stop words, repeats included."""
    return F.filter(toks, lambda t: ~t.isin(stop))


def is_meaningful(col: Column, brand: str, noise: list[str] = words.NOISE_PHRASES, stop: list[str] = words.STOP_WORDS) -> Column:
    def judged(text: Column) -> Column:
        letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
        named = matches(text, brand)

        def by_tokens(toks: Column) -> Column:
            noisy = matches(F.lower(text), alternatives(noise))
            left = let(F.size(content(toks, stop)), lambda n: (n > 0) & ((n > 3) | ~noisy))
            return F.when(F.size(toks) == 0, False).when(named, True).otherwise(left)

        return F.when(text == "", False).when((letters < 3) & ~named, False).otherwise(let(tokens(text), by_tokens))

    return let(given(col), judged)


def preprocess_base(col: Column, brand: str, script: str | None = CYRILLIC, entities: bool = True) -> Column:
    """Cleaned, gated and lower-cased; null for what the gates reject."""
    out = squash_repeats(drop_lines_without_letters(strip_noise(basic_clean(col, entities), brand)))
    return let(script_gate(out, script), lambda x: F.when(x.isNotNull() & is_meaningful(x, brand), F.lower(x)))


def _nonempty(col: Column) -> Column:
    """Null for the empty text. A plain nullif within a condition computes its text twice."""
    return let(col, lambda x: F.when(x != "", x))


def or_fallback(preprocessed: Column, text: Column) -> Column:
    """The preprocessed text, or the given one where that is null or empty: no row is lost."""
    return F.coalesce(_nonempty(preprocessed), text)


def preprocess_for_training(preprocessed: Column, text: Column) -> Column:
    """Null for blank texts; else the preprocessed, else the cleaned lower-cased text, else null."""
    fallback = F.lower(ustrip(basic_clean(text)))
    return F.when(ustrip(given(text)) != "", F.coalesce(_nonempty(preprocessed), _nonempty(fallback)))


def norm_label(col: Column) -> Column:
    """A category name for comparison: lower case, plain е, letters and digits, single spaces."""
    marks = "[\"'«»`*_•\\-— ]"
    out = ustrip(F.translate(F.lower(given(col)), "ё", "е"))
    out = F.regexp_replace(out, rf"\A{marks}+|{marks}+\z", "")
    out = F.regexp_replace(out, rf"(?U)[^0-9a-zа-я\s\x1c-\x1f]+", " ")
    return ustrip(F.regexp_replace(out, rf"(?U){SPACE}+", " "))


def clipped(col: Column, n: int) -> Column:
    """One line, stripped, cut to n code points with dots."""
    out = ustrip(F.replace(given(col), F.lit("\n"), F.lit(" ")))
    return let(out, lambda x: F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x))


def ordered_matches(col: Column, patterns: list[str]) -> Column:
    """The first of the patterns found in col, ignoring case; null: none."""
    found = [F.when(col.rlike(java(p, True)), F.lit(p)) for p in patterns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")
