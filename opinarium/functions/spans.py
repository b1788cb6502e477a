"""Sentences and token windows as column expressions.

A token of a text stays iff some centre is at most ``half`` tokens away:
that equals merging the windows around all centres, since what is left is
cut into tokens again. Matches are marked in the text, which is then cut into
tokens once, so that the work is in proportion to the text, however many
matches it has.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words
from .regexes import SPACE, alternatives, java, let, matches, ustrip
from .text import TOKEN, content, given, tokens

HALF = 100


def sentences(col: Column) -> Column:
    parts = F.split(given(col), rf"(?U)(?<=[.!?…]){SPACE}+|\n+")
    return F.filter(F.transform(parts, ustrip), lambda s: s != "")


#: Put before each match; no character, and no part of a token.
MARK = "\ufdd0"


def centres(col: Column, pattern: str) -> Column:
    """The numbers (from 0, rising) of the tokens at or before the start of a match; the first if there is none before.

    The pattern must not match the empty string.
    """
    one = TOKEN[1:-2]
    # A token, and what stands between it and the next one as far as the last mark that isn't the next one's.
    element = f"[{one}{MARK}]*[{one}][{one}{MARK}]*(?:[^{one}]*{MARK}(?![{one}]))?"

    def numbers(text: Column) -> Column:
        places = F.transform(F.regexp_extract_all(text, F.lit(element), F.lit(0)), lambda e, i: F.when(e.contains(MARK), i))
        before = F.when(text.rlike(rf"\A[^{one}]*{MARK}(?![{one}])"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.array_union(before, F.filter(places, lambda p: p.isNotNull()))

    def found(text: Column) -> Column:
        marked = F.regexp_replace(text, java(pattern, True), f"{MARK}$0")
        return F.when(matches(text, pattern), let(marked, numbers)).otherwise(F.when(text.isNotNull(), F.array().cast("array<int>")))

    return let(F.replace(col, F.lit(MARK), F.lit(" ")), found)


def last(toks: Column, n: int) -> Column:
    return let(toks, lambda t: F.when(F.size(t) <= n, t).otherwise(F.slice(t, -n, n)))


def window_tokens(toks: Column, centres: Column, most: int, half: int = HALF) -> Column:
    """The last most of the tokens within half tokens of a centre (token numbers, rising).

    Each centre adds what no centre before it has, so windows are merged as they are cut.
    """
    def own(cs: Column) -> Callable[[Column, Column], Column]:
        def cut(c: Column, i: Column) -> Column:
            start = F.greatest(c - half, F.get(cs, i - 1) + half + 1, F.lit(0))
            return F.slice(toks, start + 1, c + half + 1 - start)

        return cut

    return F.array_join(last(let(centres, lambda cs: F.flatten(F.transform(cs, own(cs)))), most), " ")


def fixed_window(centre: Column, n: Column, most: int) -> Column:
    """start and end of a window of most tokens around a centre, shifted to fit in n."""
    start = F.greatest(F.least(centre - most // 2, n - most), F.lit(0))
    return F.when(n <= most, F.struct(F.lit(0).alias("start"), n.alias("end"))).otherwise(F.struct(start.alias("start"), (start + most).alias("end")))


def by_sentences(col: Column, brand: str, most: int, stop: list[str] = words.STOP_WORDS, top: int = 5) -> Column:
    """The brand's first sentence and its neighbours, else the top sentences by content; their last most tokens."""
    def near_brand(sents: Column, at: Column) -> Column:
        first = F.greatest(at - 1, F.lit(1)).cast("int")
        return F.slice(sents, first, (F.least(at + 1, F.size(sents)) - first + 1).cast("int"))

    def best(sents: Column) -> Column:
        scored = F.transform(sents, lambda s: F.struct(F.size(content(tokens(s), stop)).alias("score"), s.alias("s")))
        return F.transform(F.slice(F.sort_array(scored, asc=False), 1, top), lambda x: x["s"])

    def chosen(sents: Column) -> Column:
        at = F.array_position(F.transform(sents, lambda s: matches(s, brand)), True)
        return let(at, lambda a: F.when(a > 0, near_brand(sents, a)).otherwise(best(sents)))

    def words_of(sents: Column) -> Column:
        return F.when(F.size(sents) == 0, F.slice(tokens(col), 1, most)).otherwise(last(tokens(F.array_join(chosen(sents), " ")), most))

    return F.array_join(let(sentences(col), words_of), " ")


def relevant_span(col: Column, brand: str, most: int, topic: str | None = None, topics: dict[str, list[str]] = words.TOPICS, half: int = HALF) -> Column:
    """A text of up to most tokens as it is; else windows around brand (and topic) matches, else sentences."""
    def cut(text: Column, toks: Column) -> Column:
        places = centres(text, brand)
        if topic in topics:
            places = F.sort_array(F.array_union(places, centres(text, alternatives(topics[topic]))))
        return let(places, lambda cs: F.when(F.size(cs) > 0, window_tokens(toks, cs, most, half)).otherwise(by_sentences(text, brand, most)))

    def span(text: Column) -> Column:
        return let(tokens(text), lambda toks: F.when(F.size(toks) <= most, ustrip(text)).otherwise(cut(text, toks)))

    return let(col, span)
