"""Rules of many brands in one job.

A pass with one automaton of all names tells which brands a text may mention:
names without the letters' case, as they stand in it at all. Only for those
are the brand's own patterns tried, by expressions, and then its rules. A brand
whose patterns name no text that must occur is tried everywhere. What is only a
word, whole or as part of another, the same pass decides itself, so that neither
a brand nor a rule of that kind searches the text again.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regexes import java, let, valid
from ..plans.config import BrandProfile
from ..session import importable
from .rules import rule_lists

#: Catalogues of up to so many characters of patterns are broadcast; beyond it they are joined.
BROADCAST_CHARACTERS = 8 << 20
RULES = "array<struct<rule_code: string, pattern: string, regex: string, plain: boolean>>"
CANDIDATES = T.ArrayType(T.StructType([T.StructField("brand_no", T.IntegerType()), T.StructField("sure", T.BooleanType()), T.StructField("hits", T.ArrayType(T.IntegerType()))]))
_CANDIDATES = pa.list_(pa.struct([("brand_no", pa.int32()), ("sure", pa.bool_()), ("hits", pa.list_(pa.int32()))]))

_PLAIN = re.compile(r"(?:\(\?i\))?(\(\?<!\\w\))?([A-Za-zА-Яа-яЁё0-9]+)(\(\?!\\w\))?")
#: Characters besides capital letters that a pattern without case takes for the letters of plain words.
_LIKE = {"ſ": "s", "ı": "i", "İ": "i", "\u212a": "k", "ᲀ": "в", "ᲁ": "д", "ᲂ": "о", "ᲃ": "с", "ᲄ": "т", "ᲅ": "т", "ᲆ": "ъ"}
_ALIKE, _UNUSUAL = str.maketrans(_LIKE), re.compile(f"[{''.join(_LIKE)}]")


def plain(pattern: str) -> tuple[str, bool] | None:
    """The word (folded) that the pattern consists of, and whether it must be whole; null for any other pattern."""
    m = _PLAIN.fullmatch(pattern)
    return (m[2].lower(), bool(m[1])) if m and bool(m[1]) == bool(m[3]) else None


def plain_folded(text: str) -> str:
    """text, letter by letter, with all that counts as a plain word's letter in its place."""
    return (text.translate(_ALIKE) if not text.isascii() and _UNUSUAL.search(text) else text).lower()


@lru_cache(4096)
def _within_word(ch: str) -> bool | None:
    """Whether a character belongs to words; null where Java's and Python's tables might differ."""
    if ch.isascii():
        return ch.isalnum() or ch == "_"
    kind = unicodedata.category(ch)
    if ord(ch) < 0x590 and kind in ("Lu", "Ll", "Lt", "Lm", "Lo"):
        return True
    return False if kind in ("Zs", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sc", "Sm") and ord(ch) < 0x2030 else None


def whole(text: str, start: int, end: int) -> bool | None:
    """Whether no word character touches text[start:end]; null: can't be told."""
    beside = [_within_word(c) for c in (text[start - 1 : start] if start else "", text[end : end + 1]) if c]
    return False if True in beside else None if None in beside else True


def folded(text: str) -> str:
    """Alike for all that a pattern without case takes for alike."""
    return text.upper().lower().replace("ς", "σ").replace("̇", "")


def required(pattern: str) -> str:
    """The longest text that every match holds (folded); empty if there is none that can be told."""
    from re import _constants as c
    from re import _parser

    def runs(parsed) -> Iterator[str]:
        run = ""
        for kind, value in parsed:
            if kind is c.LITERAL:
                run += chr(value)
                continue
            if kind in (c.AT, c.ASSERT, c.ASSERT_NOT):
                continue
            yield run
            run = ""
            if kind is c.SUBPATTERN:
                yield from runs(value[3])
            elif kind in (c.MAX_REPEAT, c.MIN_REPEAT, c.POSSESSIVE_REPEAT) and value[0]:
                yield from runs(value[2])
            elif kind is c.ATOMIC_GROUP:
                yield from runs(value)
        yield run

    try:
        return max(map(folded, runs(_parser.parse(pattern, re.IGNORECASE))), key=len, default="")
    except re.error:
        return ""


def literals(pattern: str) -> list[str]:
    """Texts of which every match of the pattern has one; none if that can't be told."""
    from re import _constants as c
    from re import _parser

    try:
        parsed = _parser.parse(pattern, re.IGNORECASE)
    except re.error:
        return []
    if len(parsed) == 1 and parsed[0][0] is c.BRANCH:
        found = []
        for part in _split(pattern):
            found.append(required(part))
        return found if all(found) else []
    one = required(pattern)
    return [one] if one else []


def _split(pattern: str) -> list[str]:
    """The alternatives of a pattern at its top level."""
    out, depth, at, i, within = [], 0, 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif within:
            within = ch != "]"
        elif ch == "[":
            within = True
            i += pattern[i + 1 : i + 2] == "^"
            i += pattern[i + 1 : i + 2] == "]"
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and not depth:
            out.append(pattern[at:i])
            at = i + 1
        i += 1
    return [*out, pattern[at:]]


@lru_cache(4)
def automaton(words: tuple[tuple[str, tuple], ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, value in words:
        made.add_word(word, value)
    made.make_automaton()
    return made


def _rows(spark: SparkSession, profiles: dict[str, BrandProfile]) -> list[tuple]:
    """brand, brand_no, brand_regex and rules (in their order, those that compile) for each profile."""
    known: dict[str, bool] = {}

    def kept(patterns: list[str]) -> list[str]:
        for p in patterns:
            if p not in known:
                known[p] = bool(valid([p], spark))
        return [p for p in patterns if known[p]]

    return [(name, i, java(p.brand(), True), [(code, pattern, java(pattern, True), (plain(pattern) or ("", True))[1] is False) for code, patterns in rule_lists(p) for pattern in kept(patterns)]) for i, (name, p) in enumerate(sorted(profiles.items()))]


def brand_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """_rows() as a table."""
    table = spark.createDataFrame(rows, f"brand string, brand_no int, brand_regex string, rules {RULES}")
    size = sum(len(r[2]) + sum(len(x[2]) + len(x[1]) for x in r[3]) for r in rows)
    return F.broadcast(table) if size <= BROADCAST_CHARACTERS else table


def first_rule(text: Column, rules: Column, hits: Column | None = None) -> Column:
    """A struct rule_code, pattern of the first of rules that the text matches; null for none and for empty text.

    hits: the places of the plain rules that match; unless given, all are tried.
    """
    if hits is None:
        found = F.filter(rules, lambda r: F.rlike(text, r["regex"]))
    else:
        found = F.filter(rules, lambda r, i: F.when(r["plain"], F.array_contains(hits, i)).otherwise(F.rlike(text, r["regex"])))
    return F.when(text != "", let(F.get(found, 0), lambda r: F.when(r.isNotNull(), F.struct(r["rule_code"].alias("rule_code"), r["pattern"].alias("pattern")))))


def _with_candidates(df: DataFrame, text: str, profiles: dict[str, BrandProfile], rows: list[tuple], to: str) -> DataFrame:
    """df with CANDIDATES: the brands that a text mentions (sure) or may mention, each with the places of its plain rules that match."""
    importable(df.sparkSession)
    brands: dict[str, list[int]] = {}
    owners: dict[str, list[int]] = {}
    always = []
    for i, (_, profile) in enumerate(sorted(profiles.items())):
        known = {p: plain(p) for p in profile.brand_patterns()}
        for word in {k[0] for k in known.values() if k and k[1]}:
            owners.setdefault(word, []).append(i)
        found = [literals(p) for p, k in known.items() if not (k and k[1])]
        if all(found):
            for word in {w for ws in found for w in ws}:
                brands.setdefault(word, []).append(i)
        else:
            always.append(i)
    words = tuple((w, tuple(b)) for w, b in sorted(brands.items()))
    ruling = [[(k, plain(rule[1])[0]) for k, rule in enumerate(row[3]) if rule[3]] for row in rows]
    plain_words = tuple((w, (w, tuple(owners.get(w, ())))) for w in sorted({*owners, *(w for some in ruling for _, w in some)}))
    schema = T.StructType([*df.schema.fields, T.StructField(to, CANDIDATES)])

    def of(t: str, decided, search) -> list[tuple[int, bool, list[int]]]:
        sure: set[int] = set()
        maybe, met, named = set(always), set(), set()
        if decided:
            s = plain_folded(t)
            for end, (word, some) in decided.iter(s):
                met.add(word)
                if some and word not in named and (told := whole(s, end + 1 - len(word), end + 1)) is not False:
                    (sure if told else maybe).update(some)
                    if told:
                        named.add(word)
        if search:
            for _, some in search.iter(folded(t)):
                maybe.update(some)
        return [(b, b in sure, [k for k, w in ruling[b] if w in met]) for b in sorted(sure | maybe)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decided, search = (automaton(w) if w else None for w in (plain_words, words))
        for batch in batches:
            out = [of(t, decided, search) if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _CANDIDATES)], names=schema.names)

    return df.mapInArrow(run, schema)


def mentioned_brands(df: DataFrame, text: str, profiles: dict[str, BrandProfile]) -> DataFrame:
    """df with brand, rule_code, pattern and is_drop: a row for each brand that a text mentions, judged by that brand's rules.

    The same as each profile's patterns and rules on the whole table, one after another.
    """
    rows = _rows(df.sparkSession, profiles)
    made = _with_candidates(df, text, profiles, rows, "_brands").select(*df.columns, F.inline("_brands").alias("brand_no", "_sure", "_hits"))
    joined = made.join(brand_table(df.sparkSession, rows), "brand_no").where(F.col("_sure") | F.rlike(F.col(text), F.col("brand_regex")))
    return _judged(joined, text, F.col("_hits")).drop("brand_no", "_sure", "_hits")


def by_named_brand(df: DataFrame, text: str, brand: str, profiles: dict[str, BrandProfile]) -> DataFrame:
    """df with rule_code, pattern and is_drop by the rules of the brand that each row names; rows of other brands are dropped by none."""
    table = brand_table(df.sparkSession, _rows(df.sparkSession, profiles)).withColumnRenamed("brand", "_brand").drop("brand_no")
    joined = df.join(table, df[brand] == F.col("_brand"), "left").drop("_brand")
    return _judged(joined, text)


def _judged(joined: DataFrame, text: str, hits: Column | None = None) -> DataFrame:
    out = joined.withColumn("_rule", first_rule(F.col(text), F.col("rules"), hits)).drop("rules", "brand_regex")
    return out.withColumns({"rule_code": F.col("_rule.rule_code"), "pattern": F.col("_rule.pattern"), "is_drop": F.when(F.col("_rule").isNotNull(), "Yes").otherwise("No")}).drop("_rule")
