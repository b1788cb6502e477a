"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors (at-signs, plus signs, digits,
scheme marks, identifier and street cues) in one pass over the whole text;
at each, a deterministic parser grows the span's boundaries and validates it.
The parsers of the base kinds give exactly what leftmost non-overlapping
matches of their patterns would, in time linear in the text.

Null texts count as empty; empty texts have no spans; repeated rows get equal
results; an empty table gives an empty table; columns of df named like a
result column are replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "address")

# Words that announce an identifier, and words that end a street address.
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "kontonummer", "compte", "cuenta", "ssn", "passport", "token", "api_key", "apikey", "secret", "password", "passwd")
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "drive")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
URL_REST = re.compile(r"""[^\s<>"'`{}|\\^]+""")
IDENTIFIER = re.compile(r"""[ \t]{0,3}(?:number|no\.?|id|key|nummer)?[ \t]{0,3}[:=#]?[ \t]{0,3}["']?([A-Za-z0-9][A-Za-z0-9_/+-]*(?: [A-Z0-9]{2,4})*)""")
STREET = re.compile(r"([0-9]{1,5}[A-Za-z]?,? (?:[^\W\d_]+ ){1,3})\Z")


@lru_cache(1)
def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("digit", "0123456789"), ("://", ["://"])):
        for word in words:
            found.add_word(word, (kind, 1 if len(word) == 1 else 3))
    for kind, words in (("account", ACCOUNT_CUES), ("street", STREET_CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_done = chain_done = quad_done = phone_done = url_done = account_done = 0
    for last, (kind, size) in anchors().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= chain_done:
                m = CHAIN.match(text, at)
                chain_done = m.end()
                if chain_done - at >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out["card"].append((at, chain_done))
            if at >= quad_done:
                if m := QUAD.match(text, at):
                    quad_done = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                        out["ip"].append((at, quad_done))
                else:
                    quad_done = DIGITS.match(text, at).end()
        elif kind == "@":
            start = at
            while start > email_done and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                email_done = m.end()
            else:
                email_done = at + 1
        elif kind == "+":
            if at >= phone_done and (m := PHONE.match(text, at)):
                phone_done = m.end()
                if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
                    out["phone"].append((at, phone_done))
        elif kind == "://":
            start = at
            while start > url_done and text[start - 1] in SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (m := URL_REST.match(text, at + 3)):
                url_done = at + 3 + len(m[0].rstrip(".,;:!?)]"))
                if url_done > at + 3:
                    out["url"].append((start, url_done))
        elif kind == "account":
            if at >= account_done and not text[at - 1 : at].isalnum() and (m := IDENTIFIER.match(text, last + 1)):
                value = m[1].rstrip("-+/")
                if m.start(1) > last + 1 and len(value) >= 6 and any(c in "0123456789" for c in value):
                    account_done = m.start(1) + len(value)
                    out["account"].append((m.start(1), account_done))
        elif not text[last + 1 : last + 2].isalnum() and (m := STREET.search(text, max(0, at - 60), at)):
            out["address"].append((m.start(1), last + 1))
    return [(k, a, b) for k in KINDS for a, b in out[k]]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the mark of its first, like [EMAIL]."""
    parts, done = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(parts) + text[done:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """df with spans: kind, start and end (exclusive, code points) of all personal data in text."""

    def make(texts):
        return [[[dict(zip(("kind", "start", "end"), s)) for s in find(t or "")] for t in texts]]

    return add_columns(df, T.StructType([T.StructField("spans", SPANS)]), make, [text])


def redact_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """df with text redacted; a text without personal data, or null, stays as it is."""

    def make(texts):
        return [[t if t is None else redacted(t, find(t)) for t in texts]]

    return add_columns(df, T.StructType([T.StructField(text, T.StringType())]), make, [text]).select(df.columns)


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash and list of the spans that find_pii() added; n_spans counts those of all kinds."""
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
