"""Inputs of the catalogue's queries: a profile and word lists that fit the supplied tables."""

from __future__ import annotations

from .config import BrandProfile

# The supplied texts are invented prose without Cyrillic: letters are mapped to Cyrillic ones, alike in Spark and SQL.
LATIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC = "абцдефгхийклмнопярстувшызюАБЦДЕФГХИЙКЛМНОПЯРСТУВШЫЗЮ"

BRAND = "(инге|тионтх)"
LATIN_BRAND = "(inge|tionth)"
LATIN_NOISE = ["onhe", "thnt", "edan"]
LATIN_TOPIC = ["whin", "ouer"]
LATIN_STOP = ["the", "of", "and", "that", "in", "to", "is", "on", "a", "it", "for", "with", "de", "la", "der", "die", "en", "que"]

PROFILE = BrandProfile(
    "инге",
    "Сеть магазинов",
    ["тионтх"],
    sure_drop_patterns=["(?i)хатион", "(", "(?i)онеад"],
    pr_reply_markers=["(?i)^тх[еи]", "(?i)антхе"],
    brand_sure_drop=["(?i)(оутх|оуер).{0,40}(инг|тион)"],
    homonym_noise=["(?i)естти"],
)
KEPT_WORDS = ["инге", "онтх", "шхен"]
