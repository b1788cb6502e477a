"""Profiles and settings, checked when they are made."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame

from ..functions import words
from ..functions.prompts import SYSTEM_TEMPLATE, system_prompt
from ..functions.regexes import alternatives, compiles, literal


@dataclass(frozen=True)
class BrandProfile:
    """What is known of a brand. Lists that are None fall back: near-brand drops to the sure drops, homonyms to none."""

    brand_name: str = "BRAND"
    description: str = ""
    aliases: list[str] = field(default_factory=list)
    sure_drop_patterns: list[str] = field(default_factory=list)
    pr_reply_markers: list[str] = field(default_factory=list)
    brand_sure_drop: list[str] | None = None
    homonym_noise: list[str] | None = None

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("brand_name", self.brand_name or "BRAND")
        put("description", self.description or "")
        for k in ("aliases", "sure_drop_patterns", "pr_reply_markers"):
            put(k, list(getattr(self, k) or []))
        put("brand_sure_drop", list(self.sure_drop_patterns if self.brand_sure_drop is None else self.brand_sure_drop))
        put("homonym_noise", list(self.homonym_noise or []))

    @classmethod
    def of(cls, given: dict | None, name: str | None = None) -> BrandProfile:
        known = {f.name for f in fields(cls)}
        return cls(**({"brand_name": name} if name else {}) | {k: v for k, v in (given or {}).items() if k in known})

    @classmethod
    def from_form(cls, name: str, description: str = "", aliases: str = "", drops: str = "", replies: str = "") -> BrandProfile:
        """From text boxes: aliases between commas, patterns one a line."""
        lines = lambda text: [x.strip() for x in (text or "").splitlines() if x.strip()]
        return cls(name.strip(), description.strip(), [x.strip() for x in aliases.split(",") if x.strip()], lines(drops), lines(replies))

    def brand_patterns(self, extra: str = "") -> list[str]:
        """Literals of name and aliases, then one pattern a line of extra; a placeholder if there are none.

        A pattern that doesn't compile is an error here.
        """
        found = [p for p in map(literal, [self.brand_name, *self.aliases]) if p]
        more = [x.strip() for x in (extra or "").splitlines() if x.strip()]
        if bad := [p for p in more if not compiles(p)]:
            raise ValueError(f"brand patterns that don't compile: {bad}")
        return [*found, *more] or list(words.DEFAULT_BRAND)

    def brand(self, extra: str = "") -> str:
        return alternatives(self.brand_patterns(extra))

    def system_prompt(self, template: str = SYSTEM_TEMPLATE) -> str:
        return system_prompt(template, self.brand_name, self.description, self.aliases)

    @classmethod
    def with_common_rules(cls, name: str, aliases: list[str], **more) -> BrandProfile:
        """A profile with the drop rules and reply marks that hold for any brand."""
        names = "|".join([name.lower(), *(a.lower() for a in aliases)])
        return cls(name, aliases=aliases, sure_drop_patterns=[*words.HIRING_PATTERNS, words.NEAR_PATTERN.format(names=names), words.EVENT_PATTERN], pr_reply_markers=words.REPLY_MARKERS, **more)


def load_brands(path: str) -> dict[str, BrandProfile]:
    """Profiles by name from a YAML catalogue; a missing file has none, entries that aren't maps are skipped."""
    if not os.path.exists(path):
        return {}
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    return {k: BrandProfile.of(v, v.get("brand_name") or k) for k, v in sorted(data.items()) if isinstance(v, dict)}


#: A function of a text column that takes the place of the standard preprocessing.
Hook = Callable[[Column], Column]


def _within(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}, not {value}")


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of the file job, with the ranges of its controls."""

    text: str = "Текст"
    temperature: float = 0.0
    truncate_chars: int = 800
    max_words: int = 250
    batch_size: int = 6
    workers: int = 3
    embed_batch_size: int = 128
    enable_sentiment: bool = True
    sentiment_only_kept: bool = True
    compat_nan: bool = False
    extra_brand_patterns: str = ""

    def __post_init__(self):
        _within("temperature", self.temperature, 0, 1)
        _within("truncate_chars", self.truncate_chars, 100, 5000)
        _within("batch_size", self.batch_size, 1, 50)
        _within("workers", self.workers, 1, 20)
        _within("embed_batch_size", self.embed_batch_size, 8, 2048)


@dataclass(frozen=True)
class CategoryConfig:
    text: str = "Текст"
    category: str = "Категория"
    top_k: int = 5
    batch_size: int = 10
    workers: int = 3
    truncate_chars: int = 800
    max_words: int = 250

    def __post_init__(self):
        _within("top_k", self.top_k, 1, 20)
        _within("batch_size", self.batch_size, 1, 30)
        _within("workers", self.workers, 1, 12)


@dataclass(frozen=True)
class SentimentConfig:
    k_per_class: int = 3
    normalize: bool = True
    thresholds: dict[int, float] = field(default_factory=lambda: {0: 0.7, 1: 0.6, 2: 0.6})
    enable_fallback: bool = True
    batch_size: int = 20
    workers: int = 3
    truncate_chars: int = 800
    max_words: int = 250
    max_retries: int = 6
    seed: int = 42


def require_columns(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")

