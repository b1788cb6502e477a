"""Prompts as column expressions over batches. The texts are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexes import ustrip
from .text import clipped

# The texts of the prompts.
SYSTEM_TEMPLATE = """
Ты — фильтр релевантности для бренда "{brand_name}" и его официальных цифровых каналов (если есть: приложение/сайт/бонусы).

Контекст бренда:
{brand_description}

Синонимы/алиасы (как пользователи могут писать бренд):
{brand_aliases}

Задача: для каждого сообщения выбрать только одно:
- "keep" — если сообщение относится к бренду/магазину/сети/приложению/бонусам/покупкам/ассортименту/скидкам/сервису.
- "drop" — если это явно НЕ про бренд как магазин/приложение/сервис.

ПРАВИЛО ПО УМОЛЧАНИЮ: если есть сомнения — выбирай "keep".

Важно:
- Возвращай строго JSON по схеме.
- Никаких пояснений, причин, текста — только JSON.
""".strip()
RELEVANCE_HEAD = ["Для каждой строки верни action=keep|drop.", "Сохраняй global_idx как есть. Верни ровно столько results, сколько входных строк."]
RELEVANCE_TAIL = "\nВерни JSON строго по схеме: {results: [{global_idx, action}, ...]}"
SENTIMENT_SYSTEM = """
Ты классификатор тональности русскоязычных отзывов/комментариев.
Для каждого текста верни только label: negative | neutral | positive.
Никаких пояснений и лишнего текста — только JSON по схеме.
""".strip()
CATEGORY_SYSTEM = "Ты — аналитик отзывов. Следуй инструкции пользователя и верни строго JSON."
SENTIMENT_HEAD = ["Определи тональность каждого пункта.", "Верни JSON строго по схеме: {results:[{global_idx,label},...]}"]
ALLOWED_HEAD = "Разрешённые категории (выбирай строго из списка):\n"
CATEGORY_RULES = """ИНСТРУКЦИЯ:
- Для каждого ITEM выбери ОДНУ категорию по основной теме.
- Верни СТРОГО JSON без пояснений.

Формат:
{
  "results": [
    {"global_idx": 0, "category": "..." },
    ...
  ]
}

ITEM'ы:
"""
EXAMPLES_HEAD = "Похожие примеры из предразметки:\n"
NO_EXAMPLES = "(нет примеров)"


def system_prompt(template: str, name: str, description: str, aliases: list[str]) -> str:
    """The template with the brand's words; a dash for what is missing."""
    known = ", ".join(a.strip() for a in aliases or [] if str(a).strip())
    return template.format(brand_name=(name or "BRAND").strip(), brand_description=(description or "").strip() or "—", brand_aliases=known or "—").strip()


def line_prompt(items: Column, head: list[str] = RELEVANCE_HEAD, tail: str | None = RELEVANCE_TAIL) -> Column:
    """For items: an array of structs idx, txt. The sentiment prompt has no tail."""
    told = F.transform(items, lambda x: F.concat(x["idx"].cast("string"), F.lit(": "), x["txt"]))
    return F.array_join(F.concat(F.array(*map(F.lit, head)), told, F.array(*([F.lit(tail)] if tail else [])).cast("array<string>")), "\n")


def category_item(idx: Column, text: Column, neighbours: Column | None = None, text_chars: int = 700, neighbour_chars: int = 240) -> Column:
    """One item's block; neighbours: an array of structs text, category, null or empty for none."""
    block = F.concat(F.lit("[ITEM "), idx.cast("string"), F.lit(']\nТекст:\n"""'), clipped(text, text_chars), F.lit('"""\n'))
    if neighbours is None:
        return block
    one = lambda n, j: F.concat(F.lit("[пример "), (j + 1).cast("string"), F.lit("] Категория: "), n["category"], F.lit(" | Текст: "), clipped(n["text"], neighbour_chars))
    told = F.when(F.coalesce(F.size(neighbours), F.lit(0)) > 0, F.array_join(F.transform(neighbours, one), "\n")).otherwise(F.lit(NO_EXAMPLES))
    return F.concat(block, F.lit(EXAMPLES_HEAD), told, F.lit("\n"))


def category_prompt(user_prompt: str, blocks: Column, allowed: list[str] | None = None) -> Column:
    """The whole prompt of a batch of item blocks (an array)."""
    allowed_block = ALLOWED_HEAD + "\n".join(f"- {c}" for c in allowed) if allowed else ""
    return ustrip(F.concat(F.lit(f"\n{user_prompt.strip()}\n\n{allowed_block}\n\n{CATEGORY_RULES}"), F.array_join(blocks, "\n"), F.lit("\n")))
