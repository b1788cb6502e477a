"""Relevance: rules first, then a model for what they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, prompts, spans, text
from ..plans.config import BrandProfile, Hook, PipelineConfig
from . import models
from .answerlog import AnswerLog
from .backends import Classifier, answered
from .merge import merge_actions
from .metrics import Counts
from .rules import sure_drop


def preprocessed(col: Column, brand: str, max_words: int, topic: str | None = None, script: str | None = text.CYRILLIC, entities: bool = True) -> Column:
    """Cleaned, gated and cut to the span around the brand (and topic); null where the gates reject."""
    return spans.relevant_span(text.preprocess_base(col, brand, script, entities), brand, max_words, topic)


def for_model(col: Column, profile: BrandProfile, max_words: int = 250, extra: str = "", script: str | None = text.CYRILLIC) -> Column:
    """The preprocessed text, or the text itself where there is none."""
    return text.or_fallback(preprocessed(col, profile.brand(extra), max_words, script=script), col)


def with_rule_columns(df: DataFrame, profile: BrandProfile, config: PipelineConfig) -> DataFrame:
    """df with text_rule, rule_code, pattern and asked (whether the model is to decide)."""
    out = df.withColumn("text_rule", text.prepare_comment(text.given(F.col(config.text), config.compat_nan), config.truncate_chars))
    out = out.withColumn("_rule", sure_drop(F.col("text_rule"), profile))
    return out.withColumns({"rule_code": F.col("_rule.rule_code"), "pattern": F.col("_rule.pattern"), "asked": F.col("_rule").isNull()}).drop("_rule")


def asked_model(items: DataFrame, row_id: str, txt: str, profile: BrandProfile, model: models.Model, config: PipelineConfig = PipelineConfig(), template: str = prompts.SYSTEM_TEMPLATE, log: AnswerLog | None = None, counts: Counts | None = None) -> DataFrame:
    """(row_id, answer, pos, latency_s): a language model's keep or drop for items, by the brand's system prompt and batches of numbered lines."""
    model = models.configured(model, temperature=config.temperature)
    found = models.answers(items, row_id, txt, profile.system_prompt(template), prompts.line_prompt, model, answers.RELEVANCE, "action", config.batch_size, config.workers, log, counts)
    return found.where(F.col("answer").isin("keep", "drop"))


def classify(df: DataFrame, row_id: str, profile: BrandProfile, backend: Classifier | models.Model, config: PipelineConfig = PipelineConfig(), script: str | None = text.CYRILLIC, template: str = prompts.SYSTEM_TEMPLATE, preprocess: Hook | None = None, log: AnswerLog | None = None, counts: Counts | None = None) -> DataFrame:
    """df with text_rule, rule_code, pattern, asked, action (keep or drop) and is_drop (Yes or No).

    Only rows that no rule drops are preprocessed (by preprocess, if given)
    and reach the backend, a classifier or a language model; rows it doesn't
    answer for are kept. log: a language model isn't asked again for what the
    log has. counts: takes the number and latency of its batches.
    """
    models.require_ready(backend)
    ruled = with_rule_columns(df, profile, config)
    txt = preprocess(F.col("text_rule")) if preprocess else for_model(F.col("text_rule"), profile, config.max_words, config.extra_brand_patterns, script)
    if hasattr(backend, "ask"):
        # Exploded: a filter would be pushed below (also below where a table is dealt out) and try the rules on texts of its own.
        left = ruled.select(row_id, F.explode(F.when(F.col("asked"), F.array("text_rule")).otherwise(F.array().cast("array<string>"))).alias("text_rule"))
        found = asked_model(left.select(row_id, txt.alias("txt")), row_id, "txt", profile, backend, config, template, log, counts)
        out = merge_actions(ruled, found.select(row_id, F.col("answer").alias("action"), "pos"), row_id)
    else:
        told = answered(ruled.withColumn("_txt", F.when(F.col("asked"), txt)), row_id, "_txt", backend, config.batch_size, "_told")
        out = told.withColumn("action", F.when(~F.col("asked") | (F.col("_told") == "drop"), "drop").otherwise("keep")).drop("_txt", "_told")
    return out.withColumn("is_drop", F.when(F.col("action") == "drop", "Yes").otherwise("No"))


def classify_one(spark, comment: str, profile: BrandProfile, backend: Classifier, config: PipelineConfig = PipelineConfig()) -> dict:
    """action, source (rule or llm), rule_code and pattern for one comment, by the same plan."""
    df = spark.createDataFrame([(0, comment)], f"row_id long, `{config.text}` string")
    row = classify(df, "row_id", profile, backend, config).first()
    return {"action": row["action"], "source": "llm" if row["asked"] else "rule", "rule_code": row["rule_code"], "pattern": row["pattern"]}
