"""The three jobs: one comment, a file of comments, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import categories, metrics, relevance, sentiment
from ..operators.answerlog import AnswerLog
from ..operators.backends import Classifier, Embedder, KeepAll
from ..operators.batching import with_row_id
from ..operators.models import Model
from .config import BrandProfile, CategoryConfig, PipelineConfig, SentimentConfig, require_columns


def comment_job(df: DataFrame, profile: BrandProfile, backend: Classifier | Model | None = None, prototypes: DataFrame | None = None, embedder: Embedder | None = None, config: PipelineConfig = PipelineConfig(), sentiments: SentimentConfig = SentimentConfig(enable_fallback=False), row_id: str | None = None, log: AnswerLog | None = None, counts: metrics.Counts | None = None) -> DataFrame:
    """df with is_drop and, where there are prototypes, sentiment and sentiment_source.

    Without a key column (row_id) rows are numbered in the order they are read.
    log: answers of language models outlive the job there. counts: see
    comment_stats().
    """
    require_columns(df, config.text)
    key = row_id or "_row_id"
    rows = df if row_id else with_row_id(df, key)
    out = relevance.classify(rows, key, profile, backend or KeepAll(), config, log=log, counts=counts).drop("text_rule", "asked", "action", "pattern")
    if config.enable_sentiment and prototypes is not None:
        out = sentiment.on_kept_rows(out, key, prototypes, embedder, profile, config, sentiments, log=log)
    if counts is not None:
        out = metrics.with_job_counts(out, counts, "sentiment" if "sentiment" in out.columns else None)
    out = out.drop("rule_code")
    return out if row_id else out.drop(key)


def comment_stats(counts: metrics.Counts, seconds: float | None = None, batch_size: int = 6) -> dict:
    """Counts of a job that was given counts, after its one action: no row, rule or model is asked again for them.

    rows, drops, keeps, rule_drops, llm_calls, sentiments if there are any, the
    mean latency of a language model's batches and, with seconds, rates.
    """
    return metrics.job_counts(counts, seconds, batch_size)


def one_comment(spark: SparkSession, comment: str, profile: BrandProfile, backend: Classifier | Model | None = None, prototypes: DataFrame | None = None, embedder: Embedder | None = None, config: PipelineConfig = PipelineConfig()) -> dict:
    """Relevance and, where there are prototypes, sentiment of one comment."""
    out = {"relevance": relevance.classify_one(spark, comment, profile, backend or KeepAll(), config), "sentiment": None}
    if prototypes is not None and config.enable_sentiment and (out["relevance"]["action"] == "keep" or not config.sentiment_only_kept):
        out["sentiment"] = sentiment.predict_one(spark, comment, prototypes, embedder, profile)
    return out


def category_job(df: DataFrame, user_prompt: str, profile: BrandProfile, backend: Classifier | Model | None = None, refs: DataFrame | None = None, embedder: Embedder | None = None, config: CategoryConfig = CategoryConfig(), row_id: str | None = None, cache: str | None = None, log: AnswerLog | None = None) -> DataFrame:
    """df with a category and its source; refs: labelled comments to take examples from; cache: a folder that keeps their index."""
    key = row_id or "_row_id"
    rows = df if row_id else with_row_id(df, key)
    index = None
    if refs is not None:
        numbered = with_row_id(refs, "_ref_id")
        index = categories.cached_index(numbered, "_ref_id", profile, embedder, config, cache) if cache else categories.index_texts(numbered, "_ref_id", profile, embedder, config)
    out = categories.tag(rows, key, user_prompt, profile, backend, index, embedder, config, log=log)
    return out if row_id else out.drop(key)
