"""Sentiment: preprocess, embed, nearest prototype, thresholds, optional model for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, prompts, text
from ..functions.labels import SENTIMENTS
from ..plans.config import BrandProfile, Hook, PipelineConfig, SentimentConfig
from ..session import written
from . import models, prototypes
from .answerlog import AnswerLog
from .backends import Classifier, Embedder, classified, with_vectors
from .merge import merge_labels
from .relevance import for_model

SCORES = ["s_negative", "s_neutral", "s_positive"]


def prepared(col: Column, profile: BrandProfile, config: SentimentConfig) -> Column:
    """Preprocessed from the whole text, only then stripped and cut."""
    return text.prepare_comment(for_model(text.given(col), profile, config.max_words), config.truncate_chars)


def predict_vectors(df: DataFrame, vector: str, protos: DataFrame, config: SentimentConfig = SentimentConfig()) -> DataFrame:
    """df with pred_label, pred_source, sim_pred and the three scores."""
    out = prototypes.apply_thresholds(prototypes.predict(df, vector, protos, config.normalize), config.thresholds)
    return prototypes.with_labels(out).withColumnRenamed("sim", "sim_pred").drop("pred", "pred4")


def predict_texts(df: DataFrame, row_id: str, col: str, protos: DataFrame, embedder: Embedder, profile: BrandProfile, config: SentimentConfig = SentimentConfig(), fallback: Classifier | models.Model | None = None, embed_batch: int = 128, preprocess: Hook | None = None, log: AnswerLog | None = None, only: Column | None = None) -> DataFrame:
    """df with text, pred_label, pred_source, sim_pred and the three scores; nulls where only, if given, isn't true.

    With a fallback (and config.enable_fallback) rows below their threshold
    take its label, and each must be answered; without one they keep theirs.
    preprocess, if given, takes the place of the standard preprocessing.
    """
    models.require_ready(embedder, fallback)
    ready = text.prepare_comment(preprocess(text.given(F.col(col))), config.truncate_chars) if preprocess else prepared(F.col(col), profile, config)
    asked = df.withColumn("text", ready if only is None else F.when(only, ready))
    out = predict_vectors(with_vectors(asked, "text", embedder, "_vector", embed_batch), "_vector", protos, config).drop("_vector")
    if only is not None:
        judged = F.col("text").isNotNull()
        out = out.withColumns({c: F.when(judged, F.col(c)) for c in ("pred_label", "pred_source", "sim_pred", "passed", *SCORES)})
    if fallback is not None and config.enable_fallback:
        out = written(out, "scored")  # two branches read it; texts are embedded once
        low = out.where("not passed").select(row_id, "text")
        told = asked_model(low, row_id, "text", fallback, config, log) if hasattr(fallback, "ask") else classified(low, row_id, "text", fallback, config.batch_size).select(F.col("row_id").alias(row_id), "answer", F.struct("batch", "pos").alias("pos"))
        told = told.where(F.col("answer").isin(*SENTIMENTS)).select(row_id, F.col("answer").alias("_label"), "pos")
        strict = merge_labels(low.select(row_id), told, "_label", row_id, strict=True)
        out = out.join(strict, row_id, "left").withColumn("pred_label", F.coalesce("_label", "pred_label")).drop("_label")
    return out.drop("passed")


def asked_model(items: DataFrame, row_id: str, txt: str, model: models.Model, config: SentimentConfig = SentimentConfig(), log: AnswerLog | None = None) -> DataFrame:
    """(row_id, answer, pos, latency_s): a language model's label for items, asked in batches of numbered lines."""
    prompt = lambda items: prompts.line_prompt(items, prompts.SENTIMENT_HEAD, None)
    return models.answers(items, row_id, txt, prompts.SENTIMENT_SYSTEM, prompt, models.configured(model, attempts=config.max_retries), answers.SENTIMENT, "label", config.batch_size, config.workers, log)


def predict_one(spark, comment: str | None, protos: DataFrame, embedder: Embedder, profile: BrandProfile, config: SentimentConfig = SentimentConfig(enable_fallback=False)) -> dict:
    """label, source, sim_pred and scores of one comment; where preprocessing leaves nothing, of the comment as it is."""
    df = spark.createDataFrame([(0, comment)], "row_id long, comment string")
    return scored_struct(predict_texts(df, "row_id", "comment", protos, embedder, profile, config)).first()["sentiment"].asDict(recursive=True)


def predict_df(df: DataFrame, row_id: str, protos: DataFrame, embedder: Embedder, profile: BrandProfile, text_col: str = "clean_text", **more) -> DataFrame:
    """df with six columns: label, source, sim and scores; text_col must be there."""
    if text_col not in df.columns:
        raise KeyError(f"column {text_col!r} is missing; there are {df.columns}")
    return predict_texts(df, row_id, text_col, protos, embedder, profile, **more).drop("text")


def scored_struct(df: DataFrame) -> DataFrame:
    """df with sentiment: a struct label, source, sim_pred, scores."""
    scores = F.struct(*(F.col(s).alias(n) for s, n in zip(SCORES, SENTIMENTS)))
    return df.withColumn("sentiment", F.struct(F.col("pred_label").alias("label"), F.col("pred_source").alias("source"), "sim_pred", scores.alias("scores")))


def on_kept_rows(df: DataFrame, row_id: str, protos: DataFrame, embedder: Embedder, profile: BrandProfile, pipeline: PipelineConfig = PipelineConfig(), config: SentimentConfig = SentimentConfig(), fallback: Classifier | models.Model | None = None, preprocess: Hook | None = None, log: AnswerLog | None = None) -> DataFrame:
    """df (with is_drop) with sentiment and sentiment_source; dropped rows have null and skip_drop. df is evaluated once."""
    only = F.lower("is_drop") == "no" if pipeline.sentiment_only_kept else None
    made = ["text", "pred_label", "pred_source", "sim_pred", *SCORES]
    given = F.col(pipeline.text).alias("_given")
    told = predict_texts(df.select(*(F.col(c).alias(f"_own_{c}") if c in made else F.col(c) for c in df.columns), given), row_id, "_given", protos, embedder, profile, config, fallback, pipeline.embed_batch_size, preprocess, log, only)
    named = [F.col(f"_own_{c}").alias(c) if c in made else F.col(c) for c in df.columns if c not in ("sentiment", "sentiment_source")]
    out = told.select(*named, F.col("pred_label").alias("sentiment"), F.col("pred_source").alias("sentiment_source"))
    return out.withColumn("sentiment_source", F.coalesce("sentiment_source", F.lit("skip_drop")))
