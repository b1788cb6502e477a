"""Category tagging with examples from labelled references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, prompts, text
from ..functions.labels import best_allowed
from ..functions.regexes import ustrip
from ..plans.config import BrandProfile, CategoryConfig, Hook, require_columns
from ..session import written
from . import models, retrieval
from .answerlog import AnswerLog
from .backends import Classifier, Embedder, classified, embedded, with_vectors
from .merge import last_answers
from .metrics import says
from .relevance import for_model
from .vectorstore import VectorStore

PRED, SOURCE = "Категория_pred", "Категория_source"


def source(dropped: Column, blank: Column, use_refs: bool) -> Column:
    """skip_drop, else skip_empty, else rag_llm or llm."""
    return F.when(dropped, "skip_drop").when(blank, "skip_empty").otherwise("rag_llm" if use_refs else "llm")


def sources(df: DataFrame, col: str, use_refs: bool, is_drop: str = "is_drop") -> DataFrame:
    """df with the source its category will have; without an is_drop column nothing is dropped."""
    dropped = says(F.col(is_drop), "yes") if is_drop in df.columns else F.lit(False)
    return df.withColumn(SOURCE, source(dropped, ustrip(text.given(F.col(col))) == "", use_refs))


def cached_index(refs: DataFrame, ref_id: str, profile: BrandProfile, embedder: Embedder, config: CategoryConfig, folder: str) -> DataFrame:
    """index_texts() with vectors that are kept in folder by content: only prepared texts that it lacks are embedded."""
    ready = _prepared_refs(refs, profile, config)
    return retrieval.build_index(VectorStore(folder).of(ready, "_text", embedder), ref_id, "_text", config.category, "vector")


def _prepared_refs(refs: DataFrame, profile: BrandProfile, config: CategoryConfig) -> DataFrame:
    require_columns(refs, config.text, config.category)
    return refs.withColumn("_text", for_model(text.prepare_comment(F.col(config.text), config.truncate_chars), profile, config.max_words))


def index_texts(refs: DataFrame, ref_id: str, profile: BrandProfile, embedder: Embedder, config: CategoryConfig = CategoryConfig()) -> DataFrame:
    """The index of labelled references: preprocessed, embedded, normalized; a table in the shared folder, so that references are embedded once."""
    return written(retrieval.build_index(with_vectors(_prepared_refs(refs, profile, config), "_text", embedder), ref_id, "_text", config.category, "vector"), "index")


class NeighbourVote:
    """An offline labeller: the category most of the examples have, the nearest first among equals."""

    def choose(self, neighbours: list[dict], allowed: list[str]) -> str | None:
        if not neighbours:
            return allowed[0] if allowed else None
        count: dict[str, int] = {}
        for n in neighbours:
            count[n["category"]] = count.get(n["category"], 0) + 1
        return max(count, key=lambda c: (count[c], -[n["category"] for n in neighbours].index(c)))


def vote(neighbours: Column) -> Column:
    """NeighbourVote as an expression over an array of neighbours."""
    names = F.transform(neighbours, lambda n: n["category"])
    ranked = F.transform(F.array_distinct(names), lambda c: F.struct(F.size(F.filter(names, lambda x: x == c)).alias("n"), (-F.array_position(names, c)).alias("first"), c.alias("c")))
    return F.array_max(ranked)["c"]


def asked_model(items: DataFrame, row_id: str, txt: str, user_prompt: str, model: models.Model, allowed: list[str] | None = None, neighbours: str | None = None, config: CategoryConfig = CategoryConfig(), log: AnswerLog | None = None) -> DataFrame:
    """(row_id, answer, pos, latency_s): a language model's category for items.

    A batch's prompt has the user's prompt, the allowed categories and each
    item's text with its neighbours (a column of items) as examples.
    """
    block = prompts.category_item(F.col(row_id), F.col(txt), F.col(neighbours) if neighbours else None)
    prompt = lambda items: prompts.category_prompt(user_prompt, F.transform(items, lambda x: x["txt"]), allowed)
    return models.answers(items.withColumn("_item", block), row_id, "_item", prompts.CATEGORY_SYSTEM, prompt, model, answers.CATEGORY, "category", config.batch_size, config.workers, log)


def mapped(told: DataFrame, row_id: str, allowed: list[str]) -> DataFrame:
    """(row_id, answer): the last answer of each row, as the allowed category that it stands for, else as it is; blank ones are null."""
    found = last_answers(told, row_id, "answer", "pos").withColumn("answer", F.nullif(ustrip(F.col("answer")), F.lit("")))
    return best_allowed(found, "answer", allowed, "_mapped").select(row_id, F.coalesce("_mapped", "answer").alias("answer")) if allowed else found


def tag(df: DataFrame, row_id: str, user_prompt: str, profile: BrandProfile, backend: Classifier | models.Model | None = None, index: DataFrame | None = None, embedder: Embedder | None = None, config: CategoryConfig = CategoryConfig(), preprocess: Hook | None = None, log: AnswerLog | None = None) -> DataFrame:
    """df with the predicted category and its source.

    Rows that are dropped or empty are skipped before any embedding. With an
    index each item carries its neighbours. A language model gets the whole
    prompt: the user's, the index's categories and the items; a classifier
    gets items; without either the neighbours' vote decides. Unanswered rows
    stay null but keep their source; an answer that fits no allowed category
    stays as it is. preprocess takes the place of the standard preprocessing.
    """
    require_columns(df, config.text)
    if not user_prompt.strip():
        raise ValueError("a prompt is needed")
    models.require_ready(backend, embedder)
    given = text.prepare_comment(F.col(config.text), config.truncate_chars)
    ready = sources(df.withColumn("_text", preprocess(given) if preprocess else for_model(given, profile, config.max_words)), "_text", index is not None)
    items = ready.where(F.col(SOURCE).isin("llm", "rag_llm")).select(row_id, "_text")
    allowed = [r[0] for r in retrieval.categories(index, "category").collect()] if index is not None else []  # the categories' names
    if index is not None:
        vectors = written(embedded(items, row_id, "_text", embedder), "vectors")  # read more than once; texts are embedded once
        near = retrieval.neighbours(vectors, index, "row_id", "vector", config.top_k).withColumnRenamed("query_id", row_id)
        items = items.join(near, row_id, "left")
    if backend is None:
        if index is None:
            raise ValueError("a backend or an index is needed")
        told = items.select(row_id, vote(F.col("neighbours")).alias("answer"), F.lit(0).alias("pos"))
    elif hasattr(backend, "ask"):
        told = asked_model(items, row_id, "_text", user_prompt, backend, allowed, "neighbours" if index is not None else None, config, log)
    else:
        asked = items.withColumn("_item", prompts.category_item(F.col(row_id), F.col("_text"), F.col("neighbours") if index is not None else None))
        told = classified(asked, row_id, "_item", backend, config.batch_size).select(F.col("row_id").alias(row_id), "answer", F.struct("batch", "pos").alias("pos"))
    found = mapped(told, row_id, allowed).select(row_id, F.col("answer").alias(PRED))
    out = ready.join(found, row_id, "left")
    return out.select(*(c for c in df.columns if c not in (PRED, SOURCE)), PRED, SOURCE)
