"""Comments as a stream: the row-wise operators, counts by windows, and the relevance job with remembered answers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import prompts
from ..functions.answers import RELEVANCE, results
from ..functions.text import prepare_comment
from ..operators.answerlog import AnswerLog, key_of
from ..operators.models import Model, configured, require_ready
from ..operators.relevance import for_model, with_rule_columns
from ..operators.rules import with_rules
from ..plans.config import BrandProfile, PipelineConfig
from ..session import importable


def ruled_stream(stream: DataFrame, text: str, profile: BrandProfile, truncate: int = 800) -> DataFrame:
    """The stream with rule_code, pattern and is_drop by rules: no state, no shuffle."""
    return with_rules(stream.withColumn("text_rule", prepare_comment(F.col(text), truncate)), "text_rule", profile)


def drop_counts_by_window(stream: DataFrame, ts: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows and drops in each window of event time; state goes once the watermark has passed it."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, window))
    return counts.agg(F.count("*").alias("rows"), F.count_if(F.col("is_drop") == "Yes").alias("drops")).select("window.start", "window.end", "rows", "drops")


def relevance_stream(stream: DataFrame, row_id: str, profile: BrandProfile, model: Model, config: PipelineConfig = PipelineConfig(), remember_ms: int = 7 * 24 * 3600 * 1000, log: AnswerLog | None = None, template: str = prompts.SYSTEM_TEMPLATE) -> DataFrame:
    """row_id, rule_code, pattern, asked, action and is_drop for a stream of comments, by rules and a language model.

    Rules decide first. Of the rest each distinct prepared text is asked once:
    its answer is the state of its prompt's digest, which goes when nobody has
    sent the text for remember_ms (of processing time). A batch that Spark
    replays after a failure finds its state as it was before; with a log its
    answers are found there and none is asked again. Answers that aren't JSON,
    or name another action, keep the row. Times out with later batches; a query
    that is to end (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled
    off, as Spark goes on for such time limits otherwise.
    """
    require_ready(model)
    importable(stream.sparkSession)
    asks = configured(model, temperature=config.temperature)
    system, name = profile.system_prompt(template), getattr(model, "name", type(model).__name__)
    ruled = with_rule_columns(stream, profile, config)
    kind = stream.schema[row_id].dataType.simpleString()
    dropped = ruled.where(~F.col("asked")).select(row_id, "rule_code", "pattern", "asked", F.lit("drop").alias("action"))
    text = for_model(F.col("text_rule"), profile, config.max_words, config.extra_brand_patterns)
    prompt = prompts.line_prompt(F.array(F.struct(F.lit(0).cast("long").alias("idx"), text.alias("txt"))))
    left = ruled.where("asked").select(F.col(row_id).alias("id"), prompt.alias("prompt")).withColumn("key", key_of(name, system, F.col("prompt")))

    def one(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        told = state.get[0] if state.exists else None
        for part in parts:
            if told is None:
                ask = lambda: asks.ask(system, part["prompt"].iloc[0])  # noqa: B023, E731
                told = log.chunk([key[0]], lambda _: [(ask(), 0.0)])[0][0] if log else ask()  # noqa: B023
            yield pd.DataFrame({"id": part["id"], "told": told})
        state.update((told,))
        state.setTimeoutDuration(remember_ms)

    found = left.groupBy("key").applyInPandasWithState(one, f"id {kind}, told string", "told string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    answer = F.element_at(F.filter(results(F.col("told"), RELEVANCE), lambda r: r["global_idx"] == 0), -1)["action"]
    judged = found.select(F.col("id").alias(row_id), F.lit(None).cast("string").alias("rule_code"), F.lit(None).cast("string").alias("pattern"), F.lit(True).alias("asked"), F.when(answer == "drop", "drop").otherwise("keep").alias("action"))
    return dropped.unionByName(judged).withColumn("is_drop", F.when(F.col("action") == "drop", "Yes").otherwise("No"))
