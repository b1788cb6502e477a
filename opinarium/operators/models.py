"""Language models: prompts and answers are columns, only the call itself is Python.

A model is a small picklable object whose ask(system, prompt) returns text.
A batch of items is one row: its prompt is built by expressions, the answer's
JSON is parsed by expressions. Spark may run a task again, and a plan may have
two actions; with an answer log (see answerlog) no prompt is asked twice even so.
"""

from __future__ import annotations

import copy
import json
import os
import re
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import results
from ..session import importable
from .answerlog import AnswerLog, key_of, told_once
from .backends import client_of, with_retries
from .batching import gathered, numbered_batches
from .metrics import Counts


#: Calls for an answer where neither model nor job say how many.
ATTEMPTS = 6


class Model(Protocol):
    def ask(self, system: str, prompt: str) -> str: ...


def api_key(name: str, secrets: str | None = None, required: bool = False) -> str | None:
    """A key from the environment, else from a TOML file of secrets; a missing one is null, or an exit where it is required."""
    found = os.environ.get(name, "").strip()
    if not found and secrets and os.path.exists(secrets):
        import tomllib

        with open(secrets, "rb") as f:
            found = str(tomllib.load(f).get(name) or "").strip()
    if not found and required:
        raise SystemExit(f"{name} is neither in the environment nor in {secrets}")
    return found or None


class ChatModel:
    """A model behind an API client.

    make_client() is called once a worker and kept under name; call(client,
    system, prompt, temperature) returns the answer's text and is tried again,
    with growing pauses, after errors in retryable. A temperature or a number
    of attempts that is not given is the job's.
    """

    def __init__(self, name: str, make_client: Callable[[], Any], call: Callable[[Any, str, str, float], str], temperature: float | None = None, attempts: int | None = None, retryable: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), key: str | None = None):
        self.name, self.make_client, self.call, self.temperature, self.attempts, self.retryable, self.key = name, make_client, call, temperature, attempts, retryable, key

    def missing(self) -> str | None:
        """What keeps the model from being asked: null if nothing does."""
        return f"the environment has no {self.key}" if self.key and not api_key(self.key) else None

    def ask(self, system: str, prompt: str) -> str:
        client = client_of(self.name, self.make_client)
        return with_retries(lambda: self.call(client, system, prompt, self.temperature or 0.0), self.retryable, ATTEMPTS if self.attempts is None else self.attempts)


def configured(model: object, **settings: float | int) -> object:
    """model with a job's settings (temperature, attempts) where it has them and they are not given."""
    fresh = {k: v for k, v in settings.items() if getattr(model, k, 0) is None}
    if not fresh:
        return model
    out = copy.copy(model)
    vars(out).update(fresh)
    return out


def require_ready(*used: object) -> None:
    """An error before a job starts if a model or backend (a null is none) says that something is missing; offline ones need nothing."""
    for model in used:
        if why := getattr(model, "missing", lambda: None)():
            raise RuntimeError(f"{getattr(model, 'name', model)} can't be asked: {why}")


_LINE = re.compile(r"^(\d+): ", re.M)


class PatternModel:
    """Answers prompts of numbered lines offline: an item is kept if one of the patterns is in it, ignoring case."""

    def __init__(self, patterns: list[str]):
        self.pattern = "|".join(patterns)

    def ask(self, system, prompt):
        found, parts = re.compile(self.pattern, re.IGNORECASE), _LINE.split(prompt.rpartition("\n\n")[0])
        return json.dumps({"results": [{"global_idx": int(i), "action": "keep" if found.search(t) else "drop"} for i, t in zip(parts[1::2], parts[2::2])]})


class FirstExample:
    """Answers category prompts offline: an item's nearest example, without one the first allowed category."""

    item, example, allowed = re.compile(r"^\[ITEM (\d+)\]$", re.M), re.compile(r"^\[[^\]]* 1\] [^:]*: (.*?) \| ", re.M), re.compile(r"^- (.*)$", re.M)

    def ask(self, system, prompt):
        parts = self.item.split(prompt)
        first = next(iter(self.allowed.findall(parts[0])), "")
        told = [(int(i), m[1] if (m := self.example.search(t)) else first) for i, t in zip(parts[1::2], parts[2::2])]
        return "Ответ: " + json.dumps({"results": [{"global_idx": i, "category": c} for i, c in told]}, ensure_ascii=False)


def batches(items: DataFrame, row_id: str, text: str, size: int) -> DataFrame:
    """batch_id and items (idx, txt): consecutive batches in the order of row_id."""
    return gathered(numbered_batches(items.select(F.col(row_id).cast("long").alias("idx"), F.col(text).alias("txt")), "idx", size), "batch_id", "idx", "txt")


def told(asked: DataFrame, system: str, prompt: Column, model: Model, workers: int = 3, log: AnswerLog | None = None) -> DataFrame:
    """asked with told and latency_s, the model's answer to each row's prompt; a task has up to workers calls under way.

    log: answers are taken from there, and each new one is put there before a task goes on.
    """
    importable(asked.sparkSession)
    keep = asked.columns
    schema = T.StructType([*asked.schema.fields, T.StructField("told", T.StringType()), T.StructField("latency_s", T.DoubleType())])

    def one(text: str) -> tuple[str, float]:
        began = time.perf_counter()
        return model.ask(system, text), time.perf_counter() - began

    def all_of(texts: list[str]) -> list[tuple[str, float]]:
        with ThreadPoolExecutor(max(1, workers)) as pool:
            return list(pool.map(one, texts))

    if log is not None:
        name = getattr(model, "name", None) or f"{type(model).__name__} {sorted((k, repr(v)) for k, v in getattr(model, '__dict__', {}).items())}"
        keyed = asked.withColumn("_prompt", prompt).withColumn("_key", key_of(name, system, F.col("_prompt")))
        found = told_once(keyed, "_key", "_prompt", log, all_of)
        return keyed.join(found, keyed["_key"] == found["key"]).select(*keep, "told", "latency_s")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = all_of(part.column("_prompt").to_pylist())
                new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *new], names=schema.names)

    return asked.withColumn("_prompt", prompt).mapInArrow(run, schema)


def answers(items: DataFrame, row_id: str, text: str, system: str, prompt: Callable[[Column], Column], model: Model, schema: str, field: str, size: int, workers: int, log: AnswerLog | None = None, counts: Counts | None = None) -> DataFrame:
    """(row_id, answer, pos, latency_s) for items asked in batches of size.

    log: see told(). counts: takes the number of batches and their mean latency from the run itself. prompt makes a batch's prompt of its items. Rows of an answer whose id is
    not in its batch are dropped; so are answers without valid JSON.
    """
    require_ready(model)
    asked = batches(items, row_id, text, size).select("batch_id", F.col("items.idx").alias("ids"), prompt(F.col("items")).alias("_text"))
    every = told(asked, system, F.col("_text"), model, workers, log)
    if counts is not None:
        every = counts.of(every, F.count("*").alias("batches"), F.avg("latency_s").alias("mean_batch_latency_s"))
    found = every.select("batch_id", "ids", "latency_s", F.posexplode(results(F.col("told"), schema)).alias("place", "row"))
    found = found.where(F.array_contains("ids", F.col("row.global_idx")))
    return found.select(F.col("row.global_idx").alias(row_id), F.col("row")[field].alias("answer"), F.struct("batch_id", "place").alias("pos"), "latency_s")
