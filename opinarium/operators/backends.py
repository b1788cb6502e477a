"""Model backends: deterministic offline ones, and network ones made lazily on executors.

A backend is a small picklable object; classify() takes [(id, text)] and
returns [(id, answer)], embed() takes texts and returns vectors. Spark may
run a task again, so answers should depend on their input only.
"""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import importable

TOKEN = re.compile("[A-Za-zА-Яа-яЁё0-9]+")


class Classifier(Protocol):
    def classify(self, items: list[tuple[int, str]]) -> list[tuple[int, str]]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class KeepAll:
    """When in doubt, keep."""

    def classify(self, items):
        return [(i, "keep") for i, _ in items]


class AliasMatch:
    """Keeps texts that hold one of the patterns, ignoring case."""

    def __init__(self, patterns: list[str]):
        self.pattern = "|".join(patterns)

    def classify(self, items):
        found = re.compile(self.pattern, re.IGNORECASE)
        return [(i, "keep" if found.search(t or "") else "drop") for i, t in items]


class FirstToken:
    """Answers with one of the labels, by the MD5 of the text's first token: a stand-in for a labeller."""

    def __init__(self, labels: list[str]):
        self.labels = labels

    def classify(self, items):
        out = []
        for i, t in items:
            first = next(iter(TOKEN.findall((t or "").lower())), "")
            out.append((i, self.labels[int(hashlib.md5(first.encode()).hexdigest()[:8], 16) % len(self.labels)]))
        return out


class HashingEmbedder:
    """Counts of tokens in buckets by MD5."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts):
        out = []
        for t in texts:
            v = [0.0] * self.dimensions
            for token in TOKEN.findall((t or "").lower()):
                v[int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dimensions] += 1.0
            out.append(v)
        return out


class LocalModelEmbedder:
    """A sentence-transformers model, loaded once a worker; vectors aren't normalized."""

    _models: dict = {}

    def __init__(self, model: str, batch_size: int = 64, device: str | None = None):
        self.model, self.batch_size, self.device = model, batch_size, device

    def embed(self, texts):
        if self.model not in self._models:
            from sentence_transformers import SentenceTransformer

            self._models[self.model] = SentenceTransformer(self.model, device=self.device)
        return self._models[self.model].encode([t or "" for t in texts], batch_size=self.batch_size, convert_to_numpy=True, normalize_embeddings=False).tolist()


def with_retries(call: Callable, retryable: tuple[type[Exception], ...], attempts: int = 6):
    """call() again after retryable errors, with growing pauses; then RuntimeError."""
    for attempt in range(attempts):
        try:
            return call()
        except retryable:
            time.sleep(min(8.0, 0.5 * 2**attempt) + random.random() * 0.2)
    raise RuntimeError("no answer after all attempts")


_clients: dict = {}


def client_of(name: str, make_client: Callable):
    """The client kept under name in this worker, made at the first call."""
    if name not in _clients:
        _clients[name] = make_client()
    return _clients[name]


class ApiEmbedder:
    """Embeddings of an API client that make_client() makes on the executor; missing texts are empty, answers are put in order."""

    def __init__(self, make_client: Callable, model: str, dimensions: int | None = None, batch_size: int = 128):
        self.make_client, self.model, self.dimensions, self.batch_size = make_client, model, dimensions, batch_size

    def embed(self, texts):
        client, out = client_of(f"embedder {self.model}", self.make_client), []
        more = {"dimensions": self.dimensions} if self.dimensions else {}
        for i in range(0, len(texts), self.batch_size):
            answer = client.embeddings.create(model=self.model, input=[t or "" for t in texts[i : i + self.batch_size]], **more)
            out += [d.embedding for d in sorted(answer.data, key=lambda d: d.index)]
        return out


class ApiClassifier:
    """Answers of a language model: make_prompt(items) is put to ask(client, prompt), parse(text) gives [(id, answer)]."""

    def __init__(self, make_client: Callable, ask: Callable, make_prompt: Callable, parse: Callable, retryable: tuple = (ConnectionError, TimeoutError), attempts: int = 6, name: str = "classifier"):
        self.name, self.make_client, self.ask, self.make_prompt, self.parse, self.retryable, self.attempts = name, make_client, ask, make_prompt, parse, retryable, attempts

    def classify(self, items):
        client, prompt = client_of(self.name, self.make_client), self.make_prompt(items)
        return self.parse(with_retries(lambda: self.ask(client, prompt), self.retryable, self.attempts))


def classified(df: DataFrame, row_id: str, text: str, backend: Classifier, batch_size: int) -> DataFrame:
    """(row_id, batch, pos, answer, latency_s) for the rows of df, asked in batches within each partition.

    Only row_id and text reach Python. Answers for ids outside their batch are dropped.
    """
    importable(df.sparkSession)
    schema = "row_id long, batch long, pos int, answer string, latency_s double"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def ask(items):
            nonlocal number
            began = time.perf_counter()
            told = backend.classify(items)
            took, known = time.perf_counter() - began, {i for i, _ in items}
            rows = [(i, number, pos, a, took) for pos, (i, a) in enumerate(told) if i in known]
            number += 1
            return rows

        held: list[tuple[int, str]] = []
        for batch in batches:
            rows = []
            for item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(item)
                if len(held) == batch_size:
                    rows += ask(held)
                    held = []
            yield _rows(rows)
        if held:
            yield _rows(ask(held))

    def _rows(rows):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return df.select(df[row_id].cast("long").alias("row_id"), df[text].alias("text")).mapInArrow(run, schema)


def answered(df: DataFrame, row_id: str, text: str, backend: Classifier, batch_size: int, to: str) -> DataFrame:
    """df with to, the backend's last answer for each row, null for rows without a text: no join, and df is evaluated once.

    Rows are asked in batches within what Arrow hands over at once; answers for ids outside a batch are dropped.
    """
    importable(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, item) for n, item in enumerate(zip(batch.column(row_id).to_pylist(), batch.column(text).to_pylist())) if item[1] is not None]
            found: list[str | None] = [None] * batch.num_rows
            for start in range(0, len(rows), batch_size):
                part = rows[start : start + batch_size]
                told = dict(backend.classify([item for _, item in part]))
                for n, (i, _) in part:
                    found[n] = told.get(i)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def embedded(df: DataFrame, row_id: str, text: str, backend: Embedder, batch_size: int = 128) -> DataFrame:
    """(row_id, vector) for the rows of df."""
    importable(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [v for i in range(0, len(texts), batch_size) for v in backend.embed(texts[i : i + batch_size])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32()))], names=["row_id", "vector"])

    return df.select(df[row_id].cast("long").alias("row_id"), df[text].alias("text")).mapInArrow(run, "row_id long, vector array<float>")


def with_vectors(df: DataFrame, text: str, backend: Embedder, to: str = "vector", batch_size: int = 128) -> DataFrame:
    """df with to, the text's vector, null for rows without a text: no join, and df is evaluated once."""
    importable(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.FloatType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            rows = [n for n, t in enumerate(texts) if t is not None]
            found: list = [None] * len(texts)
            for start in range(0, len(rows), batch_size):
                part = rows[start : start + batch_size]
                for n, v in zip(part, backend.embed([texts[n] for n in part]), strict=True):
                    found[n] = v
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.float32()))], names=schema.names)

    return df.mapInArrow(run, schema)
