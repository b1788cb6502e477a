"""Answers that outlive the tasks that asked for them.

A log is a folder. Each prompt has a key, the digest of the model's name, the
system prompt and the prompt. Keys that the log has aren't asked again; of the
rest each is asked once, however often it occurs. A task asks in chunks, in the
order of keys, and writes a chunk's answers to the log before it goes on. So
what a failed task, a failed job or a second action had answered is read, not
asked: a chunk's file has the digest of its keys for a name. Two attempts that
run at the same time may ask the same.

The folder may be of any kind that PyArrow's file systems open (a local or
mounted path, hdfs, s3, gs); all executors must see it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

#: Prompts that a task asks for before it writes.
CHUNK = 16
SCHEMA = "key string, told string, latency_s double"
_ARROW = pa.schema([("key", pa.string()), ("told", pa.string()), ("latency_s", pa.float64())])


def key_of(model: str, system: str, prompt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(model), F.lit(system), prompt), 256)


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)


class AnswerLog:
    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def answers(self, spark: SparkSession) -> DataFrame:
        """SCHEMA: all answers so far, one for each key."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(where) or not any(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(where)):
            return spark.createDataFrame([], SCHEMA)
        return spark.read.schema(SCHEMA).parquet(self.folder).dropDuplicates(["key"])

    def chunk(self, keys: list[str], ask: Callable[[list[int]], list[tuple[str, float]]]) -> list[tuple[str, float]]:
        """(answer, seconds) for each key: of the log if it has this chunk, else of ask(places), which are logged first."""
        fs, root = _place(self.folder)
        path = f"{root}/{hashlib.sha256(' '.join(keys).encode()).hexdigest()}.parquet"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            found = ask(list(range(len(keys))))
            fs.create_dir(root, recursive=True)
            draft = f"{root}/_{uuid.uuid4().hex}"
            pq.write_table(pa.table([keys, [f[0] for f in found], [f[1] for f in found]], schema=_ARROW), draft, filesystem=fs)
            fs.move(draft, path)
            return found
        told = {r["key"]: (r["told"], r["latency_s"]) for r in pq.read_table(path, filesystem=fs).to_pylist()}
        return [told[k] for k in keys]


def told_once(asked: DataFrame, key: str, prompt: str, log: AnswerLog, call: Callable[[list[str]], list[tuple[str, float]]], chunk: int = CHUNK) -> DataFrame:
    """key, told and latency_s for each distinct key of asked (key, prompt); call answers a list of prompts."""
    importable(asked.sparkSession)
    known = log.answers(asked.sparkSession)
    unseen = asked.select(F.col(key).alias("key"), F.col(prompt).alias("prompt")).groupBy("key").agg(F.any_value("prompt").alias("prompt")).join(known.select("key"), "key", "left_anti").sortWithinPartitions("key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prompts = batch.column("key").to_pylist(), batch.column("prompt").to_pylist()
            for a in range(0, len(keys), chunk):
                some, texts = keys[a : a + chunk], prompts[a : a + chunk]
                found = log.chunk(some, lambda places: call([texts[i] for i in places]))  # noqa: B023
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=_ARROW)

    new = unseen.mapInArrow(run, SCHEMA)
    return known.join(asked.select(F.col(key).alias("key")).distinct(), "key", "left_semi").unionByName(new)
