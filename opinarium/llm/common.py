"""What the operators share: inputs, tables in the shared folder, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import written  # noqa: F401
from ..sources.readers import scan

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small file is dealt out over the cores."""
    return scan(spark, f"{sf_dir}/{name}.parquet")


def remove(*tables: DataFrame) -> None:
    """Deletes the files of tables that written() made, once no plan reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def text_column(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for each end of edges (src, dst): the smallest node reachable.

    Minimum labels pass over edges, then pointers jump; both are equi-joins
    and minimum aggregates, so a hub's edges are split by AQE or combined
    before the shuffle. Labels are written to the shared folder in each round.
    """
    both = edges.select("src", "dst").where("src <> dst")
    both = written(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), f"{name}-edges")
    labels = written(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("component")), name)
    while True:
        far = labels.select(F.col("node").alias("dst"), F.col("component").alias("offer"))
        offers = both.join(far, "dst").groupBy("src").agg(F.min("offer").alias("offer"))
        nearer = labels.join(offers, F.col("node") == F.col("src")).select("node", "component", F.least("component", "offer").alias("offer"))
        jump = labels.select(F.col("node").alias("offer"), F.col("component").alias("further"))
        after = nearer.join(jump, "offer", "left").select("node", F.least("offer", F.coalesce("further", "offer")).alias("component"), F.col("component").alias("was"))
        after = written(after, name)
        done = after.where("component <> was").isEmpty()
        remove(labels)
        labels = after.select("node", "component")
        if done:
            remove(both)
            return labels


# --- numpy hashing over the bytes of many texts at once ---

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, factor: int = MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd factor modulo 2**64, and of its inverse."""
    if factor not in _powers or len(_powers[factor][0]) < n:
        size = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers[factor] = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64), dtype=np.uint64)]) for x in (factor, pow(factor, -1, 1 << 64)))
    return _powers[factor][0][:n], _powers[factor][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 with all bits mixed."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A uint64 for each word of UTF-8 bytes, and where it starts; words end at ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blank = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(data: bytes) -> np.ndarray:
    return words_of(data)[0]


def shingle_hashes(data: bytes, width: int = 5) -> np.ndarray:
    """A uint64 for each run of width words; a shorter text with words is one shingle."""
    words = word_hashes(data)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mix(out * np.uint64(MULTIPLIER) + words[k : k + n])
    return out


# --- Arrow maps ---


def importable(spark: SparkSession) -> None:
    """Workers find this package where the driver found it, and give memory back that they no longer use."""
    env = spark.sparkContext.environment
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "1"), ("MALLOC_TRIM_THRESHOLD_", "4194304"), ("MALLOC_MMAP_THRESHOLD_", "1048576")):
        env.setdefault(name, value)
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Parts of a batch with about most bytes in a column at most, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, np.cumsum(sizes)
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(df: DataFrame, made: T.StructType, make: Callable, inputs: list[str], sliced: str | None = None, most: int = 4 << 20) -> DataFrame:
    """df with the columns that make returns; they replace columns of the same names.

    make takes a list (of Python values) for each input and returns a list
    or an Arrow array for each field of made.
    """
    importable(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in made.names]
    schema = T.StructType(keep + list(made.fields))
    types = to_arrow_schema(made)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, sliced, most) if sliced else [batch]:
                given = [part.column(x).to_pylist() for x in inputs]
                new = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for x, f in zip(make(*given), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in keep] + new, names=schema.names)

    return df.mapInArrow(run, schema)
