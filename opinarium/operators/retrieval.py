"""Nearest labelled references: exact top-k by cosine.

Queries meet references in blocks: each block of references is one matrix,
each task multiplies its queries with one block and hands on k rows a query.
A final partial aggregate merges the blocks' candidates. What is broadcast or
held in a worker is one block, whatever the size of the reference table.

Large tables are kept in cells: each reference belongs to the nearest of some
centres, and a cell's references are cut into shells by their angle to it. By
the triangle inequality no reference of a shell is nearer to a query than the
angles allow. A query first visits the shells that may be nearest, and then
those, and only those, that may hold one as near as its k-th so far, so the
result is exact, too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regexes import ustrip
from ..functions.text import given
from ..functions.vectors import doubles, l2_normalize
from ..session import importable, written

#: References in a block, and queries that meet it in one task.
BLOCK, QUERIES = 16_384, 65_536
#: Cells at most, and shells of each.
CELLS, SHELLS = 4096, 8
#: Indexes of so many references are worth cells.
WORTH_CELLS = 100_000
#: Angles are judged with this much room for rounding.
SLACK = 1e-7


def build_index(refs: DataFrame, ref_id: str, text: str, category: str, vector: str) -> DataFrame:
    """ref_id, text, category, vector (normalized) of the references."""
    return refs.where(F.col(vector).isNotNull()).select(F.col(ref_id).alias("ref_id"), F.col(text).alias("text"), F.col(category).alias("category"), l2_normalize(F.col(vector)).alias("vector"))


def categories(refs: DataFrame, category: str) -> DataFrame:
    """The distinct non-blank categories, in text order."""
    name = F.col(category).cast("string")
    return refs.where(ustrip(given(name)) != "").select(name.alias("category")).distinct().orderBy("category")


def top_k(queries: DataFrame, index: DataFrame, query_id: str, vector: str, k: int = 5, normalize: bool = True) -> DataFrame:
    """query_id, ref_id, sim and rank (from 1) of the k nearest references; ties go to the smaller ref_id.

    Exact, so every query meets every reference: the work is the product of their numbers.
    """
    importable(queries.sparkSession)
    k = max(1, int(k))
    asked = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), (l2_normalize if normalize else doubles)(F.col(vector)).alias("vector"))
    n_refs, n_queries = index.count(), asked.count()
    blocks, parts = max(1, -(-n_refs // BLOCK)), max(1, -(-n_queries // QUERIES))
    parts = max(parts, min(8, max(1, n_queries // 256)) if blocks == 1 else 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(_own("query_id", parts).alias("part"), every(blocks).alias("block"), F.col("query_id").alias("id"), "vector")
    right = index.select(every(parts).alias("part"), _own("ref_id", blocks).alias("block"), F.col("ref_id").alias("id"), "vector")
    return _nearest(_met(left, right, k), k)


def _own(col: str, n: int):
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    """query_id, ref_id, sim and rank of the k nearest of each query's candidates."""
    # k rows a query and block at most, nearest first.
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("far"), "ref_id"))), 1, k)
    merged = found.groupBy("query_id").agg(ordered.alias("near"))
    return merged.select("query_id", F.posexplode("near").alias("pos", "n")).select("query_id", F.col("n.ref_id").alias("ref_id"), (-F.col("n.far")).alias("sim"), (F.col("pos") + 1).alias("rank"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _met(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """query_id, ref_id and sim: the k nearest of right's rows (part, block, id, vector) for each of left's in the same part and block."""
    dealt = left.select("part", "block", F.lit(True).alias("asks"), "id", "vector").union(right.select("part", "block", F.lit(False).alias("asks"), "id", "vector"))
    dealt = dealt.repartition("part", "block").sortWithinPartitions("part", "block", "asks", "id")
    kind = T.StructType([T.StructField("query_id", dealt.schema["id"].dataType), T.StructField("ref_id", dealt.schema["id"].dataType), T.StructField("sim", T.DoubleType())])

    def best(q_ids: list, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        sims = q @ x.T
        take = min(k, len(ids))
        # Ties at the edge: all references as near as the k-th are looked at.
        limit = -np.partition(-sims, take - 1, 1)[:, take - 1]
        out: list[tuple] = []
        for row, (query, edge) in enumerate(zip(q_ids, limit)):
            near = np.flatnonzero(sims[row] >= edge)
            near = near[np.lexsort((ids[near], -sims[row][near]))][:take]
            out += [(query, ids[i].item(), float(sims[row][i])) for i in near]
        return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out]) for j in range(3)], names=["query_id", "ref_id", "sim"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, rows = None, [], []
        known: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            part, block, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "block", "asks"))
            edge = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
                if (part[a], block[a]) != at:
                    at, ids, rows, known = (part[a], block[a]), [], [], None
                if not asks[a]:
                    ids.append(batch.column("id").slice(a, b - a).to_numpy(zero_copy_only=False))
                    rows.append(_matrix(batch.column("vector").slice(a, b - a)))
                    continue
                if known is None and ids:
                    known, rows = (np.concatenate(ids), np.concatenate(rows)), []
                for c in range(a, b, 512) if known else ():
                    some = slice(c, min(b, c + 512))
                    yield best(batch.column("id").slice(c, some.stop - c).to_pylist(), _matrix(batch.column("vector").slice(c, some.stop - c)), *known)

    return dealt.mapInArrow(run, kind)


@dataclass(frozen=True)
class Shells:
    """The centres, and each block's cell, range of angles to its centre, and size.

    A block is a shell of a cell, or, where that is large, an equal share of it by hash.
    """

    centres: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    def reach(self, q: np.ndarray) -> np.ndarray:
        """(queries x blocks): the least angle that a reference of the block can have to a unit vector."""
        angle = np.arccos(np.clip(q @ self.centres.T, -1, 1))[:, self.cell]
        return np.maximum(0, np.maximum(angle - self.high, self.low - angle) - SLACK)


@dataclass(frozen=True)
class Cells:
    """An index in cells: rows (block, ref_id, vector) and what is known of the blocks."""

    rows: DataFrame
    shells: Shells


def _placed(index: DataFrame, centres: np.ndarray) -> DataFrame:
    """ref_id, vector, and the nearest centre (the first of equals) with the angle to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                sims = _matrix(part.column("vector")) @ centres.T
                near = sims.argmax(1)
                angle = np.arccos(np.clip(sims[np.arange(len(near)), near], -1, 1))
                yield pa.RecordBatch.from_arrays([part.column("ref_id"), part.column("vector"), pa.array(near.astype(np.int32)), pa.array(angle)], names=["ref_id", "vector", "cell", "angle"])

    rows = index.select("ref_id", "vector")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))


def _centres(rows: DataFrame, most: int) -> np.ndarray:
    """Up to most distinct vectors of rows, those of the least hashes; most is bounded."""
    hashed = rows.select(F.xxhash64("vector").alias("h"), "vector")
    least = hashed.select("h").distinct().orderBy("h").limit(most)
    found = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.any_value("vector").alias("vector")).orderBy("h").collect()
    return np.array([r["vector"] for r in found]) if found else np.zeros((0, 1))


def build_cells(index: DataFrame, cells: int | None = None) -> Cells:
    """index (ref_id, unit vectors) in about so many cells: by default twice the root of its size, CELLS
    at most, and as many again for references that are far from all centres.

    Centres are references, those whose hashes are least; of copies one.
    """
    importable(index.sparkSession)
    n = index.count()
    cells = max(1, min(CELLS, cells or round(2 * n**0.5)))
    centres = _centres(index, cells)
    placed = written(_placed(index, centres), "placed") if len(centres) else index.select("ref_id", "vector", F.lit(0).alias("cell"), F.lit(0.0).alias("angle")).limit(0)
    for _ in range(2 if len(centres) > 1 else 0):  # what is far from all centres gets some of its own
        usual = placed.agg(F.percentile_approx("angle", 0.5)).first()[0]
        more = _centres(placed.where(F.col("angle") > 3 * usual + SLACK), cells // 2)
        if len(more):
            centres = np.concatenate([centres, more])
            placed = written(_placed(index, centres), "placed")
    cuts = placed.groupBy("cell").agg(F.percentile_approx("angle", [i / SHELLS for i in range(1, SHELLS)], 1000).alias("cuts"))
    shelled = placed.join(F.broadcast(cuts), "cell").withColumn("shell", F.col("cell") * SHELLS + F.size(F.filter("cuts", lambda c: F.col("angle") > c)))  # a row a cell
    shells = {r["shell"]: r for r in shelled.groupBy("shell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect()}  # a row a shell
    first, shares, told = {}, {}, []
    for shell in sorted(shells):
        r, share = shells[shell], -(-shells[shell]["n"] // BLOCK)
        first[shell], shares[shell] = len(told), share
        told += [(shell // SHELLS, r["low"], r["high"], -(-r["n"] // share))] * share
    spark = index.sparkSession
    number = spark.createDataFrame([(s, first[s], shares[s]) for s in first], "shell int, first int, shares int")
    rows = shelled.join(F.broadcast(number), "shell").select((F.col("first") + F.pmod(F.xxhash64("ref_id"), F.col("shares"))).cast("int").alias("block"), "ref_id", "vector")
    cell, low, high, size = (np.array([t[i] for t in told], kind) for i, kind in enumerate((np.int64, float, float, np.int64)))
    return Cells(written(rows, "cells"), Shells(centres, cell, low, high, size))


def _visits(asked: DataFrame, shells: Shells, k: int, after: bool) -> DataFrame:
    """query_id, vector and block for the blocks that a query visits first: the nearest that hold k; after: for those that may still hold one as near as least."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                reach = shells.reach(_matrix(part.column("vector")))
                order = np.argsort(reach, 1, kind="stable")
                sizes = shells.size[order]
                early = np.zeros(reach.shape, bool)
                np.put_along_axis(early, order, np.cumsum(sizes, 1) - sizes < k, 1)
                if after:
                    least = np.arccos(np.clip(part.column("least").to_numpy(zero_copy_only=False), -1, 1))
                    early = ~early & (reach <= least[:, None] + SLACK)
                row, block = np.nonzero(early)
                for c in range(0, len(row), 8192):
                    yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(row[c : c + 8192])), part.column("vector").take(pa.array(row[c : c + 8192])), pa.array(block[c : c + 8192].astype(np.int32))], names=["query_id", "vector", "block"])

    return asked.mapInArrow(run, T.StructType([asked.schema["query_id"], asked.schema["vector"], T.StructField("block", T.IntegerType())]))


def visits(queries: DataFrame, cells: Cells, query_id: str, vector: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(asked, further): query_id, vector and block of the first visits, and of those that their results leave to be made."""
    importable(queries.sparkSession)
    asked = written(queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("query_id"), l2_normalize(F.col(vector)).alias("vector")), "asked")
    early = written(_visits(asked, cells.shells, k, False), "visits")
    found = _in_blocks(early, cells, k).groupBy("query_id").agg(F.sort_array(F.collect_list("sim"), asc=False).alias("sims"))
    least = asked.join(found, "query_id", "left").select("query_id", "vector", F.coalesce(F.get("sims", k - 1), F.lit(-1.0)).alias("least"))
    return early, written(_visits(least, cells.shells, k, True), "visits")


def _in_blocks(pairs: DataFrame, cells: Cells, k: int) -> DataFrame:
    most = pairs.groupBy("block").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // QUERIES))
    left = pairs.select(_own("query_id", parts).alias("part"), "block", F.col("query_id").alias("id"), "vector")
    right = cells.rows.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "block", F.col("ref_id").alias("id"), "vector")
    return _met(left, right, k)


def top_k_in_cells(queries: DataFrame, cells: Cells, query_id: str, vector: str, k: int = 5) -> DataFrame:
    """top_k() of an index in cells: the same rows, by fewer products where vectors are clustered."""
    k = max(1, int(k))
    if not len(cells.shells.cell):
        return top_k(queries, cells.rows, query_id, vector, k)
    early, further = visits(queries, cells, query_id, vector, k)
    return _nearest(_in_blocks(early.union(further), cells, k), k)


def neighbours(queries: DataFrame, index: DataFrame, query_id: str, vector: str, k: int = 5) -> DataFrame:
    """query_id and its neighbours: an array of structs text, category, similarity, nearest first. Large indexes are searched in cells."""
    large = index.limit(WORTH_CELLS).count() == WORTH_CELLS
    found = top_k_in_cells(queries, build_cells(index), query_id, vector, k) if large else top_k(queries, index, query_id, vector, k)
    near = found.join(index.select("ref_id", "text", "category"), "ref_id")
    told = F.sort_array(F.collect_list(F.struct("rank", "text", "category", F.col("sim").alias("similarity"))))
    return near.groupBy("query_id").agg(F.transform(told, lambda n: F.struct(n["text"].alias("text"), n["category"].alias("category"), n["similarity"].alias("similarity"))).alias("neighbours"))
