"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing.

Each partition is packed on its own, without a shuffle, in blocks of bounded
size: documents are tokenised, runs of whole windows are cut off, and the
rests, cut into pieces, are dealt out to the least count of windows that can
hold them by merging partial partitions with opposing imbalances. While the
fullest window exceeds the capacity, the count rises by one.

Null texts count as empty and hold only the end id; repeated rows are packed
each; an empty table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, slices, text_column

CAPACITY = 1024
#: Rests are cut into pieces of this many ids at most; small ones balance well.
PIECE = 256
#: Windows that one call of the differencing method fills.
WINDOWS = 192

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(2)
def encoder(path: str, ranks: str) -> Callable[[str], list[int]]:
    """What gives a text the ids of the tokenizer file at path, without special tokens around it.

    The rank file has the same vocabulary and merges, and a library that is
    several times as fast, but no added tokens. So texts that hold the string
    of one of the tokenizer file's added tokens go to the tokenizer itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    named = Tokenizer.from_file(path)
    added = [token.content for token in named.get_added_tokens_decoder().values()]
    with open(ranks, "rb") as f:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    plain = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}).encode_ordinary
    return lambda text: named.encode(text, add_special_tokens=False).ids if any(a in text for a in added) else plain(text)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def rank_file() -> str:
    """The rank file with the same vocabulary and ids as byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The set of 0 to k-1 that each size goes to: Karmarkar-Karp differencing, k ways.

    A partial partition has k sums, descending; the two of the largest spread
    merge, the largest sums of one with the smallest of the other.
    """
    n = len(sizes)
    if k <= 1 or not n:
        return np.zeros(n, np.int64)
    # Each partial partition keeps only its non-zero sums; the rest are zeros.
    heap, sums, sets = [], {}, {}
    for i, x in enumerate(sizes.tolist()):
        heap.append((-x, i))
        sums[i], sets[i] = np.array([x], np.int64), [[i]]
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        left, right, in_left, in_right = sums.pop(a), sums.pop(b), sets.pop(a), sets.pop(b)
        over = max(0, len(left) + len(right) - k)
        total = np.concatenate([left, right[: len(right) - over]])
        members = in_left + in_right[: len(right) - over]
        if over:  # the smallest of the one meet the largest of the other
            tail = range(len(right) - over, len(right))
            for j, at in zip(tail, range(len(left) - 1, len(left) - 1 - over, -1) if over <= len(left) else (), strict=True):
                total[at] += right[j]
                members[at] = members[at] + in_right[j]
        order = np.argsort(-total, kind="stable")
        total, members = total[order], [members[x] for x in order]
        if len(total) == k and total[-1]:
            total = total - total[-1]  # only differences matter
        sums[fresh], sets[fresh] = total, members
        heapq.heappush(heap, (-int(total[0] - (total[-1] if len(total) == k else 0)), fresh))
        fresh += 1
    out = np.zeros(n, np.int64)
    for where, members in enumerate(sets[heap[0][1]]):
        out[members] = where
    return out


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each piece; as few windows as the differencing method can keep within capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        to = difference(sizes, k)
        if np.bincount(to, sizes, k).max(initial=0) <= capacity:
            return to
        k += 1


def pack(df: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, ranks: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents: rows of SCHEMA. Sequence ids are unique, not consecutive.

    tokenizer and ranks: a tokenizer file and the rank file of its vocabulary.
    """
    importable(df.sparkSession)
    files = tokenizer or tokenizer_file(), ranks or rank_file()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        encode = encoder(*files)
        full: list[tuple] = []
        rests: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, held
            rows = full.copy()
            if rests:
                to = windows(np.array([r[2] for r in rests], np.int64), capacity)
                offset = [0] * (int(to.max()) + 1)
                for r, w in zip(rests, to.tolist()):
                    rows.append((*r, sequence + w, offset[w]))
                    offset[w] += r[2]
                sequence += len(offset)
            full.clear()
            rests.clear()
            held = 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for part in slices(batch, "text"):
                for key, words in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*encode(words), end_id], "<u4")
                    start, n = 0, len(ids)
                    while n - start >= capacity:
                        full.append((key, start, capacity, zlib.crc32(ids[start : start + capacity]), n, sequence, 0))
                        sequence += 1
                        start += capacity
                    while start < n:
                        stop = min(n, start + PIECE)
                        rests.append((key, start, stop - start, zlib.crc32(ids[start:stop]), n))
                        held += stop - start
                        start = stop
                    if held >= WINDOWS * capacity or len(full) >= 20_000:
                        yield from flush()
        yield from flush()

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text")).mapInArrow(run, SCHEMA)
