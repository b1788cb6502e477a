"""Ranked lexical search over a clustered index of documents in bisected order.

Each partition's documents make shards of bounded size, without a shuffle.
Within a shard, recursive graph bisection reorders documents: every set is
halved, and pairs of documents swap halves while that lowers the estimated cost
of the logarithmic gaps between the documents of a term; halves are halved in
turn until they are clusters of CLUSTER documents at most. The index is one row
a cluster: its terms, a bound for each (the highest count, the shortest
document; no score falls with the one or rises with the other, so the bound
holds whatever the corpus' totals are), and their postings. Rows are short and
row groups small, so a reader holds little of it whatever its size. It covers
all documents, and can be added to.

A search sums the clusters' totals and frequencies, visits the shards whose best
cluster promises most for an item, takes its k-th score as a threshold, and
then visits, in all shards, the clusters by their bounds, highest first, but
none whose bound is below the threshold or below the k-th score within the
shard (or the part of it that a batch has): what is left out has fewer points than k documents, so the result is
exact. Places go back to doc_id, by which ties are told apart.

Terms are told apart by 64 bits of a hash; only a collision with an item's own
term could matter. Null texts have no terms; a null doc_id goes after others
of its score; repeated rows are documents each, and repeated items are ranked
each; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, mix, powers, slices, text_column, written

CLUSTER = 64
#: A shard is closed at so many documents or distinct terms of documents.
SHARD_DOCS, SHARD_POSTINGS = 2048, 1 << 19
#: Bytes whose terms are found at once; longer texts go in parts.
SEGMENT = 1 << 18
#: Bytes of a row group of the index; a row is looked at after each cluster.
ROW_GROUP = 4 << 20
#: Rounds of swaps for each halving.
ROUNDS = 5
#: Items searched for at once, and shards visited first for each.
ITEMS, FIRST = 500, 4
TOP = 50

_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def terms_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A uint64 for each term of UTF-8 bytes, and where it starts: runs of ASCII letters, digits and all that is not ASCII."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _TERM[raw], [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def segments(text: bytes) -> Iterator[bytes]:
    """Parts of a text of about SEGMENT bytes, cut where no term is; a longer term stays whole."""
    at = 0
    while len(text) - at > SEGMENT:
        end = at + SEGMENT
        while end < len(text):
            gap = np.flatnonzero(~_TERM[np.frombuffer(text, np.uint8, min(SEGMENT, len(text) - end), end)])
            if len(gap):
                end += int(gap[0])
                break
            end = min(len(text), end + SEGMENT)
        yield text[at:end]
        at = end
    yield text[at:]


def postings_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences), by document and term, and each document's length in terms."""
    terms, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        base = np.concatenate([[0], np.cumsum([len(part) + 1 for _, part in held])])
        term, start = terms_of(b"\n".join([part for _, part in held]))
        terms.append(term)
        docs.append(np.array([i for i, _ in held], np.int64)[np.searchsorted(base, start, "right") - 1])
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for part in segments(text):
            held.append((i, part))
            size += len(part)
            if size >= SEGMENT:
                flush()
                size = 0
    if held:
        flush()
    term, doc = np.concatenate(terms), np.concatenate(docs)
    lengths = np.bincount(doc, minlength=len(texts))
    order = np.argsort(term)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(texts) < 1 << 16 else np.int64), kind="stable")]
    term, doc = term[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]) if len(term) else [])
    return doc[first].astype(np.int32), term[first], np.diff(np.append(first, len(term))).astype(np.int32), lengths


def bisect(doc: np.ndarray, term: np.ndarray, n: int, cluster: int = CLUSTER, rounds: int = ROUNDS) -> np.ndarray:
    """The cluster of each of n documents: recursive graph bisection of documents and terms, all sets of one depth at once."""
    part = np.zeros(n, np.int64)
    sizes = np.array([n])
    # d * log2(d + 1); a term's cost in a half of size s is d * log2(s / (d + 1)).
    table = np.arange(n + 2) * np.log2(np.arange(n + 2) + 1)
    while sizes.max(initial=0) > cluster:
        by_part = np.argsort(part, kind="stable")
        begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        rank = np.empty(n, np.int64)
        rank[by_part] = np.arange(n) - np.repeat(begin, sizes)
        left = (sizes + 1) // 2
        side = (rank >= left[part]).astype(np.int8)
        # Terms in one document of a set don't change its cost; the others' pairs of set and term get dense numbers.
        key = part[doc] * (int(term.max(initial=0)) + 1) + term
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, bool)
        pair = np.cumsum(fresh) - 1
        several = np.bincount(pair)[pair] > 1 if len(pair) else np.zeros(0, bool)
        own, pair = doc[order][several], pair[several]
        if len(pair):
            pair = np.cumsum(np.diff(pair, prepend=pair[0]) != 0)
            of_pair = part[own[np.flatnonzero(np.diff(pair, prepend=-1))]]
            log_left, log_right = np.log2(left)[of_pair], np.log2(np.maximum(1, sizes - left))[of_pair]
            degree = np.bincount(pair)
            for _ in range(rounds):
                right = np.bincount(pair, side[own], len(degree)).astype(np.int64)
                keep = degree - right
                here = keep * log_left - table[keep] + right * log_right - table[right]
                to_right = here - ((keep - 1) * log_left - table[np.maximum(0, keep - 1)] + (right + 1) * log_right - table[right + 1])
                to_left = here - ((keep + 1) * log_left - table[keep + 1] + (right - 1) * log_right - table[np.maximum(0, right - 1)])
                gain = np.bincount(own, np.where(side[own] == 0, to_right[pair], to_left[pair]), n)
                ranked = np.lexsort((-gain, side, part))
                pairs = sizes - left  # the left half may have one more
                at = np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs)
                a, b = ranked[np.repeat(begin, pairs) + at], ranked[np.repeat(begin + left, pairs) + at]
                swap = gain[a] + gain[b] > 1e-9
                if not swap.any():
                    break
                side[a[swap]], side[b[swap]] = 1, 0
        part = 2 * part + side
        sizes = np.stack([left, sizes - left], 1).ravel()
    return part


CLUSTER_PARTS = ("lengths", "terms", "starts", "docs", "counts", "peaks", "least")
INDEX = f"shard bigint, n_docs bigint, n_terms bigint, doc_ids array<bigint>, {', '.join(f'{x} binary' for x in CLUSTER_PARTS)}"


def shard_row(number: int, doc_ids: list, doc: np.ndarray, term: np.ndarray, count: np.ndarray, lengths: np.ndarray, cluster: int = CLUSTER) -> dict:
    """The index of one shard's documents: its totals and clusters."""
    names, term = np.unique(term, return_inverse=True)
    df = np.bincount(term, minlength=len(names)).astype(np.int32)
    many = (df > 1)[term]
    part = bisect(doc[many], term[many], len(doc_ids), cluster)
    n_parts = int(part.max(initial=-1)) + 1
    order = np.lexsort((doc, term, part[doc]))
    doc, term, count = doc[order], term[order], count[order].astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(part[doc]) != 0)])) if len(doc) else np.zeros(0, np.int64)
    of_term, of_part = term[first], part[doc[first]]
    peak = np.maximum.reduceat(count, first) if len(first) else np.zeros(0, np.int32)
    least = np.minimum.reduceat(lengths[doc], first).astype(np.int32) if len(first) else np.zeros(0, np.int32)
    ends = np.append(first, len(doc))
    cuts = np.searchsorted(of_part, np.arange(n_parts + 1))
    clusters = []
    for p in range(n_parts):
        members = np.flatnonzero(part == p)
        a, b = cuts[p], cuts[p + 1]
        own = slice(ends[a], ends[b])
        clusters.append({
            "n_docs": int((lengths[members] > 0).sum()), "n_terms": int(lengths[members].sum()), "doc_ids": [doc_ids[i] for i in members], "lengths": lengths[members].astype(np.int32).tobytes(),
            "terms": names[of_term[a:b]].tobytes(), "starts": (ends[a : b + 1] - ends[a]).astype(np.int32).tobytes(), "docs": np.searchsorted(members, doc[own]).astype(np.uint8).tobytes(),
            "counts": count[own].tobytes(), "peaks": peak[a:b].tobytes(), "least": least[a:b].tobytes(),
        })
    return {"shard": number, "n_docs": int((lengths > 0).sum()), "n_terms": int(lengths.sum()), "clusters": clusters}


def build_index(df: DataFrame, text: str = "text", doc_id: str = "doc_id", shard_docs: int = SHARD_DOCS, cluster: int = CLUSTER) -> DataFrame:
    """INDEX of all rows, a table in the shared folder. cluster: 256 at most."""
    importable(df.sparkSession)
    schema = pa.schema([("shard", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((x, pa.binary()) for x in CLUSTER_PARTS)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[tuple] = []

        def close():
            nonlocal number
            if ids:
                row = shard_row(number, ids.copy(), *(np.concatenate(x) for x in zip(*held)), cluster)
                number += 1
                ids.clear()
                held.clear()
                for cluster_row in row["clusters"]:
                    yield pa.RecordBatch.from_pylist([{"shard": row["shard"], **cluster_row}], schema)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                keys = part.column("doc_id").to_pylist()
                for a in range(0, len(texts), shard_docs):
                    if ids and (len(ids) + len(texts[a : a + shard_docs]) > shard_docs or sum(len(x[0]) for x in held) >= SHARD_POSTINGS):
                        yield from close()
                    doc, term, count, lengths = postings_of(texts[a : a + shard_docs])
                    held.append((doc + np.int32(len(ids)), term, count, lengths))
                    ids.extend(keys[a : a + shard_docs])
        yield from close()

    return written(df.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text")).mapInArrow(run, INDEX), "lexical-index", row_group=ROW_GROUP)


class Items:
    """Distinct terms of a block of items, the items' places in them, and the terms' weights."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        found = [np.unique(terms_of((r[1] or "").encode())[0]) for r in rows]
        self.terms = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]))
        self.owner = np.repeat(np.arange(len(rows)), [len(x) for x in found])
        self.place = np.searchsorted(self.terms, np.concatenate([*found, np.zeros(0, np.uint64)]))
        self.weight = np.zeros(len(self.terms), np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, frequency: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        for i, term in enumerate(self.terms.view(np.int64).tolist()):
            if term in frequency:
                self.weight[i] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[term] + 1)))

    def points(self, which: np.ndarray, count: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term counts for a document of so many terms that has it so often, in 64-bit integers."""
        count, length = count.astype(np.int64), length.astype(np.int64)
        m = 100 - 50 + (50 * length * self.n_docs) // self.n_terms
        return self.weight[which] * ((1_000_000_000 * count) // (1000 * count + 20 * m))

    def summed(self, points: np.ndarray, row_of: np.ndarray) -> np.ndarray:
        """For each item the sum of the rows of points that its terms have; row_of: a term's row, or -1."""
        row = row_of[self.place]
        there = row >= 0
        out = np.zeros((len(self.ids), points.shape[1]), np.int64)
        owner = self.owner[there]
        if len(owner):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            out[owner[first]] = np.add.reduceat(points[row[there]], first, axis=0)
        return out


def _numbers(value, kind) -> np.ndarray:
    return np.frombuffer(value, kind)


def _found(names: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(places in names, places in items.terms) of the items' terms that names (sorted) has."""
    at = np.searchsorted(names, items.terms)
    there = at < len(names)
    there[there] = names[at[there]] == items.terms[there]
    return at[there], np.flatnonzero(there)


def _spread(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for all places of each range."""
    size = end - start
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)


def shards_in(batch: pa.RecordBatch) -> Iterator[dict]:
    """The clusters of each shard that a batch has rows of, their bytes not copied; a shard may go on in another batch."""
    number = batch.column("shard").to_numpy()
    columns = {x: batch.column(x) for x in batch.schema.names if x != "shard"}
    edges = np.flatnonzero(np.diff(number)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows] if batch.num_rows else []):
        yield {"shard": int(number[a]), "clusters": [{x: column[i].as_py() if x == "doc_ids" else column[i].as_buffer() for x, column in columns.items()} for i in range(a, b)]}


def bounds(row: dict, items: Items) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(items x clusters) of a shard: what no document of the cluster exceeds; and where each cluster has items' terms, and which."""
    found = [_found(_numbers(cluster["terms"], np.uint64), items) for cluster in row["clusters"]]
    which = np.concatenate([w for _, w in found])
    names, term = np.unique(which, return_inverse=True)
    peaks, least = (np.concatenate([_numbers(cluster[x], np.int32)[at] for cluster, (at, _) in zip(row["clusters"], found)]) for x in ("peaks", "least"))
    table = np.zeros((len(names), len(found)), np.int64)
    table[term, np.repeat(np.arange(len(found)), [len(w) for _, w in found])] = items.points(which, peaks, least)
    row_of = np.full(len(items.terms), -1)
    row_of[names] = np.arange(len(names))
    return items.summed(table, row_of), found


def visit(row: dict, items: Items, least: np.ndarray, k: int) -> tuple[list[tuple], int]:
    """(item, doc_id, score) of each item's k best documents of a shard that reach its least score, and how many clusters were scored."""
    bound, found = bounds(row, items)
    n, ids, scores, visited = len(items.ids), [], [], 0
    best = np.zeros((n, k), np.int64)
    for c in np.argsort(-bound.sum(0), kind="stable").tolist():
        ask = (bound[:, c] > 0) & (bound[:, c] >= np.maximum(least, best.min(1)))
        if not ask.any():
            continue
        visited += 1
        cluster = row["clusters"][c]
        at, which = found[c]
        starts = _numbers(cluster["starts"], np.int32).astype(np.int64)
        term, place = _spread(starts[at], starts[at + 1])
        docs = _numbers(cluster["docs"], np.uint8)[place]
        table = np.zeros((len(at), len(cluster["doc_ids"])), np.int64)
        table[term, docs] = items.points(which[term], _numbers(cluster["counts"], np.int32)[place], _numbers(cluster["lengths"], np.int32)[docs])
        row_of = np.full(len(items.terms), -1)
        row_of[which] = np.arange(len(at))
        got = items.summed(table, row_of)
        got[~ask] = 0
        best = np.partition(np.concatenate([best, got], 1), -k, axis=1)[:, -k:]
        ids += cluster["doc_ids"]
        scores.append(got)
    if not ids:
        return [], visited
    total = np.concatenate(scores, 1)
    null = np.array([i is None for i in ids])
    key = np.array([i or 0 for i in ids], np.int64)
    out = []
    for i in range(n):
        mine = np.flatnonzero(total[i] >= max(1, least[i], best[i].min()))
        for j in mine[np.lexsort((key[mine], null[mine], -total[i][mine]))[:k]].tolist():
            out.append((i, ids[j], int(total[i, j])))
    return out, visited


FOUND = "item int, doc_id bigint, score bigint"


def _visits(index: DataFrame, items: Items, least: np.ndarray, k: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in shards_in(batch):
                rows, _ = visit(shard, items, least, k)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return index.select("shard", "doc_ids", *CLUSTER_PARTS).mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _promising(index: DataFrame, items: Items, first: int) -> list[int]:
    """The shards whose best clusters promise most for an item, first for each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for row in shards_in(batch):
                highest = bounds(row, items)[0].max(1, initial=0)
                for item in np.flatnonzero(highest).tolist():
                    best[item] = sorted([*best.get(item, ()), (int(highest[item]), row["shard"])], reverse=True)[:first]
        rows = [(item, *x) for item, found in best.items() for x in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["item", "bound", "shard"])

    found = index.select("shard", "terms", "peaks", "least").mapInArrow(run, "item int, bound bigint, shard bigint")
    order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "shard")
    return [r["shard"] for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select("shard").distinct().collect()]


def _frequencies(index: DataFrame, items: Items) -> dict[int, int]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.terms), np.int64)
        for batch in batches:
            for names, starts in zip(batch.column("terms"), batch.column("starts")):
                at, which = _found(_numbers(names.as_buffer(), np.uint64), items)
                starts = _numbers(starts.as_buffer(), np.int32)
                total[which] += starts[at + 1] - starts[at]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(items.terms.view(np.int64)[there]), pa.array(total[there])], names=["term", "df"])

    found = index.select("terms", "starts").mapInArrow(run, "term bigint, df bigint")
    return {r["term"]: r["df"] for r in found.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # one row for each of the items' terms


def search(index: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", k: int = TOP, first: int = FIRST, at_once: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of the index for each row of items, in blocks of so many items."""
    total = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms")).first()
    asked = written(items.select(F.col(item_id).cast("long").alias("item_id"), text_column(text).alias("text"), F.monotonically_increasing_id().alias("number")), "items")
    out, after = [], -1
    while total["terms"]:
        rows = asked.where(F.col("number") > after).orderBy("number").limit(at_once).collect()
        if not rows:
            break
        after = rows[-1]["number"]
        block = Items([(r["item_id"], r["text"]) for r in rows])
        block.weigh(total["docs"], total["terms"], _frequencies(index, block))
        least = np.zeros(len(rows), np.int64)
        early = _ranked(_visits(index.where(F.col("shard").isin(_promising(index, block, first))), block, least, k), k).where(F.col("rank") == k)
        for r in early.select("item", "score").collect():
            least[r["item"]] = r["score"]
        names = index.sparkSession.createDataFrame([(i, x) for i, x in enumerate(block.ids)], "item int, item_id bigint")
        out.append(_ranked(_visits(index, block, least, k), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return index.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole


def rank_documents(df: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of df (doc_id, text) for each of items (item_id, text)."""
    return search(build_index(df), items, k=k)
