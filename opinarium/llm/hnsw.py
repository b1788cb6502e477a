"""Embedding near-duplicates: hierarchical navigable small-world graphs per shard.

Vectors of one label (and length) are dealt by hash into shards; each gets a
graph, built once and written to the shared folder, and every vector of the
label queries every shard, in blocks. A shard has about SHARD vectors; in
labels of more than SHARDS such shards it grows, up to SHARD_BYTES, so that
no vector is copied to more shards than that needs. Graphs are built and
searched in numpy for many vectors in step. The graph answers; brute force only
audits it, on samples: when a shard is built, PLANTED copies of its own vectors,
turned away as far as links may be, widen the beam until RECALL of their links
are found; then the first AUDIT queries of a block (in the order of a hash) do
so for real ones. A query whose beam is full of links is searched again with a
wider one. Shards of up to SMALL vectors have no graph and are compared
outright. Links are verified by cosine in double precision, so none is false;
a few may be missed: the tests allow one in a hundred of sparse ones.

Equal vectors of a label are one node with a count. A task emits, for each
query, the count of its links and one link, and a spanning forest of the
shard's vectors that queries tie together: never all pairs of a group.

Null labels link with nothing, nor do vectors that are null, empty or zero or
hold null or non-finite components: no links, a component of their own.
Vectors of other lengths don't link. Repeated rows are copies (a repeated
vec_id too); a null vec_id has no links, a null component and is kept. An
empty table gives an empty table; columns of df named like a result column
are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, importable, remove, written

COSINE = 0.98
#: Vectors of a shard; a label's shards beyond which they grow, and up to which size.
SHARD, SHARDS, SHARD_BYTES = 8192, 64, 64 << 20
#: Queries that one task puts to a shard; so many that their bytes are a dozen times the graph's that is sent along.
QUERIES = 1 << 17
#: Shards of so few vectors are compared outright.
SMALL = 256
#: Planted copies and a block's queries that audit a graph, and the share of their links that it has to find.
PLANTED, AUDIT, RECALL = 1024, 256, 0.9999
#: Queries that are searched for at once.
STEP = 256
M, BUILD_BEAM, BEAM = 12, 40, 32


class Graph:
    """A graph over the rows of x (float32, unit length)."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x, n = x, len(x)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(np.int64)
        # The vectors of the highest levels go in first: a coarse graph, then ever finer ones.
        self.levels = int(level.max(initial=0))
        self.near = [np.full((n, M if k else 2 * M), -1, np.int32) for k in range(self.levels + 1)]
        order = np.argsort(-level, kind="stable")
        self.entry = int(order[0]) if n else -1
        done = 1
        while done < n:
            batch = order[done : done + max(1, min(256, done // 4))]
            for k in range(min(self.levels, int(level[batch].max())), -1, -1):
                new = batch[level[batch] >= k]
                if len(new):
                    self._insert(new, k, order[:done][level[order[:done]] >= k])
            done += len(batch)
        self.apart = self._unreached()

    def _unreached(self) -> np.ndarray:
        """Rows that no path on the lowest level leads to; searches compare them outright."""
        reached = np.zeros(len(self.x), bool)
        edge = np.array([self.entry]) if len(self.x) else np.zeros(0, np.int64)
        while len(edge):
            reached[edge] = True
            edge = np.unique(self.near[0][edge])
            edge = edge[(edge >= 0) & ~reached[edge]]
        return np.flatnonzero(~reached)

    def _insert(self, new: np.ndarray, k: int, old: np.ndarray) -> None:
        sims, ids = self.search(self.x[new], BUILD_BEAM, down_to=k)
        among = self.x[new] @ self.x[new].T
        np.fill_diagonal(among, -np.inf)
        take = min(16, len(new))
        nearest = np.argpartition(-among, take - 1, 1)[:, :take]
        ids = np.concatenate([ids, np.where(np.isfinite(np.take_along_axis(among, nearest, 1)), new[nearest], -1)], 1)
        sims = np.concatenate([sims, np.take_along_axis(among, nearest, 1)], 1)
        near = self.near[k]
        chosen = self._choose(sims, ids, near.shape[1] if k else M)
        near[new, : chosen.shape[1]] = chosen
        # Links back; a full list is chosen anew.
        a, b = np.repeat(new, chosen.shape[1]), chosen.ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.argsort(b, kind="stable")
        a, b = a[order], b[order]
        targets, start, count = np.unique(b, return_index=True, return_counts=True)
        more = np.full((len(targets), int(count.max(initial=0))), -1, np.int64)
        more[np.repeat(np.arange(len(targets)), count), np.arange(len(b)) - np.repeat(start, count)] = a
        for i in range(0, len(targets), 512):
            t = targets[i : i + 512]
            ids = np.concatenate([near[t].astype(np.int64), more[i : i + 512]], 1)
            ids[ids == t[:, None]] = -1
            ids = -np.sort(-ids, 1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("qkd,qd->qk", self.x[ids], self.x[t])
            near[t] = self._choose(np.where(ids >= 0, sims, -np.inf), ids, near.shape[1])

    def _choose(self, sims: np.ndarray, ids: np.ndarray, m: int) -> np.ndarray:
        """For each row m neighbours of its candidates: those nearer to the row than to one chosen before, then the nearest of the rest."""
        order = np.argsort(-sims, 1, kind="stable")
        sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
        ok = np.isfinite(sims) & (ids >= 0)
        x = self.x[ids]
        between = np.matmul(x, x.transpose(0, 2, 1))
        covered = np.full(sims.shape, -np.inf, np.float32)
        picked = np.zeros(sims.shape, bool)
        count = np.zeros(len(sims), np.int64)
        for c in range(sims.shape[1]):
            pick = ok[:, c] & (sims[:, c] > covered[:, c]) & (count < m)
            picked[:, c] = pick
            count += pick
            covered = np.where(pick[:, None], np.maximum(covered, between[:, c]), covered)
        rest = ok & ~picked
        room = np.cumsum(rest, 1) <= (m - count)[:, None]
        final = picked | (rest & room)
        rank = np.where(final, np.cumsum(final, 1) - 1, m)
        out = np.full((len(sims), m + 1), -1, np.int64)
        np.put_along_axis(out, rank, np.where(final, ids, -1), 1)
        return out[:, :m]

    def _beam(self, q: np.ndarray, start: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search on level k with the given beam, for all rows of q in step."""
        near, rows = self.near[k], np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(self.x)), bool)
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -np.inf, np.float32)
        ids[:, 0], sims[:, 0] = start, np.einsum("qd,qd->q", self.x[start], q)
        seen[rows[:, 0], start] = True
        open_ = np.zeros((len(q), beam), bool)
        open_[:, 0] = True
        width = 1 if beam == 1 else max(4, beam // 8)
        while open_.any():
            live = np.flatnonzero(open_.any(1))
            r = np.arange(len(live))[:, None]
            waiting = np.where(open_[live], sims[live], -np.inf)
            best = np.argpartition(-waiting, min(width, beam) - 1, 1)[:, :width]
            valid = np.isfinite(np.take_along_axis(waiting, best, 1))
            open_[live[:, None], best] = False
            found = near[np.where(valid, ids[live[:, None], best], 0)].astype(np.int64)
            found[~valid] = -1
            found = -np.sort(-found.reshape(len(live), -1), 1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            fresh = (found >= 0) & ~seen[live[:, None], found]
            most = int(fresh.sum(1).max(initial=0))
            if not most:
                continue
            place = np.argsort(~fresh, 1, kind="stable")[:, :most]
            fresh, found = fresh[r, place], found[r, place]
            at, col = np.nonzero(fresh)
            seen[live[at], found[at, col]] = True
            s = np.where(fresh, np.einsum("qkd,qd->qk", self.x[found], q[live]), -np.inf).astype(np.float32)
            all_ids, all_sims = np.concatenate([ids[live], found], 1), np.concatenate([sims[live], s], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            top = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            ids[live], sims[live], open_[live] = all_ids[r, top], all_sims[r, top], all_open[r, top]
        return sims, ids

    def search(self, q: np.ndarray, beam: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and rows found by the beam on level down_to, for each row of q."""
        start = np.full(len(q), self.entry, np.int64)
        for k in range(self.levels, down_to, -1):
            start = self._beam(q, start, 1, k)[1][:, 0]
        return self._beam(q, start, min(beam, len(self.x)), down_to)

    def within(self, q: np.ndarray, limit: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of q, row of the graph) found with a similarity over limit; full beams are widened."""
        rows, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo, n = np.arange(len(q)), len(self.x)
        beam = min(beam, n)
        while len(todo):
            step = max(8, min(256, (1 << 24) // (beam * 16)))
            full = []
            for i in range(0, len(todo), step):
                part = todo[i : i + step]
                sims, ids = self.search(q[part], beam)
                hit = sims >= limit
                wide = hit.all(1) & (beam < n)
                full.append(part[wide])
                a, b = np.nonzero(hit & ~wide[:, None])
                rows.append(part[a])
                hits.append(ids[a, b])
            todo = np.concatenate(full)
            beam = min(2 * beam, n)
        if len(self.apart):
            a, b = np.nonzero(q @ self.x[self.apart].T >= limit)
            rows.append(a)
            hits.append(self.apart[b])
        pairs = np.unique(np.concatenate(rows) * n + np.concatenate(hits))
        return pairs // n, pairs % n

    def saved(self) -> bytes:
        """All but the vectors; of the higher levels only rows that have neighbours."""
        held = {"shape": np.array([len(self.x), self.levels, self.entry]), "apart": self.apart, "near0": self.near[0]}
        for k in range(1, self.levels + 1):
            held[f"rows{k}"] = np.flatnonzero((self.near[k] >= 0).any(1))
            held[f"near{k}"] = self.near[k][held[f"rows{k}"]]
        out = io.BytesIO()
        np.savez(out, **held)
        return out.getvalue()

    @classmethod
    def loaded(cls, x: np.ndarray, data: bytes) -> Graph:
        held = np.load(io.BytesIO(data))
        graph = cls.__new__(cls)
        n, graph.levels, graph.entry = held["shape"].tolist()
        graph.x, graph.apart, graph.near = x, held["apart"], [held["near0"]]
        for k in range(1, graph.levels + 1):
            near = np.full((n, M), -1, np.int32)
            near[held[f"rows{k}"]] = held[f"near{k}"]
            graph.near.append(near)
        return graph


def audited(graph: Graph, sample: np.ndarray, limit: float) -> int:
    """The beam, from BEAM on, at which the links of the sample reach RECALL of those that brute force finds."""
    truth = int((sample @ graph.x.T >= limit).sum())
    beam = BEAM
    while beam < len(graph.x) and len(graph.within(sample, limit, beam)[0]) < RECALL * truth:
        beam *= 2
    return beam


def _units(vectors: list, d: int) -> np.ndarray:
    x = np.array(vectors, np.float64).reshape(len(vectors), d)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(x: np.ndarray, cosine: float, n: int = PLANTED, seed: int = 11) -> np.ndarray:
    """Turned copies of n rows of x (units), with cosines to them from a little over cosine to nearly 1."""
    rng = np.random.default_rng(seed)
    own = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    aside = rng.normal(size=own.shape)
    aside -= np.einsum("ij,ij->i", aside, own)[:, None] * own
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-12)
    c = rng.uniform(cosine + (1 - cosine) / 20, 1 - (1 - cosine) / 20, (len(own), 1))
    return c * own + np.sqrt(1 - c * c) * aside


def shard_row(ids: list[int], counts: list[int], vectors: list, cosine: float = COSINE) -> dict:
    """What is kept of a shard: its vectors, as units in double precision, their graph and its beam; small ones have no graph."""
    x = _units(vectors, len(vectors[0]))
    row = {"ids": np.array(ids, "<i8").tobytes(), "counts": np.array(counts, "<i8").tobytes(), "units": x.tobytes(), "graph": b"", "beam": 0}
    if len(ids) > SMALL:
        graph = Graph(x.astype(np.float32))
        row |= {"graph": graph.saved(), "beam": audited(graph, planted(x, cosine).astype(np.float32), cosine - 1e-5)}
    return row


class _Shard:
    def __init__(self, row: dict, cosine: float):
        self.cosine = cosine
        self.id, self.copies = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["counts"], "<i8")
        self.x = np.frombuffer(row["units"], "<f8").reshape(len(self.id), -1)
        self.x32 = self.x.astype(np.float32)
        self.graph = Graph.loaded(self.x32, row["graph"]) if row["graph"] else None
        self.beam, self.audits, self.compared = row["beam"], AUDIT, 0
        self.component = np.arange(len(self.id))

    def _verified(self, q: np.ndarray, nodes: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Of pairs those that link, as row * vectors + hit, without those of a node with itself."""
        cosine = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", self.x[hits[i : i + 65536]], q[rows[i : i + 65536]]) for i in range(0, len(rows), 65536))])
        ok = (cosine >= self.cosine) & (self.id[hits] != nodes[rows])
        return rows[ok] * len(self.id) + hits[ok]

    def links(self, q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of q, row of the shard) that link, in order."""
        q32, limit, n = q.astype(np.float32), self.cosine - 1e-5, len(self.id)
        outright = lambda: self._verified(q, nodes, *np.nonzero(q32 @ self.x32.T >= limit))
        if self.graph is None:
            found = outright()
        else:
            found = self._verified(q, nodes, *self.graph.within(q32, limit, self.beam))
            if self.audits > 0:
                self.audits -= len(q)
                self.compared += len(q)
                truth = outright()
                if len(np.setdiff1d(truth, found, assume_unique=True)) > (1 - RECALL) * len(truth):
                    self.beam, self.audits = max(2 * self.beam, audited(self.graph, q32, limit)), AUDIT
                found = np.union1d(truth, found)
        return found // n, found % n

    def ask(self, rows: list[dict]) -> list[tuple[int, int | None, int]]:
        """(node, a linked node or null, links): one for each query, and those that tie shard vectors together."""
        out = []
        q, nodes = _units([r["vector"] for r in rows], self.x.shape[1]), np.array([r["node"] for r in rows], np.int64)
        for at in range(0, len(rows), STEP):
            own, hits = self.links(q[at : at + STEP], nodes[at : at + STEP])
            edge = np.searchsorted(own, np.arange(min(STEP, len(rows) - at) + 1))
            for node, a, b in zip(nodes[at : at + STEP].tolist(), edge[:-1].tolist(), edge[1:].tolist()):
                if a == b:
                    out.append((node, None, 0))
                    continue
                mine = hits[a:b]
                first = int(self.id[mine[0]])
                out.append((node, first, int(self.copies[mine].sum())))
                component = self.component[mine]
                if b - a > 1 and (component != component[0]).any():
                    others, where = np.unique(component, return_index=True)
                    for c, k in zip(others.tolist(), where.tolist()):
                        if c != component[0]:
                            out.append((first, int(self.id[mine[k]]), 0))
                            self.component[self.component == c] = component[0]
        return out


GRAPH = "label {label}, width int, shard int, ids binary, counts binary, units binary, graph binary, beam int"


def _graphs(index: DataFrame, cosine: float) -> DataFrame:
    """shard_row() of each shard of index (label, width, shard, node, copies, vector)."""
    importable(index.sparkSession)
    key, schema = ["label", "width", "shard"], GRAPH.format(label=index.schema["label"].dataType.simpleString())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def told() -> pa.RecordBatch:
            made = dict(zip(key, at)) | shard_row(*zip(*held), cosine)
            kinds = [label, pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made.values(), kinds)], names=list(made))

        for batch in batches:
            label = batch.schema.field("label").type
            for row in batch.to_pylist():
                if (here := tuple(row[k] for k in key)) != at:
                    if held:
                        yield told()
                    at, held = here, []
                held.append((row["node"], row["copies"], row["vector"]))
        if held:
            yield told()

    return index.select(*key, "node", "copies", "vector").repartition(*key).sortWithinPartitions(*key, "node").mapInArrow(run, schema)


def _ask_shards(dealt: DataFrame, cosine: float) -> DataFrame:
    """dealt: label, width, shard and block, then a shard's graph or a query."""
    importable(dealt.sparkSession)
    key = ["label", "width", "shard", "block"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard, asked = None, None, []

        def told():
            rows = shard.ask(asked)
            asked.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["node", "other", "links"])

        for batch in batches:
            for row in (r for start in range(0, batch.num_rows, 512) for r in batch.slice(start, 512).to_pylist()):
                if (here := tuple(row[k] for k in key)) != at:
                    if asked:
                        yield told()
                    at, shard = here, None
                if not row["asks"]:
                    shard = _Shard(row, cosine)
                elif shard:
                    asked.append(row)
                    if len(asked) >= 2048:
                        yield told()
        if asked:
            yield told()

    spread = dealt.repartition(*key).sortWithinPartitions(*key, "asks", F.xxhash64("node", F.lit(3)), "node")
    return spread.mapInArrow(run, "node long, other long, links long")


def link_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of df."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    links = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("links", F.coalesce(links, F.lit(False))).withColumn("digest", F.when(F.col("links"), F.struct(F.xxhash64("label", "vector").alias("a"), F.xxhash64("vector", "label", F.lit(1)).alias("b"))))
    nodes = rows.where("links").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")).withColumn("width", F.size("vector"))
    nodes = written(nodes, "nodes")

    sizes = nodes.groupBy("label", "width").agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(SHARD), F.least(F.ceil(F.col("n") / SHARDS), F.lit(SHARD_BYTES) / (8 * F.col("width"))))
    sizes = sizes.select(F.col("label").alias("l"), F.col("width").alias("w"), F.ceil(F.col("n") / size).cast("int").alias("shards"), F.ceil(F.col("n") / QUERIES).cast("int").alias("blocks"))
    sizes = written(sizes, "sizes")
    sized = nodes.join(sizes, (F.col("label") == F.col("l")) & (F.col("width") == F.col("w")))
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    graphs = written(_graphs(sized.withColumn("shard", own("shards", 1)), cosine), "graphs")
    index = graphs.join(sizes.select(F.col("l").alias("label"), F.col("w").alias("width"), each("blocks").alias("block")), ["label", "width"]).withColumn("asks", F.lit(False))
    asks = sized.withColumn("block", own("blocks", 2)).withColumn("shard", each("shards")).withColumn("asks", F.lit(True))
    key = ["label", "width", "shard", "block", "asks"]
    dealt = index.select(*key, "ids", "counts", "units", "graph", "beam").unionByName(asks.select(*key, "node", "vector"), allowMissingColumns=True)
    found = written(_ask_shards(dealt, cosine), "found")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null").select(F.col("node").alias("src"), F.col("other").alias("dst")), "vectors")
    told = nodes.select("digest", "node", "copies").join(counts, "node", "left").join(components, "node", "left")
    told = written(told.select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "told")
    remove(nodes, graphs, found, components)
    out = rows.select("vec_id", "digest").join(told, "digest", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), (F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id"))).alias("kept"))
