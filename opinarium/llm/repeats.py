"""Repeated passages by suffix arrays.

A symbol goes if it lies in a string of so many symbols (a window) that also
starts anywhere else in the texts, judged on the input; strings never cross
texts. A unit says what symbols are: BYTES have windows of 400 bytes, WORDS
of 50 words (told apart by hashes of 64 bits; they end at ASCII white space,
which goes with the word before it). One run serves several units.

1. Anchors: of the hashes of all short strings (seeds) within a window the least
   names the window. Equal windows have equal anchors, so windows of other
   anchors need no comparison. Runs of starts with one anchor are contexts: the
   run's symbols, to the end of its last window.
2. Contexts are told apart by hashes of 125 bits. One that occurs twice is repeated throughout. Of the others only
   those matter whose anchor other contexts have, too, or occurs again within.
3. Each shard gathers the distinct contexts of whole anchors and sorts all
   suffixes (Larsson-Sadakane refinement in numpy). Kasai's common prefixes
   give the groups of equal windows.
4. An anchor with very many contexts is dealt out to several shards. Each
   hands on sorted runs of digests, one of a window for each group of equal
   windows, a run for each range of digests; the runs of a range are merged
   by binary search, and windows found in several go back to their contexts.

Null texts count as empty; texts under a window keep everything; copies
of a text remove each other; each row of a repeated doc_id counts as a text
of its own and gets a result. An empty table gives an empty table. Columns
other than doc_id and text pass by untouched in clean().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import add_columns, importable, mix, powers, remove, slices, text_column, words_of, written

#: Bytes of contexts in one suffix array, and distinct contexts of an anchor beyond which it is dealt out.
SHARD_BYTES = 1 << 18
CONTEXTS = 256
#: Bytes of texts whose contexts are sought together.
TOGETHER = 1 << 15
#: Of the polynomials that tell contexts apart.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Unit:
    """What texts are made of: window and seed (a power of two) count symbols, cut gives the symbols and the offsets of their first bytes."""

    name: str
    window: int
    seed: int
    symbol: str
    cut: Callable[[bytes], tuple[np.ndarray, np.ndarray]]


def _bytes_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(raw, np.uint8), np.arange(len(raw))


BYTES = Unit("bytes", 400, 64, "u1", _bytes_of)
WORDS = Unit("words", 50, 8, "<u8", words_of)


def seed_hashes(raw: np.ndarray, seed: int) -> np.ndarray:
    """A uint64 for the seed symbols (a power of two) from each position."""
    h = mix(raw.astype(np.uint64) + np.uint64(1))
    step, factor = 1, 0x9E3779B97F4A7C15 | 1
    with np.errstate(over="ignore"):
        while step < seed:
            h = h[:-step] * np.uint64(factor) + h[step:]
            factor = factor * factor % (1 << 64)
            step *= 2
    return mix(h)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each width values in a row."""
    step = 1
    while 2 * step <= width:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    rest = width - step
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def _range_sums(h: np.ndarray, factor: int, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """A uint64 for the values h[first:past] of each range: a polynomial in an odd factor, from running sums."""
    up, down = powers(len(h) + 1, factor)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
        return mix((total[past] - total[first]) * down[first] + (past - first).astype(np.uint64))


def contexts(symbols: np.ndarray, base: np.ndarray, end: np.ndarray, window: int = BYTES.window, seed: int = BYTES.seed) -> dict[str, np.ndarray]:
    """The runs of windows with one anchor in texts, one after another, from places in base to places in end.

    text, anchor, d1 and d2 (bits that tell contexts apart), first and
    last (starts within the text), and whether the anchor occurs again within.
    """
    n = len(symbols)
    if n < window:
        none = np.zeros(0, np.int64)
        return {k: none for k in ("text", "anchor", "d1", "d2", "first", "last")} | {"again": np.zeros(0, bool)}
    h = seed_hashes(symbols, seed)
    width = window - seed + 1
    least = sliding_least(h, width)
    # A window lies within its text.
    room = np.repeat(end - window, np.diff(np.append(base, n)))[: len(least)]
    whole = np.arange(len(least)) <= room
    edge = np.ones(len(least) + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])
    edge[base[base < len(least)]] = True
    edge = np.flatnonzero(edge)
    first, last = edge[:-1], edge[1:] - 1
    first, last = first[whole[first]], last[whole[first]]
    anchor = least[first]
    # The places of each anchor: hashes that share 16 bits with one, in order of hash, then place.
    low = np.zeros(1 << 16, bool)
    low[anchor & np.uint64(0xFFFF)] = True
    maybe = np.flatnonzero(low[h & np.uint64(0xFFFF)])
    maybe = maybe[np.argsort(h[maybe], kind="stable")]
    value = h[maybe]
    named = np.searchsorted(value, value, "left") * (n + 1) + maybe
    own = np.searchsorted(value, anchor, "left") * (n + 1)
    again = np.searchsorted(named, own + last + width) - np.searchsorted(named, own + first) > 1
    text = np.searchsorted(base, first, "right") - 1
    d1, d2 = (_range_sums(h, factor, first, last + width).view(np.int64) for factor in FACTORS)
    return {"text": text, "anchor": anchor.view(np.int64), "d1": d1, "d2": d2, "first": first - base[text], "last": last - base[text], "again": again}


def suffix_array(raw: np.ndarray) -> np.ndarray:
    """Starts of all suffixes, in order.

    Ranks of the first symbols (8 bytes, or a word) are refined: suffixes that
    still share a rank are sorted by the rank of what follows, which doubles
    the depth. Common prefixes that are carried over need the whole order.
    """
    n = len(raw)
    if raw.dtype == np.uint8:
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        key, done = np.zeros(n, np.uint64), 8
        for k in range(8):
            key = (key << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    else:
        key, done = raw, 1
    order = np.argsort(key, kind="stable").astype(np.int64)
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    group = np.repeat(heads, np.diff(np.append(heads, n)))  # a group is named by its first place
    rank = np.empty(n + 1, np.int64)
    rank[order] = group
    rank[n] = -1
    places = np.flatnonzero(~new | ~np.append(new[1:], True)) if n else np.zeros(0, np.int64)  # of groups with several
    # Zeros that pad the first keys may tie a suffix with a longer one; what follows the end ranks first.
    while len(places):
        start = order[places]
        own = group[places]
        after = np.where(start + done > n, n - start - done - 1, rank[np.minimum(start + done, n)])
        # Only places within a group change: sort by group, then by what follows.
        by = np.argsort(own * np.int64(n + 32) + after + 16, kind="stable")
        start, own, after = start[by], own[by], after[by]
        order[places] = start
        split = np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])])
        heads = np.flatnonzero(split)
        size = np.diff(np.append(heads, len(places)))
        named = np.repeat(places[heads], size)
        group[places] = named
        rank[start] = named
        places = places[np.repeat(size > 1, size)]
        done *= 2
    return order


def common_prefixes(raw: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in order, up to limit.

    Texts are cut into lanes that go from left to right in step: a suffix
    shares at least one symbol less with its neighbour than the one before it did.
    """
    n = len(raw)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.concatenate([raw, np.zeros(limit + 16, raw.dtype)])
    if step := 8 * (raw.dtype == np.uint8):  # eight bytes are compared at once
        eight = np.lib.stride_tricks.sliding_window_view(words, 8)
        words = np.zeros(len(eight), np.uint64)
        for k in range(8):
            words |= eight[:, k].astype(np.uint64) << np.uint64(8 * k)
    lanes = max(1, min(8192, n // 64))
    edge = np.linspace(0, n, lanes + 1).astype(np.int64)
    at, end, h = edge[:-1].copy(), edge[1:], np.zeros(lanes, np.int64)
    out = np.zeros(n, np.int64)
    while len(at):
        other = before[at]
        room = np.minimum(limit, n - np.maximum(at, other))
        x = words[at + h] ^ words[np.maximum(other, 0) + h]
        if step:
            low = x & (~x + np.uint64(1))
            h = h + np.where(x == 0, step, np.frexp(low.astype(np.float64))[1] - 1 >> 3)
        else:
            h = h + (x == 0)
        h = np.minimum(h, room)
        over = (x != 0) | (h >= room) | (other < 0)
        h[other < 0] = 0
        ended = np.flatnonzero(over)
        out[at[ended]] = h[ended]
        at[ended] += 1
        h[ended] = np.maximum(h[ended] - 1, 0)
        live = at < end
        if not live.all():
            at, end, h = at[live], end[live], h[live]
    return out[order]


def equal_windows(parts: list[np.ndarray], window: int = BYTES.window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows within the parts: part, start in it, and the number of a group of equal windows."""
    size = np.array([len(p) for p in parts], np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    raw = np.concatenate(parts)
    order = suffix_array(raw)
    group = np.cumsum(common_prefixes(raw, order, window) < window)
    part = np.searchsorted(base, order, "right") - 1
    start = order - base[part]
    whole = start + window <= size[part]
    return part[whole], start[whole], group[whole]


def runs(marked: np.ndarray) -> list[int]:
    """first, last, first, last, ... of the runs of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    edge[1::2] -= 1
    return edge.tolist()


def removed(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of raw without the spans (start, end), the count of removed bytes and of maximal spans."""
    out, done, gone, many = [], 0, 0, 0
    for a, b in sorted(spans):
        if a > done or not many:
            out.append(raw[done:a])
            many += 1
            gone += b - a
        elif b > done:
            gone += b - done
        done = max(done, b)
    return b"".join(out) + raw[done:], gone, many


LONG = T.LongType()
CONTEXT = T.StructType([T.StructField("unit", T.ByteType())] + [T.StructField(n, LONG) for n in ("anchor", "d1", "d2", "first", "last")] + [T.StructField("again", T.BooleanType())])


def _digest(symbols: np.ndarray) -> bytes:
    return hashlib.blake2b(symbols.tobytes(), digest_size=16).digest()


def _contexts(units: tuple[Unit, ...]):
    def told(texts: list[bytes]) -> pa.Array:
        """A list of contexts for each text; the texts are looked at together."""
        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size + 1) - size - 1
        raw = b" ".join(texts)
        parts = []
        for k, unit in enumerate(units):
            symbols, places = unit.cut(raw)
            found = contexts(symbols, np.searchsorted(places, base), np.searchsorted(places, base + size), unit.window, unit.seed)
            # The low bits tell units apart: no anchor is shared by two, nor are a context's bits.
            found["anchor"], found["d1"] = found["anchor"] & ~7 | k, found["d1"] & ~7 | k
            parts.append(found | {"unit": np.full(len(found["text"]), k, np.int8)})
        every = {name: np.concatenate([p[name] for p in parts]) for name in parts[0]}
        order = np.argsort(every["text"], kind="stable")
        rows = pa.StructArray.from_arrays([pa.array(every[f.name][order]) for f in CONTEXT.fields], CONTEXT.names)
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(every["text"][order], np.arange(len(texts) + 1)), pa.int32()), rows)

    def make(texts):
        out, held, size = [], [], 0
        for text in texts:
            held.append(text.encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size > TOGETHER:
                out.append(told(held))
                held, size = [], 0
        if held:
            out.append(told(held))
        return [pa.concat_arrays(out) if out else pa.array([], to_arrow_type(T.ArrayType(CONTEXT)))]

    return make


SHARDED = "unit byte, anchor long, shards int, shard int, d1 long, d2 long, symbols binary"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"byte": pa.int8(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(x), kinds[kind]) for x, (_, kind) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[name for name, _ in fields])


def _cut_out(texts: DataFrame, units: tuple[Unit, ...], most: int) -> DataFrame:
    """SHARDED rows for texts (text, wanted)."""
    importable(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                rows = []
                for text, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    cut: dict[int, np.ndarray] = {}
                    for w in wanted:
                        k, shards = w["unit"], -(-w["contexts"] // most)
                        symbols = cut[k] if k in cut else cut.setdefault(k, units[k].cut(raw)[0])
                        rows.append((k, w["anchor"], shards, w["d1"] % shards, w["d1"], w["d2"], symbols[w["first"] : w["last"] + units[k].window].tobytes()))
                yield _batch(rows, SHARDED)

    return texts.select("text", "wanted").mapInArrow(run, SHARDED)


FOUND = "d1 long, d2 long, runs array<int>, anchor long, shard int, range int, digests binary, singles binary"
#: Of a sorted run: the context and start of each window that its shard has once (start -1: more than once).
SINGLE = np.dtype([("d1", "<i8"), ("d2", "<i8"), ("start", "<i4")])


def _search(sharded: DataFrame, units: tuple[Unit, ...]) -> DataFrame:
    """Of SHARDED rows: runs of starts of repeated windows in a context; for dealt-out anchors sorted runs of window digests."""
    importable(sharded.sparkSession)

    def sort(rows: list[dict]) -> pa.RecordBatch:
        unit = units[rows[0]["unit"]]
        window = unit.window
        parts = [np.frombuffer(r["symbols"], unit.symbol) for r in rows]
        part, start, group = equal_windows(parts, window)
        many = np.bincount(group, minlength=1)[group] if len(group) else group
        out: list[tuple] = []
        by = np.argsort(part, kind="stable")
        for i, of in zip(*np.unique(part[by], return_index=True)):
            row, n = rows[i], len(parts[i]) - window + 1
            mine = by[of : of + n]
            flags = np.zeros(n, bool)
            flags[start[mine]] = many[mine] > 1
            if flags.any():
                out.append((row["d1"], row["d2"], runs(flags), None, None, None, None, None))
        shards = rows[0]["shards"]
        if shards > 1:  # one shard of one anchor
            _, once = np.unique(group, return_index=True)
            digests = np.array([_digest(parts[p][s : s + window]) for p, s in zip(part[once].tolist(), start[once].tolist())], "S16")
            singles = np.array([(rows[p]["d1"], rows[p]["d2"], s if m == 1 else -1) for p, s, m in zip(part[once].tolist(), start[once].tolist(), many[once].tolist())], SINGLE)
            order = np.argsort(digests, kind="stable")
            digests, singles = digests[order], singles[order]
            first = digests.view(np.uint8).reshape(-1, 16)[:, 0].astype(np.int64)
            edge = np.searchsorted(first * shards >> 8, np.arange(shards + 1))
            for k in range(shards):
                a, b = edge[k], edge[k + 1]
                if b > a:
                    out.append((None, None, None, rows[0]["anchor"], rows[0]["shard"], k, digests[a:b].tobytes(), singles[a:b].tobytes()))
        return _batch(out, FOUND)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # of whole shards of anchors
        group: list[dict] = []
        key, size, own = None, 0, 0

        def told() -> Iterator[pa.RecordBatch]:
            """Sorts what is held before the group joins it, unless both fit; a dealt-out anchor's shard is sorted alone: its windows must not meet those of another."""
            nonlocal held, group, size, own
            alone = bool(group) and group[0]["shards"] > 1
            if held and (alone or size + own > SHARD_BYTES or held[0]["unit"] != group[0]["unit"]):
                yield sort(held)
                held, size = [], 0
            held, size, group, own = held + group, size + own, [], 0
            if alone:
                yield sort(held)
                held, size = [], 0

        for batch in batches:
            for row in batch.to_pylist():
                if (at := (row["anchor"], row["shard"])) != key:
                    if group:
                        yield from told()
                    key = at
                group.append(row)
                own += len(row["symbols"])
        if group:
            yield from told()
        if held:
            yield sort(held)

    return sharded.repartition("anchor", "shard").sortWithinPartitions("unit", "anchor", "shard").mapInArrow(run, FOUND)


def _merge(found: DataFrame) -> DataFrame:
    """(d1, d2, runs) of windows that their shard has once and another has, too: the sorted runs of a range merged by binary search."""
    importable(found.sparkSession)
    dealt = found.select("anchor", "range", "shard", "digests", "singles").repartition("anchor", "range").sortWithinPartitions("anchor", "range", "shard")

    def merged(group: list[dict]) -> pa.RecordBatch:
        digests = [np.frombuffer(r["digests"], "S16") for r in group]
        singles = np.concatenate([np.frombuffer(r["singles"], SINGLE) for r in group])
        again = np.zeros(len(singles), bool)
        seen, where, base = digests[0][:0], np.zeros(0, np.int64), 0
        for own in digests:
            mine = base + np.arange(len(own))
            at = np.searchsorted(seen, own)
            both = at < len(seen)
            both[both] = seen[at[both]] == own[both]
            again[mine[both]] = True
            again[where[at[both]]] = True
            new = ~both
            seen, where = np.insert(seen, at[new], own[new]), np.insert(where, at[new], mine[new])
            base += len(own)
        hit = singles[again & (singles["start"] >= 0)]
        hit = hit[np.lexsort((hit["start"], hit["d2"], hit["d1"]))]
        edge = np.flatnonzero(np.concatenate([[True], (hit["d1"][1:] != hit["d1"][:-1]) | (hit["d2"][1:] != hit["d2"][:-1])])) if len(hit) else np.zeros(0, np.int64)
        starts = [np.repeat(x, 2).tolist() for x in np.split(hit["start"], edge[1:])] if len(hit) else []
        return pa.RecordBatch.from_arrays([pa.array(hit["d1"][edge]), pa.array(hit["d2"][edge]), pa.array(starts, pa.list_(pa.int32()))], names=["d1", "d2", "runs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (at := (row["anchor"], row["range"])) != key:
                    if group:
                        yield merged(group)
                    key, group = at, []
                group.append(row)
        if group:
            yield merged(group)

    return dealt.mapInArrow(run, "d1 long, d2 long, runs array<int>")


def keyed(df: DataFrame, text: str = "text", key: str = "key") -> DataFrame:
    """df with key: 16 bytes for each distinct text."""
    return df.withColumn(key, F.unhex(F.md5(text_column(text).cast("binary"))))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(key, text), a row for each distinct text of docs; copies are combined before the shuffle."""
    return docs.groupBy("key").agg(F.first("text").alias("text"))


def repeated_runs(docs: DataFrame, units: tuple[Unit, ...] = (BYTES,), most: int = CONTEXTS) -> DataFrame:
    """(key, unit, starts) of the distinct texts of docs (key, text) that hold repeated windows, written.

    unit is an index of units; starts are runs first, last of the starts of
    repeated windows. Texts with copies have one run of all their windows.
    """
    made = T.StructType([T.StructField("contexts", T.ArrayType(CONTEXT))])
    seen = add_columns(docs.select("key", "text"), made, _contexts(units), ["text"], sliced="text").where(F.size("contexts") > 0)
    seen = written(seen.groupBy("key").agg(F.count("*").alias("copies"), F.first("contexts").alias("contexts")), "contexts")
    every = seen.select("key", F.inline("contexts"))
    anchors = written(every.groupBy("anchor").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 or again").select("anchor"), "anchors")
    uses = written(every.join(anchors.hint("merge"), "anchor"), "uses")
    distinct = uses.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("unit").alias("unit"), F.min("anchor").alias("anchor"), F.max("again").alias("again"), F.min(F.struct("key", "first", "last")).alias("held"))
    distinct = written(distinct.select("d1", "d2", "n", "unit", "anchor", "again", "held.*"), "distinct-contexts")

    several = written(distinct.groupBy("anchor").agg(F.count("*").alias("contexts"), F.max("again").alias("any_again")).where("contexts > 1 or any_again").select("anchor", "contexts"), "shared-anchors")
    wanted = distinct.join(several, "anchor").groupBy("key").agg(F.collect_list(F.struct("unit", "anchor", "contexts", "d1", "d2", "first", "last")).alias("wanted"))
    found = written(_search(_cut_out(distinct_texts(docs).join(wanted.hint("merge"), "key"), units, most), units), "equal-windows")
    local = found.where("runs is not null").select("d1", "d2", "runs")
    marks = local.union(_merge(found.where("digests is not null")))
    # Contexts that occur once have the marks of their windows; others are repeated throughout.
    once = uses.join(distinct.where("n = 1").select("d1", "d2"), ["d1", "d2"]).join(marks.groupBy("d1", "d2").agg(F.flatten(F.collect_list("runs")).alias("runs")), ["d1", "d2"])
    once = once.select("key", "unit", F.transform("runs", lambda x: x + F.col("first")).alias("starts"))
    repeated = written(distinct.where("n > 1").select("d1", "d2"), "repeated-contexts")
    often = uses.join(repeated, ["d1", "d2"]).select("key", "unit", F.array("first", "last").alias("starts"))
    copied = seen.where("copies > 1").select("key", F.inline("contexts")).groupBy("key", "unit").agg(F.array(F.min("first"), F.max("last")).alias("starts"))
    starts = once.union(often).union(copied.select("key", "unit", "starts")).groupBy("key", "unit").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    starts = written(starts, "starts")
    remove(seen, anchors, uses, distinct, several, found, repeated)
    return starts


def spans(starts: Sequence[int], window: int) -> list[tuple[int, int]]:
    """The maximal spans (start, end) of windows that start in the runs first, last, first, last, ..."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts[::2], starts[1::2])):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + window))
        else:
            out.append((a, b + window))
    return out


def without(text: str, starts: list[int], unit: Unit) -> tuple[bytes, int, int]:
    """What is left of the text's bytes without the symbols of repeated windows, the count of removed bytes and of maximal runs of them."""
    raw = text.encode("utf-8", "surrogatepass")
    offset = [*unit.cut(raw)[1].tolist(), len(raw)]
    return removed(raw, [(offset[a], offset[b]) for a, b in spans(starts, unit.window)])


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text", units: tuple[Unit, ...] = (BYTES, WORDS), most: int = CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 by the first unit for each row of df, and n_repeated_<unit> for each further one: how many symbols repeat."""
    docs = keyed(df.select(F.col(doc_id).alias("doc_id"), text_column(text).alias("text")), "text")
    rows = written(docs.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole_sha256")), "rows")
    starts = repeated_runs(docs, units, most)
    made = T.StructType([T.StructField("n_removed", LONG), T.StructField("n_spans", LONG), T.StructField("kept_sha256", T.StringType())])

    def make(texts, lists):
        out = []
        for text, at in zip(texts, lists):
            kept, gone, many = without(text, at, units[0])
            out.append((gone, many, hashlib.sha256(kept).hexdigest()))
        return [list(x) for x in zip(*out)] if out else [[], [], []]

    mine = starts.where("unit = 0").select("key", "starts")
    done = written(add_columns(distinct_texts(docs).join(mine.hint("merge"), "key"), made, make, ["text", "starts"], sliced="text").select("key", *made.names), "removed")
    zero = F.lit(0).cast("long")
    columns = ["doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256")]
    out = rows.join(done, "key", "left")
    for k, unit in enumerate(units[1:], 1):
        name = f"n_repeated_{unit.name}"
        count = T.StructType([T.StructField(name, LONG)])
        counted = add_columns(starts.where(F.col("unit") == k).select("key", "starts"), count, lambda lists, window=unit.window: [[sum(b - a for a, b in spans(at, window)) for at in lists]], ["starts"])
        out = out.join(counted.select("key", name), "key", "left")
        columns.append(F.coalesce(name, zero).alias(name))
    return out.select(*columns)


def clean(df: DataFrame, text: str = "text", unit: Unit = WORDS) -> DataFrame:
    """df with repeated symbols taken out of text, all their copies; characters that lose some of their bytes go whole. Nulls stay."""
    key, name = "_key_of_text", "_starts_of_text"
    starts = repeated_runs(keyed(df.select(text_column(text).alias("text"))), (unit,)).select(F.col("key").alias(key), F.col("starts").alias(name))
    joined = keyed(df, text, key).join(starts.hint("merge"), key, "left")

    def make(texts, lists):
        return [[t if not at else without(t, at, unit)[0].decode("utf-8", "ignore") for t, at in zip(texts, lists)]]

    return add_columns(joined, T.StructType([T.StructField(text, T.StringType())]), make, [text, name], sliced=text).select(df.columns)
