"""Best-fit packing into few sequences by linear grouping.

Documents are tokenised once, cut only where they exceed the capacity, and
the pieces are written to the shared folder. Whole sequences need no more
work; the other pieces are dealt to blocks of about BLOCK rows, each by its own
number, so that neither repeated rows nor long documents make a block large.
In a block, pieces over a LARGE share of the capacity are sorted and
put into groups of equal cardinality, and their lengths are rounded up to the
largest of their group: that leaves few sizes, for which the linear program
over all configurations (multisets that fit) is solved by generating columns,
priced by a knapsack. Whole multiples of the configurations are taken, actual
pieces are substituted for the rounded ones (the longest that fit, so that what
rounding up left free is used), what remains of the large ones is put in by
best fit, longest first, and then so are the small ones. A few numbers of
groups are tried; the fewest sequences win.

Null texts count as empty and hold only the end id; repeated rows are packed
each; null ids stay null; an empty table gives no pieces; extra columns are
not read. A block ends with one sequence that is not full, at most so many more
than one packing of everything would need.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, mix, remove, slices, text_column, written

CAPACITY = 2048
#: Pieces in a block, about.
BLOCK = 1 << 14
#: What is tried: pieces longer than a share of the capacity are put into so many groups.
TRIES = ((1 / 5, 16), (1 / 5, 64), (1 / 8, 64))
#: Chunks and words whose ids a worker keeps, each in a fresh and an old half.
KEPT = 600_000

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PIECES = SCHEMA.replace("sequence_id long, offset long", "sequence_id long, deal long")

#: Texts of these characters only are cut into words here: they are alike in every Unicode form and in any version of the tables.
PLAIN = re.compile("[\x00-ɏ]*")
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_²³¹¼½¾]+|[\\d²³¹¼½¾]|(?:[^\\s\\w]|_)+")
#: What the tokenizer takes for white space; str.split() also splits at four more.
MORE_SPACE = re.compile("[\x1c-\x1f]")


class Words:
    """Ids of texts by a word-level tokenizer file: words are found once and their ids kept.

    The tokenizer lower-cases, splits at white space and then into words, each
    of which its merges handle alone; so a text's ids are those of its chunks
    between white space. Texts with other characters, or with the string of an
    added token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [token["content"] for token in spec["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model = self.whole.model
        self.letters = byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            tokens = self.model.tokenize(word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()]))
            found = array("I", [t.id for t in tokens]).tobytes()
            if len(word) <= 64:
                if len(self.words) >= KEPT:
                    self.words.clear()
                self.words[word] = found
        return found

    def chunk(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.word(chunk) if chunk.isalpha() else b"".join(map(self.word, WORD.findall(chunk)))
        if len(chunk) <= 64:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        """The ids, four bytes each, little-endian."""
        if not PLAIN.fullmatch(text) or (self.added and self.added.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        lower = text.lower()
        if not lower.isascii() and not PLAIN.fullmatch(lower) or MORE_SPACE.search(lower):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        young = self.young
        chunks = lower.split()
        known = list(map(young.get, chunks))
        if None in known:
            known = [k if k is not None else self.chunk(c) for k, c in zip(known, chunks)]
        return b"".join(known)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


@lru_cache(2)
def encoder(path: str) -> Callable[[str], bytes]:
    return Words(path).ids


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- packing of lengths ---


def _best_configuration(sizes: np.ndarray, most: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of the largest value: a bounded knapsack by size, most[g] of each at most."""
    best = np.zeros(capacity + 1)
    copies = []
    for size, limit, worth in zip(sizes.tolist(), most.tolist(), value.tolist()):
        took = np.zeros(capacity + 1, np.int8)
        if worth > 1e-12:
            base = best
            for k in range(1, min(limit, capacity // size) + 1):
                offer = base[: capacity + 1 - k * size] + k * worth
                better = offer > best[k * size :] + 1e-12
                if k == 1:
                    best = base.copy()
                best[k * size :][better] = offer[better]
                took[k * size :][better] = k
        copies.append(took)
    out, room = np.zeros(len(sizes), np.int64), int(np.argmax(best))
    total = float(best[room])
    for g in range(len(sizes) - 1, -1, -1):
        out[g] = copies[g][room]
        room -= int(out[g]) * int(sizes[g])
    return total, out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """(columns, how often each): a best fractional use of configurations that hold counts of sizes, by column generation.

    Columns of the basis price the sizes; the configuration worth most enters
    until none is worth more than a sequence, or after so many rounds, when the
    columns found so far hold all counts as well.
    """
    g = len(sizes)
    basis = np.zeros((g, g))
    first = np.minimum(np.maximum(1, capacity // sizes), np.maximum(1, counts))
    basis[np.arange(g), np.arange(g)] = first
    inverse = np.diag(1.0 / first)
    use = counts / first
    for _ in range(rounds):
        price = inverse.sum(0)
        worth, column = _best_configuration(sizes, counts, price, capacity)
        if worth <= 1 + 1e-9:
            break
        step = inverse @ column
        rising = step > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, use / np.where(rising, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = max(0.0, ratio[out])
        use = use - amount * step
        use[out] = amount
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
        basis[:, out] = column
    return basis.T.astype(np.int64), np.maximum(use, 0)


class _Pieces:
    """Pieces that are still to be placed, by their lengths."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(lengths, kind="stable")
        self.lengths, first = np.unique(lengths[order], return_index=True)
        self.of = dict(zip(self.lengths.tolist(), map(np.ndarray.tolist, np.split(order, first[1:]))))
        self.lengths = self.lengths.tolist()

    def longest(self, most: int) -> tuple[int, int] | None:
        """Takes out a longest piece of up to most: (length, piece)."""
        at = bisect.bisect_right(self.lengths, most) - 1
        if at < 0:
            return None
        size = self.lengths[at]
        same = self.of[size]
        piece = same.pop()
        if not same:
            del self.of[size], self.lengths[at]
        return size, piece


class _Bins:
    """Sequences by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.open = capacity, 0, []

    def add(self, room: int) -> int:
        if room:
            bisect.insort(self.open, (room, self.count))
        self.count += 1
        return self.count - 1

    def best_fit(self, size: int) -> int:
        """The sequence with the least room that takes size, or a new one."""
        at = bisect.bisect_left(self.open, (size, -1))
        if at == len(self.open):
            return self.add(self.capacity - size)
        room, which = self.open.pop(at)
        if room > size:
            bisect.insort(self.open, (room - size, which))
        return which


def grouped(lengths: np.ndarray, capacity: int = CAPACITY, large: float = TRIES[0][0], groups: int = TRIES[0][1]) -> np.ndarray:
    """The sequence of each piece (of a length up to capacity), by linear grouping of those over a share of it into so many groups."""
    to = np.full(len(lengths), -1, np.int64)
    is_large = lengths > capacity * large
    falling = -np.sort(-lengths[is_large])
    bins = _Bins(capacity)
    if len(falling):
        begin = np.arange(0, len(falling), -(-len(falling) // groups))
        # Rounded up to the largest of each group; groups of one size are one.
        sizes, which = np.unique(-falling[begin], return_inverse=True)
        sizes, counts = -sizes, np.bincount(which, np.diff(np.append(begin, len(falling)))).astype(np.int64)
        columns, use = configurations(sizes, counts, capacity)
        pieces, own = _Pieces(lengths[is_large]), np.flatnonzero(is_large)
        for k in np.lexsort(columns.T[::-1])[::-1].tolist():
            slots = np.repeat(sizes, columns[k]).tolist()
            for _ in range(int(use[k] + 1e-6)):
                room, number = capacity, bins.count
                rounded = 0
                for n, slot in enumerate(slots, 1):
                    rounded += slot
                    # A piece is shorter than its slot; what that leaves goes to the slots after it, and the last one may take all room.
                    found = pieces.longest(room if n == len(slots) else room - (capacity - rounded) if rounded <= capacity else 0)
                    if found:
                        room -= found[0]
                        to[own[found[1]]] = number
                while found := pieces.longest(room):  # large ones that fit though their groups' sizes don't
                    room -= found[0]
                    to[own[found[1]]] = number
                if room < capacity:
                    bins.add(room)
    for piece in np.argsort(-lengths, kind="stable").tolist():  # what is left of the large ones, then the small ones, longest first
        if to[piece] < 0:
            to[piece] = bins.best_fit(int(lengths[piece]))
    return to


def fewest(lengths: np.ndarray, capacity: int = CAPACITY, tries: Iterable[tuple[float, int]] = TRIES) -> np.ndarray:
    """grouped() with what needs the fewest sequences of all that is tried; it ends where none can need fewer."""
    best, least = np.zeros(0, np.int64), -(-int(lengths.sum()) // capacity)
    for large, groups in tries if len(lengths) else ():
        to = grouped(lengths, capacity, large, groups)
        if not len(best) or to.max() < best.max():
            best = to
        if best.max() + 1 <= least:
            break
    return best


# --- Spark ---


def cut(df: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """PIECES: documents' pieces; whole ones have a sequence of their own, the others a number by which to deal them."""
    importable(df.sparkSession)
    path = tokenizer or tokenizer_file()
    end = np.array([end_id], "<u4").tobytes()
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, own, at = encoder(path), TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, "text"):
                keys, numbers, starts, sizes, sums = [], [], [], [], []
                for key, words in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = encode(words) + end
                    for number, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start : start + 4 * capacity]
                        keys.append(key)
                        numbers.append(number)
                        starts.append(start // 4)
                        sizes.append(len(piece) // 4)
                        sums.append(zlib.crc32(piece))
                own_ids = np.arange(own + at, own + at + len(keys), dtype=np.int64)
                at += len(keys)
                size = np.array(sizes, np.int64)
                deal = (mix(own_ids.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
                whole = size == capacity
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(size), pa.array(sums, pa.int64()), pa.array(own_ids, mask=~whole), pa.array(deal, mask=whole)], names=names)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), text_column(text).alias("text")).mapInArrow(run, PIECES)


def pack(df: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, end_id: int = 0, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """SCHEMA for the pieces of all documents, in few sequences. Sequence ids are unique, not consecutive."""
    pieces = written(cut(df, text, doc_id, tokenizer, end_id, capacity), "pieces")
    rest = pieces.where("deal is not null")
    blocks = max(1, -(-rest.count() // block))
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def fill(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy().astype(np.int64)
        to = fewest(lengths, capacity)
        order = np.argsort(to, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.flatnonzero(np.diff(to[order], prepend=-1))
        offset = np.empty(len(to), np.int64)
        offset[order] = ends - lengths[order] - np.repeat((ends - lengths[order])[first], np.diff(np.append(first, len(to))))
        sequence = (1 << 62) + (table.column("block")[0].as_py() << 32) + to
        made = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
        return pa.table({c: made.get(c, table.column(c) if c in table.column_names else None) for c in columns})

    packed = rest.withColumn("block", F.col("deal") % blocks).drop("sequence_id", "deal").groupBy("block").applyInArrow(fill, SCHEMA)
    whole = pieces.where("deal is null").select(*columns[:-1], F.lit(0).cast("long").alias("offset"))
    return whole.union(packed)
