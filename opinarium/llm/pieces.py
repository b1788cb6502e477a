"""Subword encoding and decoding with a weighted finite-state transducer.

A model file is compiled into arcs: the normaliser's (one state: white space
to its mark, a mark in front), the pieces' (a tree of states by characters; the
arc that leaves a piece's last character gives its id and weight), the byte
fallback's (a character without a piece gives its bytes' ids), and those of a
machine that remembers the last piece and weighs each pair of neighbours.
Composed with an input they make a lattice of positions and last pieces. path() relaxes all arcs
from left to right in the tropical semiring: a distance is the least sum of
weights, of all arcs into a state.

Models of the unigram kind weigh a piece by its negative score, and pairs by
nothing. Models that merge pairs weigh pieces by nothing, and a pair of
neighbours by 0 or infinity: infinity where merging would have joined
characters across their boundary first. So the only path of a finite distance
is what merging makes. Runs of marks have pieces of equal rank there; for them
the least number of pieces counts, the longest first.

No piece spans a character pair that is within no piece, so paths decompose
at such cuts, and the shortest paths of the parts between them are cached.

Null texts count as empty; an empty text has no ids and decodes to an empty
text; repeated rows get equal results; an empty table gives an empty table;
columns of df named like a result column are replaced. Decoding restores a
text but for literal marks, which come back as spaces.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import add_columns

MARK = "▁"
#: Of the tropical semiring (sums along paths, the least of all paths) the one and the zero.
FREE, NEVER = 0.0, float("inf")
#: What a character without a piece weighs more than the worst piece of a unigram model.
UNKNOWN = 10.0
UNIGRAM = 1
NORMAL, BYTE = 1, 6
#: Paths that are kept, of parts and words up to KEPT characters.
CACHE, KEPT = 500_000, 48
END = ""  # no piece ends in a state, or before a position


def fields(data: bytes):
    """(number, value) for each field of a protocol buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else varint(i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class Transducer:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        self.pieces: list[str] = []
        self.rank: dict[str, float] = {}
        self.byte: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.prefix, self.merges = True, True
        kinds = []
        for number, value in model:
            if number == 1:
                piece = dict(fields(value))
                name, score, kind = piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)
                if kind == NORMAL:
                    self.rank[name], self.ids[name] = score, len(self.pieces)
                elif kind == BYTE:
                    self.byte[int(name[3:5], 16)] = len(self.pieces)
                kinds.append(kind)
                self.pieces.append(name)
            elif number == 2:
                self.merges = dict(fields(value)).get(3, UNIGRAM) != UNIGRAM
            elif number == 3:
                spec = dict(fields(value))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only the identity normaliser that keeps white space is compiled")
                self.prefix = bool(spec.get(3, 1))
        if not self.byte:
            raise ValueError("the model has no byte pieces")
        self.kinds = kinds
        self.pairs = {name[i : i + 2] for name in self.rank for i in range(len(name) - 1)}
        self.known = {name: i.to_bytes(4, "little") for name, i in self.ids.items()}
        self.longest = max(map(len, self.rank))
        self.runs = {n: self.ids[MARK * n] for n in range(1, self.longest + 1) if MARK * n in self.ids}
        self.order = {name: -score for name, score in self.rank.items()}
        self.split: dict[str, tuple[str, str]] = {}
        self.spelling: dict[str, bytes] = {}
        self.weights: dict[tuple[str, str], float] = {}
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.unknown = FREE if self.merges else UNKNOWN - min(self.rank.values())
        self.tree: dict = {}  # by character: the states after it, the piece that ends here and its weight
        for name, score in self.rank.items():
            # Of a model that merges: the pieces that merging makes; runs of marks are met apart from words.
            if not self.merges or len(name) == 1 or (name[1] != MARK and self.merged(name) == [name]):
                self.arc(name, FREE if self.merges else -score)

    def arc(self, piece: str, weight: float) -> None:
        """The states and arcs of a piece."""
        children = self.tree
        for character in piece[:-1]:
            children = children.setdefault(character, ({}, END, FREE))[0]
        children[piece[-1]] = (children[piece[-1]][0] if piece[-1] in children else {}, piece, weight)

    def merged(self, text: str) -> list[str]:
        """The segmentation of a short text by its definition: best pair first, leftmost of equals."""
        out, rank = list(text), self.rank
        while len(out) > 1:
            best, at = max(((rank.get(out[i] + out[i + 1], -np.inf), -i) for i in range(len(out) - 1)))
            if best == -np.inf:
                break
            out[-at : -at + 2] = [out[-at] + out[-at + 1]]
        return out

    def halves(self, piece: str) -> tuple[str, str]:
        """The two pieces that the last merge makes a piece of."""
        found = self.split.get(piece)
        if found is None:
            out, rank = list(piece), self.rank
            while len(out) > 2:
                best, at = max(((rank.get(out[i] + out[i + 1], -np.inf), -i) for i in range(len(out) - 1)))
                out[-at : -at + 2] = [out[-at] + out[-at + 1]]
            found = self.split[piece] = (out[0], out[1])
        return found

    def pair(self, left: str, right: str) -> float:
        """The weight of neighbours in a model that merges.

        Merges are undone from the latest on, on either side of the boundary;
        it is infinite if what then meets there would have merged earlier.
        """
        key = (left, right)
        found = self.weights.get(key)
        if found is None:
            if len(self.weights) > 2 * CACHE:
                self.weights.clear()
            order, limit, found = self.order, np.inf, FREE
            while (left[-1] + right[0]) in self.pairs:
                joined = order.get(left + right)
                if joined is not None and joined < limit:
                    found = NEVER
                    break
                a, b = order[left] if len(left) > 1 else -1, order[right] if len(right) > 1 else -1
                if a == b == -1:
                    break
                # Of merges of one rank the left one comes first.
                if a > b:
                    left, limit = self.halves(left)[1], a
                else:
                    right, limit = self.halves(right)[0], b + 0.5
            self.weights[key] = found
        return found

    def path(self, text: str) -> bytes:
        """Ids on the shortest path through a part.

        A position is one state: pairs have no weights in unigram models, and of
        the pieces that end at a position of a merging model one at most has a
        finite distance.
        """
        n, tree, merges, weights, pair = len(text), self.tree, self.merges, self.weights, self.pair
        distance, start_of, last = [FREE] + [NEVER] * n, [0] * (n + 1), [END] * (n + 1)
        for start in range(n):
            here, before = distance[start], last[start]
            if here == NEVER:
                continue
            children, end, known = tree, start, False
            for character in text[start:]:
                state = children.get(character)
                if state is None:
                    break
                end += 1
                children, piece, weight = state
                if piece:
                    if before and merges:
                        step = weights.get((before, piece))
                        if step is None:
                            step = pair(before, piece)
                        total = here + weight + step
                    else:
                        total = here + weight
                    if total < distance[end]:
                        distance[end], start_of[end], last[end] = total, start, piece
                    known = known or end == start + 1
            if not known and here + self.unknown < distance[start + 1]:  # by its bytes
                distance[start + 1], start_of[start + 1], last[start + 1] = here + self.unknown, start, text[start]
        out: list[str] = []
        while n:
            out.append(last[n])
            n = start_of[n]
        ids = self.known
        return b"".join([ids[p] if p in ids else self.spelt(p) for p in reversed(out)])

    def spelt(self, character: str) -> bytes:
        """The byte arcs of a character without a piece."""
        found = self.spelling.get(character)
        if found is None:
            found = self.spelling[character] = b"".join(self.byte[b].to_bytes(4, "little") for b in character.encode("utf-8", "surrogatepass"))
        return found

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            found = self.path(text)
            if len(text) <= KEPT:
                if len(self.parts) > CACHE:
                    self.parts.clear()
                self.parts[text] = found
        return found

    def word(self, text: str) -> bytes:
        """Ids of a word with the mark in front, if any: the parts between cuts."""
        pairs = self.pairs
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in pairs]
        return b"".join([self.part(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])]) if cuts else self.part(text)

    def marked(self, word: str) -> bytes:
        """word() of a word after a mark, kept for its next use."""
        found = self.words.get(word)
        if found is None:
            found = self.word(MARK + word)
            if len(word) <= KEPT:
                if len(self.words) > CACHE:
                    self.words.clear()
                self.words[word] = found
        return found

    def run(self, n: int) -> bytes:
        """Ids of n marks in a row: the fewest arcs, longest first."""
        out = []
        while n:
            size = max(k for k in self.runs if k <= n)
            out.append(self.runs[size])
            n -= size
        return np.array(out, "<u4").tobytes()

    def encoded(self, text: str) -> bytes:
        """The ids of a text, four bytes each, little-endian."""
        if not text:
            return b""
        text = text.replace(" ", MARK)
        if self.prefix:
            text = MARK + text
        if not self.merges:
            return self.word(text)
        first, *rest = text.split(MARK)
        out = [self.word(first)] if first else []
        if "" not in rest:
            known = list(map(self.words.get, rest))
            if None in known:
                known = [k if k is not None else self.marked(w) for k, w in zip(known, rest)]
            return b"".join(out + known)
        alone = np.uint32(self.runs[1]).tobytes()
        spare = 0  # marks before the one that goes with the next word
        for word in rest:
            if not word:
                spare += 1
                continue
            found = self.marked(word)
            if spare and found[:4] == alone:
                out += [self.run(spare + 1), found[4:]]
            else:
                out += [self.run(spare), found]
            spare = 0
        return b"".join(out) + self.run(spare)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), "<u4").tolist()

    def decode(self, ids) -> str:
        """The inverse: pieces and bytes in order, marks to spaces, less the mark in front."""
        pieces, kinds = self.pieces, self.kinds
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if kinds[i] == BYTE:
                held.append(int(pieces[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if kinds[i] == NORMAL:
                out.append(pieces[i])
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(df: DataFrame, text: str = "text", model: str | None = None, to: str = "ids") -> DataFrame:
    """df with the ids of text."""
    path = model or model_file()

    def make(texts):
        t = transducer(path)
        return [[t.encode(x or "") for x in texts]]

    return add_columns(df, T.StructType([T.StructField(to, T.ArrayType(T.IntegerType()))]), make, [text], sliced=text)


def decode(df: DataFrame, ids: str = "ids", model: str | None = None, to: str = "decoded") -> DataFrame:
    """df with the text that ids stand for; null ids give an empty text."""
    path = model or model_file()

    def make(rows):
        t = transducer(path)
        return [[t.decode(x or ()) for x in rows]]

    return add_columns(df, T.StructType([T.StructField(to, T.StringType())]), make, [ids])


def digest(df: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 and lossless for each row: encoded and decoded in one pass."""
    path = model or model_file()
    made = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())])

    def make(texts):
        t = transducer(path)
        out: list[tuple] = []
        for x in texts:
            ids = t.encoded(x or "")
            decoded = t.decode(np.frombuffer(ids, "<u4").tolist())
            out.append((len(ids) // 4, zlib.crc32(ids), sha256(decoded.encode()).hexdigest(), decoded == (x or "")))
        return list(zip(*out)) if out else [[], [], [], []]

    return add_columns(df.select("doc_id", text), made, make, [text], sliced=text).select("doc_id", *made.names)
