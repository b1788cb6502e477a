"""Best-fit packing: ids of the named tokenizer, all ids once, few sequences, odd inputs."""

import itertools
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from opinarium.llm import binpacking

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def named():
    return Tokenizer.from_file(binpacking.tokenizer_file())


def test_ids_of_every_plain_character(named):
    """Each character that is cut into words here, alone and between others, and characters that are not."""
    encode = binpacking.encoder(binpacking.tokenizer_file())
    for code in [*range(0x250), 0x301, 0x3A3, 0x430, 0x1E9E, 0x2009, 0x2028, 0x212A, 0xFB01, 0x1F600]:
        c = chr(code)
        for text in (c, f"a{c}b", f"Stop{c} 12{c}3 {c}'s it'{c}"):
            assert np.frombuffer(encode(text), "<u4").tolist() == named.encode(text, add_special_tokens=False).ids, hex(code)


def test_ids_of_random_texts(named):
    encode, rng = binpacking.encoder(binpacking.tokenizer_file()), random.Random(4)
    signs = ["'s", "'LL", "don't", "²", "½", "_", "__a", "1a2", " ", "  \n", "\t", " ", "…", "é", "É", "İ", "ß", "ẞ", "Σ", "<|endoftext|>", "<|", "a", "Word", "word", "-", "...", "x" * 70, "\x1c", "\x85", "ǅ", "ŉ"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randrange(12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == named.encode(text, add_special_tokens=False).ids, repr(text)


def plain_fewest(lengths, capacity):
    """The least number of sequences, by trying."""
    for n in itertools.count(max(1, -(-sum(lengths) // capacity))):
        rooms = [capacity] * n

        def place(k):
            if k == len(lengths):
                return True
            for i in range(n):
                if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                    rooms[i] -= lengths[k]
                    if place(k + 1):
                        return True
                    rooms[i] += lengths[k]
            return False

        lengths = sorted(lengths, reverse=True)
        if place(0):
            return n


def test_small_sets_are_packed_best():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 20, 50])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))]
        to = binpacking.fewest(np.array(lengths), capacity)
        assert np.bincount(to, lengths).max() <= capacity
        assert to.max() + 1 <= plain_fewest(lengths, capacity) + 1


def first_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= x), None)
        if at is None:
            rooms.append(capacity - x)
        else:
            rooms[at] -= x
    return len(rooms)


@pytest.mark.parametrize("low, high, better", [(1, 2049, 0), (500, 1000, 0.05), (300, 700, 0.03), (5, 400, 0), (1025, 2049, 0)])
def test_grouping_needs_no_more_than_first_fit_and_far_fewer_where_configurations_matter(low, high, better):
    lengths = np.random.default_rng(7).integers(low, high, 2500)
    to = binpacking.fewest(lengths)
    n = int(to.max()) + 1
    assert np.bincount(to, lengths).max() <= 2048 and -(-lengths.sum() // 2048) <= n
    assert n <= first_fit(lengths.tolist(), 2048) * (1 - better)


def test_configurations_hold_all_and_are_optimal():
    sizes, counts = np.array([7, 5, 3]), np.array([10, 10, 10])
    columns, use = binpacking.configurations(sizes, counts, 10)
    assert (columns @ sizes <= 10).all() and np.allclose(use @ columns, np.maximum(use @ columns, counts))
    assert abs(use.sum() - 15) < 1e-6  # 7+3 ten times, 5+5 five times


def check(rows, got, named, capacity):
    texts = {}
    for key, text in rows:
        texts.setdefault(key, []).append(named.encode(text or "", add_special_tokens=False).ids + [0])
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for at in filled.values():
        at.sort()
        assert at[0][0] == 0 and all(a + b == c for (a, b), (c, _) in itertools.pairwise(at)) and sum(at[-1]) <= capacity
    found = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    want = sorted((str(k), p, p * capacity, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, all_ids in texts.items() for ids in all_ids for p in range(-(-len(ids) // capacity)) for x in [ids[p * capacity : (p + 1) * capacity]])
    assert found == want
    return len(filled), -(-sum(len(i) for x in texts.values() for i in x) // capacity)


def test_pieces_of_documents(spark, named):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["the", "zebra", "naïve", "don't", "x1"], k=rng.choice([0, 1, 3, 10, 40, 300])))) for i in range(120)] + [(500, None), (501, ""), (None, "no id"), (7, "again"), (7, "again"), (502, "word " * 63), (503, "word " * 64), (504, "word " * 5000)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], DOCS + ", block int, length string, deal int").repartition(3)
    for block in (1 << 14, 40):
        sequences, least = check(rows, binpacking.pack(df, capacity=64, block=block).collect(), named, 64)
        assert sequences <= least + 6
    assert binpacking.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_one_row_repeated(spark, named):
    rows = [(1, "same text over and over")] * 300 + [(i, "other") for i in range(2, 40)]
    sequences, least = check(rows, binpacking.pack(spark.createDataFrame(rows, DOCS), capacity=64, block=50).collect(), named, 64)
    assert sequences <= 1.15 * least + 8
