"""Spelling variants against every pair of words, and odd inputs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from opinarium.llm import spelling

DOCS = "doc_id long, text string"


def plain_counts(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(x.lower() if x < "\x80" else x for x in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = plain_counts(rows)
    found = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 2 * counts[w]:
            form[w] = best
    out = []
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(found[w]), counts.get(form.get(w))))
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀÿ") for _ in range(rng.choice([5, 5, 6, 6, 7, 8]))) for _ in range(120)]
    return rng, words


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_all_pairs(spark, seed):
    rng, words = rows_of(seed)
    rows = [(i or None, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=60))) for i in range(60)]
    got = sorted(map(tuple, spelling.group_variants(spark.createDataFrame(rows, DOCS)).collect()), key=lambda r: r[0])
    assert got == plain(rows) and sum(r[4] for r in got) > 40


def test_long_words_and_odd_rows(spark):
    """Words about and over LONG letters, nulls, empty texts, repeated rows, runs of one letter, clashing columns."""
    long = ["aaaaa", "aaaaaa", "aaaaaaa", *("x" * n for n in (63, 64, 65, 66)), "y" + "x" * 64, "x" * 64 + "y", "x" * 30 + "z" + "x" * 34, "q" * 300, "q" * 301, "r" + "q" * 300, "r" + "q" * 299]
    rows = [(i, " ".join(long).upper()) for i in range(4)] + [(5, "q" * 300), (5, "q" * 300), (5, "q" * 300), (6, None), (7, ""), (8, "a1b"), (None, None)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], DOCS + ", word string, n int, best string")
    got = sorted(map(tuple, spelling.group_variants(df).collect()), key=lambda r: r[0])
    assert got == plain(rows) and len(got) > 12
    assert spelling.group_variants(spark.createDataFrame([], DOCS)).count() == 0


def test_chains_of_forms(spark):
    rows = [(i, " ".join(["aaaaa"] * 160 + ["aaaab"] * 70 + ["aaabb"] * 30 + ["aabbb"] * 13 + ["abbbb"] * 6)) for i in range(3)]
    got = sorted(map(tuple, spelling.group_variants(spark.createDataFrame(rows, DOCS)).collect()), key=lambda r: r[0])
    assert got == plain(rows) and [r[2] for r in got] == ["aaaaa"] * 5


def test_hot_word(spark):
    """One word holds most of all occurrences; its many variants all lead to it."""
    rows = [(i, "popular " * 200 + " ".join(f"p{c}pular popula{c}" for c in "abcdefgh")) for i in range(30)]
    got = sorted(map(tuple, spelling.group_variants(spark.createDataFrame(rows, DOCS)).collect()), key=lambda r: r[0])
    assert got == plain(rows) and {r[2] for r in got} == {"popular"}


def test_hashes_of_deletions():
    letters = np.frombuffer(b"abcabdabbbb" * 3, np.uint8).reshape(3, 11)
    hashes = spelling.deletions(letters)
    for i in range(11):
        rest = np.delete(letters, i, 1)
        assert (hashes[:, i] == spelling.deletions(rest)[:, -1]).all()


def test_collisions_are_told_apart():
    """Equal keys of unlike strings make no neighbours."""
    words = [b"abcde", b"abcdf", b"vwxyz", b"vwxyq"]
    letters = np.frombuffer(b"".join(words), np.uint8)
    sizes, place = np.full(4, 5), np.array([4, 4, 4, 4], np.uint8)
    for order in ([0, 1, 2, 3], [0, 2, 1, 3], [3, 0, 2, 1]):
        flat = letters.reshape(4, 5)[order].ravel()
        got = spelling.neighbours(np.full(4, 7, np.uint64), np.array([9, 1, 5, 5])[order], sizes, place, np.ones(4, np.uint8), flat)
        assert {(w, int(n), b, int(c)) for w, n, b, c in zip(*got)} == {(b"abcde", 1, b"abcdf", 1), (b"abcdf", 1, b"abcde", 9), (b"vwxyz", 1, b"vwxyq", 5), (b"vwxyq", 1, b"vwxyz", 5)}
