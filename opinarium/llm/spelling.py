"""Spelling variants: words one letter apart, grouped under the frequent form.

Words are counted by expressions. Two words are near if one insertion,
deletion or replacement makes one of the other; they then share a string that
a deletion leaves: at the same place for a replacement, or one of them is what
the other's deletion leaves. Prefix and suffix polynomial hashes give the
integer key of every deletion of a batch of words at once in numpy. Keys are
radix-partitioned by their top bits; each partition is sorted, and keys that
meet are verified on the strings. A group under one key holds words that
differ in one letter of one place, so it has no more words than there are
letters, and what a task hands on is a count and the best neighbour for each
word of a group, never its pairs.

Words over LONG letters would repeat themselves in as many keys as they have
letters; their keys carry numbers, and pairs are verified by a join.

Null texts count as empty; a null id counts as an empty string before the
colon; repeated rows count each; an empty table gives no words; extra columns
are not read. Counts that tie go by code points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, mix, powers, remove, text_column, written

LEAST_LETTERS, LEAST_COUNT = 5, 3
#: One run in so many loses a letter, by the checksum of its document and itself.
NOISE = 97
LONG = 64
#: Keys in a radix partition, about, and words whose keys are dealt to the partitions at once.
KEYS, WORDS = 1 << 19, 1 << 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"
ITSELF = LONG  # the place of a key that is the whole word


def count_words(df: DataFrame, text: str = "text", doc_id: str = "doc_id", noise: int = NOISE, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: runs of letters, A-Z lower-cased, some without a letter by their checksum."""
    runs = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_column(text), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    summed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h")).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    shorter = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    words = summed.select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def deletions(letters: np.ndarray) -> np.ndarray:
    """The hash of each row of letters (words of one length) without its k-th letter, in column k, and whole, in the last."""
    m, n = letters.shape
    up = powers(n + 1)[0]
    codes = letters.astype(np.uint64) + np.uint64(1)
    out = np.empty((m, n + 1), np.uint64)
    with np.errstate(over="ignore"):
        before = np.zeros((m, n + 1), np.uint64)  # of the letters before k, the first one times the first power
        np.cumsum(codes * up[:n], axis=1, dtype=np.uint64, out=before[:, 1:])
        after = np.zeros((m, n + 1), np.uint64)  # of those from k on, a power less each, as they move up
        after[:, 1:n] = np.cumsum((codes[:, 1:] * up[: n - 1])[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        out[:, :n] = before[:, :n] + after[:, 1:]
        out[:, n] = before[:, n]
    return out


def keys_of(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, whether for a replacement, key) of all keys of words of one length.

    A replacement's keys tell places apart; a deletion within a run of equal
    letters leaves the same whichever goes, so the first one's key stands for all.
    """
    m, n = letters.shape
    hashes = deletions(letters)
    place = np.arange(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        left = mix(hashes + np.where(place < n, n - 1, n).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        same_place = mix(left[:, :n] + (place[:n] + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    fresh = np.ones((m, n + 1), bool)
    fresh[:, 1:n] = letters[:, 1:] != letters[:, :-1]
    row, at = np.nonzero(fresh)
    r_row, r_at = np.divmod(np.arange(m * n), n)
    return np.concatenate([r_row, row]), np.concatenate([r_at, at]), np.repeat([True, False], [m * n, len(row)]), np.concatenate([same_place.ravel(), left[fresh]])


KEYED = "bucket int, keys binary, counts binary, sizes binary, places binary, kinds binary, letters binary"


def dealt(words: list[bytes], counts: np.ndarray, bits: int) -> Iterator[tuple]:
    """A row of KEYED for each radix partition with keys of these Latin-1 words of up to LONG letters."""
    sizes = np.array([len(w) for w in words], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.frombuffer(b"".join(words), np.uint8)
    parts = []
    for n in np.unique(sizes).tolist():
        which = np.flatnonzero(sizes == n)
        row, place, replaced, key = keys_of(flat[begin[which][:, None] + np.arange(n)])
        parts.append((which[row], np.where(place == n, ITSELF, place).astype(np.uint8), replaced, key))
    owner, place, replaced, key = (np.concatenate(x) for x in zip(*parts))
    bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        mine = order[a:b]
        whose = owner[mine]
        letters = flat[_ranges(begin[whose], sizes[whose])]
        yield int(bucket[mine[0]]), key[mine].tobytes(), counts[whose].tobytes(), sizes[whose].astype(np.uint8).tobytes(), place[mine].tobytes(), replaced[mine].astype(np.uint8).tobytes(), letters.tobytes()


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _padded(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), LONG), np.uint8)
    out[np.repeat(np.arange(len(sizes)), sizes), _ranges(np.zeros(len(sizes), np.int64), sizes)] = letters
    return out


def neighbours(key: np.ndarray, counts: np.ndarray, sizes: np.ndarray, place: np.ndarray, replaced: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, near, best word, its count) for each word of each group: how many others of the group are near, and the best of them."""
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    shared = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    begin = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    pick = order[shared]
    key, counts, place, replaced = key[pick], counts[pick], place[pick].astype(np.int64), replaced[pick].astype(bool)
    word = _padded(letters[_ranges(begin[pick], sizes[pick])], sizes[pick])
    gone = np.minimum(place, LONG)[:, None]
    columns = np.arange(LONG)
    rest = np.take_along_axis(np.concatenate([word, np.zeros((len(word), 1), np.uint8)], 1), columns + (columns >= gone), 1)
    spelt = word.view(f"S{LONG}").ravel()
    rank = np.unique(spelt, return_inverse=True)[1] if len(spelt) else np.zeros(0, np.int64)
    # What keys stand for, on the strings: groups of one key may only differ by a collision, which a sort by all of it tells apart.
    meant = np.concatenate([rest, replaced[:, None].astype(np.uint8), np.where(replaced, place, 0)[:, None].astype(np.uint8)], 1)
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    unlike = ~fresh
    unlike[1:] &= (meant[1:] != meant[:-1]).any(1)
    if unlike.any():
        digest = np.unique(meant.view(f"V{meant.shape[1]}").ravel(), return_inverse=True)[1]
        again = np.lexsort((digest, key))
        key, counts, place, replaced, spelt, rank, digest = (x[again] for x in (key, counts, place, replaced, spelt, rank, digest))
        fresh[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
    group = np.cumsum(fresh) - 1
    itself = ~replaced & (place == ITSELF)
    # In each group: the word that a deletion leaves, if there, then by falling count and code points.
    order = np.lexsort((rank, -counts, ~itself, group))
    counts, replaced, itself, spelt, group = (x[order] for x in (counts, replaced, itself, spelt, group))
    first = np.flatnonzero(np.diff(group, prepend=-1))
    size = np.diff(np.append(first, len(group)))
    head, at_head = np.repeat(first, size), np.arange(len(group))
    leads = at_head == head
    second = np.minimum(head + 1, max(0, len(group) - 1))
    many = np.repeat(size, size) > 1
    near = np.where(replaced | leads, np.repeat(size, size) - 1, 1)
    keep = many & (replaced | itself[head])
    best = np.where(leads, second, head)
    return spelt[keep], near[keep], spelt[best][keep], counts[best][keep]


FOUND = "word string, near long, best string, best_n long"


def _keyed(words: DataFrame, bits: int) -> DataFrame:
    names = [x.split()[0] for x in KEYED.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        counts: list[np.ndarray] = []

        def flush():
            if held:
                rows = list(zip(*dealt(held, np.concatenate(counts), bits)))
                held.clear()
                counts.clear()
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32())] + [pa.array(x, pa.binary()) for x in rows[1:]], names=names)

        for batch in batches:
            held += [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            counts.append(batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64))
            if len(held) >= WORDS:
                yield from flush()
        yield from flush()

    return words.mapInArrow(run, KEYED)


def _found(table: pa.Table) -> pa.Table:
    def joined(name, kind):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

    word, near, best, count = neighbours(joined("keys", np.uint64), joined("counts", np.int64), joined("sizes", np.uint8).astype(np.int64), joined("places", np.uint8), joined("kinds", np.uint8), joined("letters", np.uint8))
    text = [pa.array([x.decode("latin-1") for x in side.tolist()], pa.string()) for side in (word, best)]
    return pa.table({"word": text[0], "near": pa.array(near, pa.int64()), "best": text[1], "best_n": pa.array(count, pa.int64())})


def _long_pairs(words: DataFrame) -> DataFrame:
    """FOUND for words over LONG letters and their neighbours, a pair each way."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, word in zip(batch.column("number").to_pylist(), batch.column("word").to_pylist()):
                letters = np.frombuffer(word.encode("latin-1"), np.uint8)[None]
                place, key = (x for x in keys_of(letters)[1::2])
                if letters.size == LONG:  # only as what is left of a longer one
                    key = key[place == LONG]
                key = np.unique(key)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), number)), pa.array(key.view(np.int64))], names=["number", "key"])

    long = written(words.where(F.length("word") >= LONG).withColumn("number", F.monotonically_increasing_id()), "long-words")
    keyed = long.mapInArrow(run, "number long, key long")
    pairs = keyed.join(keyed.withColumnRenamed("number", "other"), "key").where("number <> other").select("number", "other").distinct()
    sides = pairs.join(long, "number").join(long.select(F.col("number").alias("other"), F.col("word").alias("best"), F.col("n").alias("best_n")), "other")
    near = sides.where((F.levenshtein("word", "best", 1) == 1) & (F.greatest(F.length("word"), F.length("best")) > LONG))
    return near.select("word", F.lit(1).cast("long").alias("near"), "best", "best_n")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best and best_n for each of words (word, n) that has near words; words is read three times."""
    importable(words.sparkSession)
    total = words.agg(F.coalesce(F.sum(2 * F.length("word")), F.lit(0)).alias("keys"), F.coalesce(F.max(F.length("word")), F.lit(0)).alias("most")).first()
    bits = max(0, int(np.ceil(np.log2(max(1, total["keys"] / KEYS)))))
    found = _keyed(words.where(F.length("word") <= LONG), bits).groupBy("bucket").applyInArrow(_found, FOUND)
    if total["most"] > LONG:
        found = found.union(_long_pairs(words))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("top")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("top.best").alias("best"), (-F.col("top.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last word that forms (word, form) lead to; pointers double in each round, and chains are as short as counts can double."""
    forms = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = forms.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(forms.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        done = after.where("moved").isEmpty()
        remove(forms)
        forms = after.select("word", "root")
        if done:
            return forms


def group_variants(df: DataFrame, text: str = "text", doc_id: str = "doc_id", times: int = 2, **counting) -> DataFrame:
    """word, form, root, n, n_near, form_n: each counted word, its best near word if that is times as frequent, and where forms lead."""
    words = written(count_words(df, text, doc_id, **counting), "words")
    better = F.col("best_n") >= times * F.col("n")
    judged = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"))
    judged = written(judged, "forms-judged")
    led = roots(judged.where("form is not null"))
    return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
