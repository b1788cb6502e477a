"""Ranked search against scoring every document, the index's order and bounds, and odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from opinarium.llm import lexical

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(x.lower() if x < "\x80" else x for x in text or ""))


def plain(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(1 for c in counts if c), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), c in zip(docs, counts):
            if not c:
                continue
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r, None if null else doc, -s) for r, (s, null, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Über", "naïve", "слово", "3d"]
    docs = []
    for i in range(n):
        topic = rng.randrange(6)
        docs.append((i, " ".join(rng.choices(words[topic * 50 : topic * 50 + 60], k=rng.choice([3, 20, 20, 80])))))
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(25)]
    return docs + [(n + i, docs[i % 7][1]) for i in range(150)], items


@pytest.mark.parametrize("shard, cluster, at_once", [(4096, 64, 500), (50, 8, 7), (1, 1, 500)])
def test_equal_to_scoring_all(spark, shard, cluster, at_once):
    docs, items = corpus(3, 300 if shard > 1 else 40)
    index = lexical.build_index(spark.createDataFrame(docs, DOCS).repartition(3), shard_docs=shard, cluster=cluster)
    got = sorted(map(tuple, lexical.search(index, spark.createDataFrame(items, ITEMS), k=20, at_once=at_once).collect()), key=str)
    assert got == plain(docs, items, 20)


def test_odd_rows(spark):
    """Nulls, empty texts and items, ties and repeated rows, signs only, one long text, clashing columns."""
    docs = [(1, "a b"), (2, None), (3, ""), (4, "..., !"), (5, "A B"), (5, "A B"), (None, "a b"), (None, "a b"), (6, "c " * 30000 + "a"), (7, "É é e")] + [(100 - i, "tie tie") for i in range(90)]
    items = [(1, "a"), (1, "a"), (2, None), (3, "?"), (None, "tie"), (5, "É"), (6, "a a b c zzz"), (7, "absent")]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in docs], DOCS + ", item_id string, rank int, score int")
    asked = spark.createDataFrame([(*r, "x", 1) for r in items], ITEMS + ", doc_id string, score int")
    got = sorted(map(tuple, lexical.rank_documents(df, asked).collect()), key=str)
    assert got == plain(docs, items, 50) and len(got) > 60
    none = spark.createDataFrame([], DOCS)
    assert lexical.rank_documents(none, asked).count() == 0 and lexical.rank_documents(df, spark.createDataFrame([], ITEMS)).count() == 0
    assert lexical.rank_documents(spark.createDataFrame([(1, "..")], DOCS), asked).count() == 0


def test_tokens():
    for text in ("", "a", " a-b_c ", "Straße 10€ Ünïcode١", "x" * 5000 + " x"):
        found = lexical.terms_of(text.encode())[0]
        want = terms(text)
        assert len(found) == len(want) and len(set(found.tolist())) == len(set(want))


def test_long_texts_go_in_parts(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choices(["a", "bc", " ", "-", "é", "1", " x "], k=n)).encode() for n in (0, 1, 50, 400, 3)] + [b"z" * 300 + b" y", b"", b" " * 90]
    want = [x.tolist() for x in lexical.postings_of(texts)]
    for size in (1, 7, 64):
        monkeypatch.setattr(lexical, "SEGMENT", size)
        assert [x.tolist() for x in lexical.postings_of(texts)] == want
        assert all(b"".join(lexical.segments(t)) == t for t in texts) and max(map(len, lexical.segments(texts[3]))) < size + 40


def sharded(seed=1, topics=16, per=64):
    """Documents of some topics, dealt at random: (doc, term) postings and each document's topic."""
    rng = np.random.default_rng(seed)
    topic = rng.permutation(np.repeat(np.arange(topics), per))
    texts = [" ".join(f"t{t}x{x}" if x < 40 else f"c{x}" for x in rng.integers(0, 60, 30)).encode() for t in topic.tolist()]
    return texts, topic


def test_bisection_brings_topics_together():
    texts, topic = sharded()
    doc, term, _, _ = lexical.postings_of(texts)
    part = lexical.bisect(doc, np.unique(term, return_inverse=True)[1], len(texts))
    assert np.bincount(part).tolist() == [64] * 16
    purity = sum(np.bincount(topic[part == p]).max() for p in range(16)) / len(texts)
    assert purity > 0.8
    for n in (0, 1, 2, 63, 65, 1000):
        sizes = np.bincount(lexical.bisect(np.zeros(0, np.int64), np.zeros(0, np.int64), n)) if n else np.zeros(0)
        assert sizes.sum() == n and sizes.max(initial=0) <= 64


def test_bounds_hold_and_clusters_are_left_out():
    """No document exceeds its cluster's bound, and a search for one topic scores few clusters."""
    texts, topic = sharded()
    row = lexical.shard_row(0, list(range(len(texts))), *lexical.postings_of(texts))
    items = lexical.Items([(1, " ".join(f"t3x{i}" for i in range(12)))])
    frequency = Counter(t for x in texts for t in set(lexical.terms_of(x)[0].view(np.int64).tolist()))
    items.weigh(row["n_docs"], row["n_terms"], frequency)
    bound = lexical.bounds(row, items)[0][0]
    found, visited = lexical.visit(row, items, np.zeros(1, np.int64), 50)
    score = {d: s for _, d, s in lexical.visit(row, items, np.zeros(1, np.int64), 5000)[0]}
    for c, cluster in enumerate(row["clusters"]):
        assert max((score.get(d, 0) for d in cluster["doc_ids"]), default=0) <= bound[c]
    assert len(found) == 50 and visited <= 4 < len(row["clusters"])
    assert sorted(score.items(), key=lambda x: (-x[1], x[0]))[:50] == [(d, s) for _, d, s in found]


def test_index_is_read_in_small_parts(spark, monkeypatch):
    """A row is a cluster, a row group ends after few of them, and shards that several batches share are ranked alike."""
    monkeypatch.setattr(lexical, "ROW_GROUP", 1 << 14, raising=False)
    docs, items = corpus(5, 500)
    index = lexical.build_index(spark.createDataFrame(docs, DOCS).coalesce(1), cluster=8)
    rows = index.collect()
    assert len(rows) >= len(docs) / 8
    assert max(len(r["doc_ids"]) for r in rows) <= 8 and sorted(x for r in rows for x in r["doc_ids"]) == sorted(i for i, _ in docs)
    assert len({r["shard"] for r in rows}) == 1 and sum(r["n_docs"] for r in rows) == len(docs)
    groups = [file.row_group(i) for file in (pq.ParquetFile(x.removeprefix("file://")).metadata for x in index.inputFiles()) for i in range(file.num_row_groups)]
    assert len(groups) > 5 and max(g.num_rows for g in groups) < 30 and max(g.total_byte_size for g in groups) < 1 << 15
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(map(tuple, lexical.search(index, spark.createDataFrame(items, ITEMS), k=20).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(docs, items, 20)
