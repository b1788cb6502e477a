"""Each stage of the pipeline on odd inputs and empty tables, and against plain versions."""

import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from opinarium.llm import common, packing, pii, quality

SF = "/root/testdata/sf0.001"
GOOD = "Some plain words about the weather in the hills, and about the people who walk there when it is warm. " * 3
PASSAGE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", " \n", "x" * 5000, GOOD, GOOD, f"{GOOD} one {PASSAGE} a", f"two {PASSAGE} b{GOOD[::-1]}", "mail a@b.com now", "слово 😀\n" * 300, "a b c d e"]
CLASH = ["key", "digest", "starts", "contexts", "spans", "score", "_score_of_text", "statistics", "node", "unit"]


def docs(spark):
    rows = [(i if i % 5 else None, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in CLASH})


@pytest.mark.parametrize("place", range(4))
def test_stage_on_odd_inputs(spark, place):
    name, stage = corpus_pipeline.STAGES[place]
    given = docs(spark)
    out = stage(spark, given, SF)
    assert out.columns == given.columns
    rows = out.collect()
    texts = [r["text"] for r in rows]
    assert all(r["key"] == "x" for r in rows)
    if name == "quality":
        assert {t for t in texts} <= set(TEXTS) and all((r["doc_id"], r["text"]) in {(x["doc_id"], x["text"]) for x in given.collect()} for r in rows)
    elif name == "near-duplicates":
        # One of each class: null and empty texts are equal; of rows repeated with one id one stays.
        assert sorted(t or "" for t in texts) == sorted({t or "" for t in TEXTS})
    elif name == "repeated passages":
        assert len(rows) == len(TEXTS) + 1 and not any(PASSAGE in (t or "") for t in texts) and texts.count(None) == 1 and "mail a@b.com now" in texts
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None)
    else:
        assert len(rows) == len(TEXTS) + 1 and "mail [EMAIL] now" in texts and texts.count(None) == 1
    assert stage(spark, given.where("1 = 0"), SF).count() == 0


def test_packing_of_odd_inputs(spark):
    out = corpus_pipeline.STAGES[4][1](spark, docs(spark), SF)
    assert out.columns == [x.split()[0] for x in packing.SCHEMA.split(", ")] and out.agg(F.sum((F.col("start") == 0).cast("int"))).first()[0] == len(TEXTS) + 1
    assert corpus_pipeline.STAGES[4][1](spark, docs(spark).where("1 = 0"), SF).count() == 0


def words_of(text):
    return [(m.start(), m[0]) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text)]


def classes(rows):
    """The rows that stay: of each component of shingle sets with a similarity of 0.8, the one of the least doc_id."""
    sets = {}
    for r in rows:
        w = [x for _, x in words_of(r["text"] or "")]
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else (r["text"] or "")
    least = {i: i for i in sets}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sets[i], sets[j]
        if a == b or (isinstance(a, set) and isinstance(b, set) and len(a & b) >= 0.8 * len(a | b)):
            low, high = sorted((root(i), root(j)))
            least[high] = low
    return {i for i in sets if root(i) == i}


def without_passages(texts):
    count = Counter(tuple(x for _, x in w[i : i + 50]) for w in map(words_of, texts) for i in range(len(w) - 49))
    out = []
    for text in texts:
        w = words_of(text)
        gone = {k for i in range(len(w) - 49) if count[tuple(x for _, x in w[i : i + 50])] > 1 for k in range(i, i + 50)}
        edge = [at for at, _ in w] + [len(text)]
        out.append(text[: edge[0]] + "".join(text[edge[k] : edge[k + 1]] for k in range(len(w)) if k not in gone))
    return out


def test_stages_equal_brute_force(spark):
    """Each stage over what its predecessor kept of the supplied documents, against a plain version."""
    given = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels")
    kept = given
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = {r["doc_id"]: r for r in kept.collect()}
        kept = common.written(stage(spark, kept, SF), f"stage{place}")
        after = {r["doc_id"]: r for r in kept.collect()}
        texts = [before[i]["text"] or "" for i in sorted(before)]
        if place == 0:
            trees = quality.fit(given, labels)
            scores = trees.score(np.array([quality.statistics(t) for t in texts]))
            assert set(after) == {i for i, s in zip(sorted(before), scores) if s >= 0.7}
        elif place == 1:
            assert set(after) == classes(before.values())
        else:
            want = without_passages(texts) if place == 2 else [pii.redacted(t, pii.find(t)) for t in texts]
            assert [after[i]["text"] for i in sorted(after)] == want and set(after) == set(before)
            assert place == 3 or want != texts
        assert all(after[i][c] == before[i][c] for i in after for c in ("lang", "source"))
    tokens = Tokenizer.from_file(packing.tokenizer_file())
    sizes = {i: len(tokens.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in after.items()}
    packed = corpus_pipeline.STAGES[4][1](spark, kept, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == sizes
