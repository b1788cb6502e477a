"""Many brands in one job, against brand by brand; k-means against a plain one."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinarium.functions.regexes import java, matches
from opinarium.operators import catalogue, prototypes, rules
from opinarium.plans.config import BrandProfile


@pytest.mark.parametrize(
    "pattern, want",
    [("abc", ["abc"]), (r"\bAbc\b", ["abc"]), ("ab?cde", ["cde"]), ("(ab|cd)ef", ["ef"]), ("ab|cd", ["ab", "cd"]), ("ab|c?", []), ("[ab]", []), ("a(?:bcd)+e", ["bcd"]), ("(?i)стРАСС|Σας", ["страсс", "σασ"]), (r"a\|b|[|)]cd", ["a|b", "cd"]), ("(", []), ("x{2,}yz", ["yz"]), ("(?<!q)ab(?=c)", ["ab"])],
)
def test_required_texts(pattern, want):
    assert catalogue.literals(pattern) == want


def brands(n):
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("абвгßσ") for _ in range(rng.randrange(2, 5)))
    out = {f"b{i:04}": BrandProfile(name(), "", [name() for _ in range(rng.randrange(3))], [rf"\b{name()[:2]}", "ваканси", "("], [name()[:2]], homonym_noise=[name()[:3]]) for i in range(n)}
    out["any"] = BrandProfile.of({"brand_name": " ", "aliases": []})
    return out


def texts(spark, n):
    rng = random.Random(9)
    words = ["".join(rng.choice("абвгßσΣς") for _ in range(rng.randrange(2, 5))) for _ in range(400)]
    rows = [(i, rng.choice([str.upper, str.lower, str])(" ".join(rng.choices(words, k=rng.randrange(12))))) for i in range(n)] + [(n, None), (n + 1, "")]
    return spark.createDataFrame(rows, "i long, t string")


def test_brands_of_texts_equal_brand_by_brand(spark):
    profiles, df = brands(40), texts(spark, 150).cache()
    got = sorted(map(tuple, catalogue.mentioned_brands(df, "t", profiles).select("i", "brand", "rule_code", "pattern", "is_drop").collect()), key=str)
    want = []
    for name, p in profiles.items():
        own = rules.with_rules(df.where(matches(F.col("t"), p.brand())), "t", p)
        want += [(r["i"], name, r["rule_code"], r["pattern"], r["is_drop"]) for r in own.collect()]
    assert got == sorted(want, key=str) and len({r[1] for r in got}) > 20 and {r[4] for r in got} == {"Yes", "No"}
    assert catalogue.mentioned_brands(df.where("i < 0"), "t", profiles).count() == 0


def test_plain_words_are_decided_as_patterns_are(spark, monkeypatch):
    """Words alone need no search of the text; all letters and neighbours count as they do in Java's patterns."""
    letters = "abcdefghijklmnopqrstuvwxyzабвгдеёжзийклмнопрстуфхцчшщъыьэюя0129"
    chars = [(c, chr(c)) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    alike = F.array_compact(F.array(*[F.when(F.col("x").rlike(java(a, True)), F.lit(a)) for a in letters]))
    for r in spark.createDataFrame(chars, "c int, x string").repartition(4).select("x", alike.alias("a")).where("size(a) > 0").collect():
        assert r["a"] == [catalogue.plain_folded(r["x"])], r
    rng = random.Random(4)
    odd = ["k", "K", "\u212a", "s", "ſ", "i", "ı", "İ", "ß", "é", "e\u0301", "²", "Ⅷ", "Ⓐ", "_", "-", "–", "«", "\u200d", "‿", " ", "\n", "ка", "Ка", "ёж", "ᲂ", "о", "О", "5", "٣", "汉", "😀", "𝒌", "™", "ª", "ˆ", "´", "\u00ad"]
    rows = [(i, "".join(rng.choices(odd, k=rng.randrange(1, 9)))) for i in range(3000)] + [(9000, ""), (9001, None)]
    df = spark.createDataFrame(rows, "i long, t string").repartition(4).cache()
    profiles = {f"b{n}": BrandProfile(n, "", [a], [d, "(?i)" + a, r"\bk"], [a + "k"], homonym_noise=["s"]) for n, a, d in (("k", "ks", "Si"), ("о", "KА", "i"), ("5", "ik", "ЁЖ"), ("s-i", "к", "k5"), ("sk", "ёж", "К"))}
    got = sorted(map(tuple, catalogue.mentioned_brands(df, "t", profiles).select("i", "brand", "rule_code", "pattern", "is_drop").collect()), key=str)
    want = []
    for name, p in profiles.items():
        want += [(r["i"], name, r["rule_code"], r["pattern"], r["is_drop"]) for r in rules.with_rules(df.where(matches(F.col("t"), p.brand())), "t", p).collect()]
    assert got == sorted(want, key=str) and len(got) > 300
    # Brands and rules that are words: no pattern is tried, even one that would fail.
    words = {"b": BrandProfile("k", "", ["ks"], ["si"], ["ik"])}
    monkeypatch.setattr(catalogue, "java", lambda pattern, ignore_case=False: "(")
    told = catalogue.mentioned_brands(spark.createDataFrame([("a k: si",), ("ks",), ("kso",)], "t string"), "t", words)
    assert sorted(told.select("t", "rule_code").collect(), key=str) == [("a k: si", "hiring"), ("ks", None)]


def test_rules_by_a_column(spark):
    profiles, df = brands(12), texts(spark, 60)
    named = df.withColumn("b", F.format_string("b%04d", F.col("i") % 14))
    got = {r["i"]: (r["rule_code"], r["pattern"]) for r in catalogue.by_named_brand(named, "t", "b", profiles).collect()}
    for k in range(14):
        part = named.where(F.col("b") == f"b{k:04}")
        want = {r["i"]: (r["rule_code"], r["pattern"]) for r in rules.with_rules(part, "t", profiles[f"b{k:04}"]).collect()} if k < 12 else {r["i"]: (None, None) for r in part.collect()}
        assert {i: got[i] for i in want} == want
    assert len(got) == 62


def test_a_thousand_brands_in_one_job(spark):
    profiles, df = brands(1000), texts(spark, 2000).cache()
    df.count()
    began = time.perf_counter()
    n = catalogue.mentioned_brands(df, "t", profiles).groupBy("brand").count().count()
    assert n > 300 and time.perf_counter() - began < 60
    some = dict(sorted(profiles.items())[:5])
    for name, p in some.items():
        assert catalogue.mentioned_brands(df, "t", profiles).where(F.col("brand") == name).count() == df.where(matches(F.col("t"), p.brand())).count()


def test_k_means_equals_a_plain_one(spark):
    rng = np.random.default_rng(12)
    rows = [(i % 2, (rng.normal(size=3) + 4 * rng.integers(0, 3, 3)).tolist()) for i in range(80)] + [(2, [1.0, 1.0, 1.0])] * 3
    got = prototypes.k_means(spark.createDataFrame(rows, "class_id int, x array<double>"), 3)
    want = []
    for c in range(3):
        x = np.array(sorted(v for k, v in rows if k == c))
        seeds = [x[0]]
        while len(seeds) < 3:
            d = np.min([((x - s) ** 2).sum(1) for s in seeds], 0)
            if d.max() == 0:
                break
            seeds.append(x[int(d.argmax())])
        centres = np.array(seeds)
        for _ in range(20):
            own = np.argmin([((x - s) ** 2).sum(1) for s in centres], 0)
            centres = np.array([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
        want += [(c, m) for m in centres]
    assert [c for c, _ in got] == [c for c, _ in want] == [0] * 3 + [1] * 3 + [2]
    assert np.allclose([m for _, m in got], [m for _, m in want], atol=1e-9)
    assert prototypes.k_means(spark.createDataFrame([], "class_id int, x array<double>"), 3) == []
