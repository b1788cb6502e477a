"""Hand-made cases of cleaning, gating, spans and labels."""

import random
import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from opinarium.functions import answers, labels, prompts, spans, text, vectors, words
from opinarium.functions.regexes import compiles, java, literal, ustrip

BRAND = words.DEFAULT_BRAND[0]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (lambda c: text.prepare_comment(c, 5), {"  abcdefg ": "abcde", None: "", "": "", " 😀б😀бц": "😀б😀бц"}),
        (lambda c: text.prepare_comment(c, 0), {" a" * 900: ("a" + " a" * 899)}),
        (text.basic_clean, {"[club1|Имя] привет": "Имя привет", "#скидки @user https://a.b/c ок": "скидки ок", "<b>да</b>, (нет)": "да нет", "a\r\n\n b": "a\nb", "&lt;b&gt;x": "x", None: "", "a&nbsp;b &hearts;": "a b ♥"}),
        (text.squash_repeats, {"дааааа 10000": "дааа 1000", "aaa": "aaa", "": ""}),
        (text.drop_lines_without_letters, {"😀😀\n123\nда": "да", "": ""}),
        (text.script_gate, {"only latin": None, "latin и": "latin и"}),
        (text.tokens, {"Кофе-брейк №5!": ["кофе", "брейк", "5"]}),
        (lambda c: text.is_meaningful(c, BRAND), {"и в на": False, "подпишись друг": False, "": False, None: False, "ок": False, "brand": True, "хорошая покупка сегодня": True}),
        (lambda c: text.strip_noise(c, BRAND), {"подпишись brand": "подпишись brand", "подпишись\nда": "да"}),
        (spans.sentences, {"Раз. Два! Три": ["Раз.", "Два!", "Три"], "а\n\nб": ["а", "б"]}),
        (lambda c: spans.relevant_span(c, BRAND, 10), {"да, нет! ": "да, нет!"}),
        (text.norm_label, {"« Ёлка—Тест! »": "елка тест", None: ""}),
        (lambda c: labels.exact_or_prefix(c, ["Доставка"]), {"достав": "Доставка", "дост": "Доставка", "дос": None, "": None}),
        (lambda c: labels.exact_or_prefix(c, ["Ассорт", "Ассортимент"]), {"Ассортимент": "Ассортимент", "ассортимент": "Ассорт"}),
        (answers.json_span, {'ok {"results": []} end': '{"results": []}', "none": None}),
        (lambda c: answers.results(c, answers.RELEVANCE).isNull(), {"{bad": True, 'x {"results": [{"global_idx": 1, "action": "drop"}]}': False}),
        (lambda c: labels.parse_label(c, "string"), {" Позитив ": 2, "-1": 0, "0.0": 1, "1.0": None, "+1": 2, None: None}),
        (lambda c: labels.badge(c)["colour"], {" Positive": "green", "NEGATIVE": "red", None: "gray", "?": "gray"}),
        (ustrip, {" \x1c a b 　": "a b"}),
        (lambda c: text.clipped(c, 3), {"ab\ncd": "ab ...", "abc": "abc"}),
    ],
)
def test_goldens(spark, f, cases):
    assert column(spark, list(cases), f) == list(cases.values())


def test_integer_labels(spark):
    assert column(spark, [0, 1, 2, -1, 3, None], lambda c: labels.parse_label(c, "int"), "int") == [0, 1, 2, None, None, None]
    assert column(spark, [0.0, 1.0], lambda c: labels.parse_label(c, "double"), "double") == [1, None]


def test_regex_dialect(spark):
    assert compiles("(?i)a", spark) and not compiles("(", spark)
    assert column(spark, ["ВАКАНСИЯ", "вакансиями"], lambda c: c.rlike(java(r"\bваканси\w+\b", True))) == [True, True]
    assert column(spark, ["у бренда", "бренд тут", "бренд"], lambda c: c.rlike(java(literal("бренд"), True))) == [False, True, True]
    assert java("(?P<a>x)(?P=a)\\Z").endswith(r"(?<a>x)\k<a>\z")


def test_windows_equal_merged_intervals(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        toks = ["brand" if rng.random() < 0.03 else rng.choice("абвгде") for _ in range(rng.randint(30, 80))]
        rows.append((i, " ".join(toks), toks))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "i int, x string")
    got = {r[0]: r[1] for r in df.select("i", spans.relevant_span(F.col("x"), "brand", 25, half=4)).collect()}
    for i, _, toks in rows:
        if len(toks) <= 25 or "brand" not in toks:
            continue
        merged: list[list[int]] = []
        for c in [k for k, t in enumerate(toks) if t == "brand"]:
            a, b = max(0, c - 4), min(len(toks), c + 5)
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        kept = [t for a, b in merged for t in toks[a:b]]
        assert got[i] == " ".join(kept[-25:])


def plain_centres(t, pattern):
    """By tokenising each prefix."""
    return sorted({max(0, len(re.findall(text.TOKEN, t[: m.start() + 1])) - 1) for m in re.finditer(pattern, t, re.IGNORECASE)})


def test_places_between_tokens(spark):
    assert column(spark, ["аб, вг!"], lambda c: spans.centres(c, "[бг]")) == [[0, 1]]
    rng = random.Random(5)
    texts = ["".join(rng.choice("аб1 ,-!\n\ufdd0€B") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "-", "-б", "б-", ",-,", "а" * 50]
    for pattern in ("б", "-", "[-,]", "-+б", r"\bа", "аб|,", "€", ".", r"(?<!а)б(?=б)"):
        assert column(spark, texts, lambda c: spans.centres(c, pattern)) == [plain_centres(t.replace("\ufdd0", " "), pattern) for t in texts], pattern


@pytest.mark.parametrize("mention, between", [("brand", " слово"), ("brand", ""), ("-", "а-"), ("brand", " одно два три четыре пять" * 50)])
def test_spans_of_many_mentions_take_linear_time(spark, mention, between):
    """8,000 mentions, also within one token; the time hardly differs from that of 1,000."""
    df = spark.createDataFrame([(n, f"начало {mention}{between}" * n) for n in (8000 if len(between) < 50 else 800,)], "n int, x string").cache()
    df.count()
    out = df.select(spans.relevant_span(F.col("x"), mention, 25))
    out.collect()
    began = time.perf_counter()
    out.collect()
    assert time.perf_counter() - began < 2


def test_long_vectors_are_normalised_in_linear_time(spark):
    df = spark.range(2000).select(F.transform(F.sequence(F.lit(1), F.lit(1536)), lambda x: (x + F.col("id")) % 7).alias("v")).cache()
    df.count()
    out = df.select(F.element_at(vectors.l2_normalize(F.col("v")), 1).alias("first"))
    out.collect()
    began = time.perf_counter()
    got = out.collect()
    assert time.perf_counter() - began < 2 and abs(got[0][0] - 1 / sum(((x) % 7) ** 2 for x in range(1, 1537)) ** 0.5) < 1e-12


def test_sentences_without_brand_keep_the_tail(spark):
    t = "один два три четыре. пять шесть семь. и в на. восемь девять. десять. одиннадцать."
    # By content words, then by the sentence: the best one is cut first.
    assert column(spark, [t], lambda c: spans.by_sentences(c, "zzz", 6)) == ["одиннадцать один два три четыре десять"]
    assert column(spark, ["а. бренд. в. г."], lambda c: spans.by_sentences(c, "бренд", 6)) == ["а бренд в"]


def test_fixed_window(spark):
    w = lambda c, n: spans.fixed_window(F.lit(c), F.lit(n), 10)
    rows = spark.range(1).select(w(0, 5), w(2, 30), w(15, 30), w(29, 30)).first()
    assert [tuple(r) for r in rows] == [(0, 5), (0, 10), (10, 20), (20, 30)]


def test_prompts(spark):
    df = spark.createDataFrame([([(0, "а"), (1, "б")],)], "items array<struct<idx: int, txt: string>>")
    got = df.select(prompts.line_prompt(F.col("items"))).first()[0].split("\n")
    assert got[2:4] == ["0: а", "1: б"] and got[-1].startswith("Верни JSON")
    assert df.select(prompts.line_prompt(F.col("items"), prompts.SENTIMENT_HEAD, None)).first()[0].endswith("\n1: б")
    item = df.select(prompts.category_item(F.lit(7), F.lit(" x\ny "), F.array().cast("array<struct<text: string, category: string>>"))).first()[0]
    assert item == '[ITEM 7]\nТекст:\n"""x y"""\nПохожие примеры из предразметки:\n(нет примеров)\n'
    whole = df.select(prompts.category_prompt(" Раздели ", F.array(F.lit("A"), F.lit("B")), ["к1"])).first()[0]
    assert whole.startswith("Раздели\n\nРазрешённые категории (выбирай строго из списка):\n- к1\n\nИНСТРУКЦИЯ") and whole.endswith("ITEM'ы:\nA\nB")


def test_fuzzy_labels(spark):
    df = spark.createDataFrame([(0, "Доставкка"), (1, "совсем иное"), (2, None), (3, "Цены")], "i int, raw string")
    got = {r["i"]: r["cat"] for r in labels.best_allowed(df, "raw", ["Доставка", "Цены и скидки"], "cat").collect()}
    assert got == {0: "Доставка", 1: None, 2: None, 3: "Цены и скидки"}


def test_fuzzy_query_equals_brute_force(spark, sf):
    """The best allowed category of all part names: prefixes in list order, else the best ratio."""
    from opinarium.plans import catalog

    allowed = ["red widgets", "blue bold", "small rings", "green gear"]
    plain = lambda s: " ".join(re.sub(r"[^0-9a-zа-я\s]+", " ", s.lower().replace("ё", "е").strip("\"'«»`*_•-— ")).split())

    def best(raw):
        name = plain(raw)
        if raw.strip() in allowed or not name:
            return raw.strip() if name else None
        for c in allowed:
            if (len(name) >= 4 and plain(c).startswith(name)) or (len(plain(c)) >= 4 and name.startswith(plain(c))):
                return c
        ratios = [SequenceMatcher(None, name, plain(c)).ratio() for c in allowed]
        return allowed[ratios.index(max(ratios))] if max(ratios) >= 0.6 else None

    got = {r["p_partkey"]: (r["p_name"], r["category"]) for r in catalog.QUERIES["label_map_fuzzy"](spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/part.parquet").count()
    assert {k: c for k, (_, c) in got.items()} == {k: best(n) for k, (n, _) in got.items()} and len({c for _, c in got.values()}) > 1
    df = spark.createDataFrame([(i, n) for i, n in enumerate(["red", "red widget", "blue bolt!", "gear", "Smal ring", "", None, "green gear box", " red widgets "])], "i int, raw string")
    assert {r["i"]: r["cat"] for r in labels.best_allowed(df, "raw", allowed, "cat").collect()} == {r["i"]: best(r["raw"] or "") for r in df.collect()}
