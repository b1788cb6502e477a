"""Language models: prompts that reach them, answers that come back, keys, hooks and the index cache."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from opinarium.functions import prompts
from opinarium.operators import backends, categories, models, prototypes, relevance, retrieval, sentiment
from opinarium.plans import pipeline
from opinarium.plans.config import BrandProfile, CategoryConfig, PipelineConfig, SentimentConfig

PROFILE = BrandProfile("Ромашка", "Магазины", ["ромашка"], ["(?i)ваканси"])


def recorder(answer=None):
    class Recorder:
        """Answers with what it was asked, and with rows that weren't."""

        def ask(self, system, prompt):
            ids = [int(x.split(":")[0].strip("[ITEM ]")) for x in prompt.split("\n") if x[:1].isdigit() or x.startswith("[ITEM ")]
            told = [{"global_idx": i, "action": f"{system}|{prompt}", "category": f"{system}|{prompt}", "label": "positive"} for i in ids] if answer is None else answer
            return "так: " + json.dumps({"results": [*told, {"global_idx": 10**12, "action": "drop"}, {"action": "drop"}]}) + " вот"

    return Recorder()


def test_relevance_prompts_reach_the_model(spark):
    df = spark.createDataFrame([(5_000_000_000 + i, f"текст {i}") for i in range(5)], "row_id long, txt string").repartition(3)
    told = {r["row_id"]: r for r in models.answers(df, "row_id", "txt", "S", prompts.line_prompt, recorder(), "results array<struct<global_idx: long, action: string>>", "action", 2, 2).collect()}
    assert sorted(told) == [5_000_000_000 + i for i in range(5)]
    assert told[5_000_000_002]["answer"] == "S|" + "\n".join([*prompts.RELEVANCE_HEAD, "5000000002: текст 2", "5000000003: текст 3", prompts.RELEVANCE_TAIL])
    assert told[5_000_000_004]["latency_s"] >= 0
    assert models.answers(df.where("row_id < 0"), "row_id", "txt", "S", prompts.line_prompt, recorder(), "results array<struct<global_idx: long, action: string>>", "action", 2, 2).count() == 0


def test_relevance_job_by_a_model(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["вакансия", "хорошая покупка вчера", "плохая погода сегодня", None])], "row_id long, `Текст` string")
    got = {r["row_id"]: (r["action"], r["asked"]) for r in relevance.classify(df, "row_id", PROFILE, models.PatternModel(["покупк"]), PipelineConfig(batch_size=2)).collect()}
    assert got == {0: ("drop", False), 1: ("keep", True), 2: ("drop", True), 3: ("drop", True)}
    # What isn't JSON, or has other actions, leaves rows kept.
    assert {r["action"] for r in relevance.classify(df, "row_id", PROFILE, recorder([])).where("asked").collect()} == {"keep"}
    upper = relevance.classify(df, "row_id", PROFILE, models.PatternModel(["ПОКУПКА ВЧЕРА$"]), preprocess=F.upper)
    assert {r["row_id"] for r in upper.where("asked and action = 'keep'").collect()} == {1}


def test_category_prompt_reaches_the_model(spark):
    refs = spark.createDataFrame([(0, "быстрая доставка курьером", "Доставка"), (1, "высокая цена товара", "Цена")], "i long, `Текст` string, `Категория` string")
    df = spark.createDataFrame([(0, "доставка пришла быстро", "No"), (1, "доставка", "Yes"), (2, " ", None)], "row_id long, `Текст` string, is_drop string")
    embedder = backends.HashingEmbedder(64)
    index = categories.index_texts(refs, "i", PROFILE, embedder)
    rows = {r["row_id"]: (r[categories.PRED], r[categories.SOURCE]) for r in categories.tag(df, "row_id", "Раздели", PROFILE, recorder(), index, embedder, CategoryConfig(top_k=1)).collect()}
    system, prompt = rows[0][0].split("|", 1)
    assert system == prompts.CATEGORY_SYSTEM and prompt.startswith("Раздели\n\n" + prompts.ALLOWED_HEAD + "- Доставка\n- Цена\n\nИНСТРУКЦИЯ:")
    assert prompt.endswith('[ITEM 0]\nТекст:\n"""доставка пришла быстро"""\n' + prompts.EXAMPLES_HEAD + "[пример 1] Категория: Доставка | Текст: быстрая доставка курьером")
    assert rows[1] == (None, "skip_drop") and rows[2] == (None, "skip_empty")
    first = categories.tag(df, "row_id", "Раздели", PROFILE, models.FirstExample(), index, embedder, CategoryConfig(top_k=1))
    assert first.where("row_id = 0").first()[categories.PRED] == "Доставка"
    alone = categories.tag(df, "row_id", "Раздели", PROFILE, recorder([{"global_idx": 0, "category": " Своя "}]))
    assert alone.where("row_id = 0").first()[categories.PRED] == "Своя"


def test_sentiment_model_is_asked_for_what_is_unsure(spark):
    df = spark.createDataFrame([(0, "х"), (1, "у")], "row_id long, t string")
    protos = spark.createDataFrame([(0, 0, [1.0] + [0.0] * 63)], "proto_id int, class_id int, centroid array<double>")
    out = sentiment.predict_texts(df, "row_id", "t", protos, backends.HashingEmbedder(64), PROFILE, fallback=recorder(), preprocess=F.upper)
    assert {(r["text"], r["pred_label"]) for r in out.where("pred_source = 'llm'").collect()} == {("Х", "positive"), ("У", "positive")}
    one = sentiment.predict_one(spark, " ?? ", protos, backends.HashingEmbedder(64), PROFILE)
    assert one["label"] == "negative" and set(one["scores"]) == {"negative", "neutral", "positive"}


def test_chat_model():
    made, calls = [], []

    def call(client, system, prompt, temperature):
        calls.append((client, system, prompt, temperature))
        if len(calls) < 3:
            raise TimeoutError
        return "a"

    model = models.ChatModel("test", lambda: made.append(1) or "client", call, 0.5, attempts=3)
    assert model.ask("s", "p") == "a" and model.ask("s", "q") == "a"
    assert made == [1] and calls[-1] == ("client", "s", "q", 0.5) and len(calls) == 4
    with pytest.raises(RuntimeError):
        models.ChatModel("never", object, lambda *_: (_ for _ in ()).throw(TimeoutError()), attempts=1).ask("s", "p")


def test_keys_and_readiness(tmp_path, monkeypatch, spark):
    monkeypatch.delenv("SOME_KEY", raising=False)
    secrets = tmp_path / "secrets.toml"
    secrets.write_text('SOME_KEY = " k "\n')
    assert models.api_key("SOME_KEY") is None and models.api_key("SOME_KEY", str(secrets)) == "k"
    model = models.ChatModel("m", object, lambda *_: "", key="SOME_KEY")
    with pytest.raises(RuntimeError, match="SOME_KEY"):
        models.require_ready(None, backends.KeepAll(), model)
    with pytest.raises(RuntimeError, match="SOME_KEY"):
        relevance.classify(spark.createDataFrame([(0, "т")], "row_id long, `Текст` string"), "row_id", PROFILE, model)
    with pytest.raises(SystemExit):
        models.api_key("SOME_KEY", str(tmp_path / "none"), required=True)
    monkeypatch.setenv("SOME_KEY", "e")
    assert models.api_key("SOME_KEY", str(secrets)) == "e"
    models.require_ready(model)


def test_workers_ask_at_once(spark):
    class Slow:
        def ask(self, system, prompt):
            time.sleep(0.3)
            return threading.current_thread().name

    df = spark.createDataFrame([(i,) for i in range(4)], "i long").coalesce(1)
    assert models.told(df, "", F.lit("p"), Slow(), 2).select("told").distinct().count() == 2


def test_index_is_kept_row_by_row(spark, tmp_path):
    """The embedder sees only texts that the store lacks: each once, whatever changes around it."""
    seen = tmp_path / "seen"

    class Noting(backends.HashingEmbedder):
        def embed(self, texts):
            with open(seen, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return super().embed(texts)

    schema = "i long, `Текст` string, `Категория` string"
    refs = spark.createDataFrame([(0, "быстрая доставка", "A"), (1, "цена товара", "B"), (2, "цена товара", "A"), (3, None, "A")], schema)
    folder, config = str(tmp_path / "c"), CategoryConfig()
    embedder = Noting(8)
    fresh = lambda refs, embedder=embedder, profile=PROFILE: (seen.unlink(missing_ok=True), categories.cached_index(refs, "i", profile, embedder, config, folder).count(), sorted(seen.read_text().splitlines()) if seen.exists() else [])[1:]
    assert fresh(refs) == (4, ["", "быстрая доставка", "цена товара"])
    assert fresh(refs.orderBy(F.desc("i"))) == (4, [])
    changed = refs.where("i <> 1").union(spark.createDataFrame([(1, "новый текст", "B"), (4, "быстрая доставка", "C")], schema))
    assert fresh(changed) == (5, ["новый текст"])
    assert fresh(refs.where("i = 0"), profile=BrandProfile("B")) == (1, [])
    assert fresh(refs.where("i = 0"), Noting(9)) == (1, ["быстрая доставка"])
    assert fresh(refs.where("i < 0")) == (0, [])
    plain = {r["ref_id"]: r["vector"] for r in categories.index_texts(refs, "i", PROFILE, embedder, config).collect()}
    assert {r["ref_id"]: r["vector"] for r in categories.cached_index(refs, "i", PROFILE, embedder, config, folder).collect()} == plain
    df = spark.createDataFrame([("цена",)], "`Текст` string")
    told = pipeline.category_job(df, "Раздели", PROFILE, None, refs, embedder, config, cache=folder).first()
    assert told[categories.PRED] in ("A", "B")


def test_prototypes_of_any_number(spark, sf, monkeypatch):
    """Literals, a broadcast and blocks give equal scores; absent classes and null vectors are alike."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet").unionByName(spark.createDataFrame([(-1, None, 1)], "vec_id long, embedding array<float>, label int"))
    protos = prototypes.fit(df.where("label <> 1"), "embedding", "label", SentimentConfig(k_per_class=3))
    columns = ["vec_id", *(F.round(c, 9).alias(c) for c in ("s_negative", "s_neutral", "s_positive", "sim")), "pred"]
    found = []
    for literals, broadcast in ((1 << 20, 1 << 20), (1, 1 << 20), (1, 1)):
        monkeypatch.setattr(prototypes, "LITERAL_COMPONENTS", literals)
        monkeypatch.setattr(prototypes, "BROADCAST_COMPONENTS", broadcast)
        found.append(sorted(map(tuple, prototypes.predict(df.where("vec_id >= 0"), "embedding", protos).select(columns).collect())))
        assert prototypes.predict(df, "embedding", protos).count() == df.count()
    assert found[0] == found[1] == found[2]


def test_plain_top_k_is_by_dot_product(spark):
    df = spark.createDataFrame([(0, [3.0, 0.0]), (1, [1.0, 1.0])], "i long, v array<double>")
    refs = df.select(F.col("i").alias("ref_id"), F.col("v").alias("vector"))
    assert {r["query_id"]: (r["ref_id"], r["sim"]) for r in retrieval.top_k(df, refs, "i", "v", 1, normalize=False).collect()} == {0: (0, 9.0), 1: (0, 3.0)}
