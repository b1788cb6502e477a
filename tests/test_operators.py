"""Rules, batches, answers, prototypes, retrieval, jobs, files and streams."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinarium.functions.labels import SENTIMENTS
from opinarium.operators import backends, batching, categories, merge, metrics, prototypes, relevance, retrieval, rules, sentiment
from opinarium.plans import pipeline, train
from opinarium.plans.config import BrandProfile, CategoryConfig, PipelineConfig, SentimentConfig, load_brands, require_columns
from opinarium.sources import readers, writers
from opinarium.streaming.comments import drop_counts_by_window, ruled_stream

PROFILE = BrandProfile("Ромашка", "Магазины", ["ромашка"], ["(", "(?i)ваканси"], ["(?i)^здравствуйте"], ["(?i)рядом с"], ["(?i)ромашка полевая"])


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_rules_are_ordered_and_skip_bad_patterns(spark):
    df = spark.createDataFrame([(1, "Здравствуйте, ВАКАНСИЯ"), (2, "здравствуйте"), (3, "ромашка полевая рядом с домом"), (4, "ромашка полевая"), (5, ""), (6, "купил")], "i int, t string")
    got = {r["i"]: (r["rule_code"], r["is_drop"]) for r in rules.with_rules(df, "t", PROFILE).collect()}
    assert got == {1: ("hiring", "Yes"), 2: ("pr_reply", "Yes"), 3: ("near_brand", "Yes"), 4: ("homonym_noise", "Yes"), 5: (None, "No"), 6: (None, "No")}
    assert rules.with_rules(df, "t", BrandProfile("x")).where("is_drop = 'Yes'").isEmpty()


def test_profiles(tmp_path):
    assert BrandProfile.of({"sure_drop_patterns": ["a"]}, "B").brand_sure_drop == ["a"]
    assert BrandProfile.of({"homonym_noise": None, "aliases": None}).homonym_noise == []
    assert BrandProfile.from_form("A ", aliases=" x, ,y ", drops="p\n\n q ").aliases == ["x", "y"]
    assert BrandProfile("", aliases=[]).brand_name == "BRAND"
    with pytest.raises(ValueError):
        BrandProfile("a").brand_patterns("(")
    assert BrandProfile("a").system_prompt().count("—") >= 2
    assert BrandProfile.with_common_rules("Ромашка", ["цветок"]).sure_drop_patterns[9].endswith(r"(ромашка|цветок)\b")
    pytest.importorskip("yaml")
    path = tmp_path / "brands.yaml"
    path.write_text("A:\n  aliases: [x]\nB: 3\n", encoding="utf-8")
    assert list(load_brands(str(path))) == ["A"] and load_brands(str(tmp_path / "none")) == {}
    with pytest.raises(ValueError):
        PipelineConfig(batch_size=51)


def test_row_ids_and_batches(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("x", F.col("id") * 3)
    ids = batching.with_row_id(df)
    assert sorted(rows(ids, "row_id", "id")) == [(i, i) for i in range(1000)]
    batches = batching.numbered_batches(spark.range(7), "id", 3)
    assert sorted(rows(batches.groupBy("batch_id").count(), "batch_id", "count")) == [(0, 3), (1, 3), (2, 1)]
    assert batching.with_row_id(df.where("id < 0")).count() == 0


def test_answers(spark):
    asked = spark.createDataFrame([(0, True), (1, True), (2, True), (3, False)], "row_id long, asked boolean")
    told = spark.createDataFrame([(0, 0, "keep"), (0, 1, "drop"), (9, 0, "drop"), (3, 0, "keep")], "row_id long, pos int, action string")
    assert sorted(rows(merge.merge_actions(asked, told), "row_id", "action")) == [(0, "drop"), (1, "keep"), (2, "keep"), (3, "drop")]
    labelled = told.select("row_id", "pos", F.lit("x").alias("label"))
    assert dict(rows(merge.merge_labels(asked, labelled, "label"), "row_id", "label"))[1] is None
    with pytest.raises(Exception, match="no answer"):
        merge.merge_labels(asked, labelled, "label", strict=True).collect()


def test_relevance_with_a_misbehaving_backend(spark):
    class Stray:
        """Answers twice, for other batches' rows, and not at all for odd rows."""

        def classify(self, items):
            return [(i, "keep") for i, _ in items] + [(i, "drop") for i, _ in items if i % 2 == 0] + [(i + 1000, "drop") for i, _ in items] + [(-1, "drop")]

    df = spark.createDataFrame([(i, "вакансия" if i == 4 else "купил хорошую вещь") for i in range(20)], "row_id long, `Текст` string").repartition(3)
    got = dict(rows(relevance.classify(df, "row_id", PROFILE, Stray(), PipelineConfig(batch_size=4)), "row_id", "action"))
    assert got == {i: "drop" if i % 2 == 0 else "keep" for i in range(20)}
    assert relevance.classify(df.where("row_id < 0"), "row_id", PROFILE, Stray()).count() == 0
    one = relevance.classify_one(spark, "Вакансия", PROFILE, backends.KeepAll())
    assert one == {"action": "drop", "source": "rule", "rule_code": "hiring", "pattern": "(?i)ваканси"}


def test_retries():
    calls = []

    def fails():
        calls.append(1)
        raise ConnectionError

    with pytest.raises(RuntimeError):
        backends.with_retries(fails, (ConnectionError,), 2)
    assert len(calls) == 2
    with pytest.raises(ZeroDivisionError):
        backends.with_retries(lambda: 1 / 0, (ConnectionError,))


def test_prototypes(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    protos = prototypes.fit(df, "embedding", "label", SentimentConfig(k_per_class=3))
    got = protos.collect()
    assert all(sum(r["class_id"] == c for r in got) == min(3, df.where(F.col("label") == c).count()) for c in range(3))
    assert all(math.isclose(np.linalg.norm(r["centroid"]), 1, abs_tol=1e-9) for r in got)
    assert [r["centroid"] for r in prototypes.fit(df, "embedding", "label", SentimentConfig(k_per_class=3)).collect()] == [r["centroid"] for r in got]
    out = prototypes.predict(df, "embedding", protos).collect()
    for r in out[:40]:
        x = np.array(r["embedding"], float)
        x /= np.linalg.norm(x)
        scores = [max(float(x @ p["centroid"]) for p in got if p["class_id"] == c) for c in range(3)]
        assert np.allclose(scores, [r["s_negative"], r["s_neutral"], r["s_positive"]], atol=1e-9) and r["pred"] == int(np.argmax(scores))
    config = SentimentConfig(k_per_class=3, thresholds={0: 0.1, 1: 0.2, 2: 0.3})
    prototypes.save(protos, config, str(tmp_path / "m"), max_words=9)
    again, kept, meta = prototypes.load(spark, str(tmp_path / "m"))
    assert again.count() == len(got) and kept.thresholds == config.thresholds and meta["max_words"] == 9
    with pytest.raises(ValueError):
        prototypes.save(protos.where("proto_id < 0"), config, str(tmp_path / "n"))
    np.savez(tmp_path / "p.npz", C=np.eye(2, dtype="f4"), proto2class=np.array([0, 2]))
    assert prototypes.import_npz(spark, str(tmp_path / "p.npz")).count() == 2


def test_ties_thresholds_and_absent_classes(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "i int, v array<double>")
    protos = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 2, [1.0, 0.0])], "proto_id int, class_id int, centroid array<double>")
    out = prototypes.with_labels(prototypes.apply_thresholds(prototypes.predict(df, "v", protos), SentimentConfig().thresholds)).orderBy("i").collect()
    assert [(r["pred"], r["pred4"], r["pred_label"], r["pred_source"], r["s_neutral"]) for r in out] == [(0, 0, "negative", "prototype", -1e9), (0, 3, "negative", "llm", -1e9)]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist(), f"c{i % 3}") for i, v in enumerate(x)], "i long, v array<double>, c string")
    index = retrieval.build_index(df.where("i >= 40"), "i", "c", "c", "v")
    got = {}
    for r in retrieval.top_k(df.where("i < 40"), index, "i", "v", 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["ref_id"]))
    unit = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    for q in range(40):
        sims = np.round(unit[40:] @ unit[q], 9)
        near = sorted(range(len(sims)), key=lambda k: (-sims[k], k))[:4]
        found = [ref - 40 for _, ref in sorted(got[q])]
        assert [sims[k] for k in found] == [sims[k] for k in near]
    assert retrieval.top_k(df.where("i < 0"), index, "i", "v").count() == 0
    assert len(got) == 40
    for cells in (None, 1, 7, 300):
        made = retrieval.build_cells(index, cells)
        told = {(r["query_id"], r["rank"]): (r["ref_id"], r["sim"]) for r in retrieval.top_k_in_cells(df.where("i < 40"), made, "i", "v", 4).collect()}
        assert len(told) == 160 == len({(q, ref) for (q, _), (ref, _) in told.items()})
        for (q, rank), (ref, sim) in told.items():
            sims = unit[40:] @ unit[q]
            assert abs(sims[ref - 40] - sim) < 1e-9 and abs(np.sort(sims)[-rank] - sim) < 1e-9
    assert retrieval.top_k_in_cells(df.where("i < 0"), retrieval.build_cells(index), "i", "v").count() == 0
    assert retrieval.top_k_in_cells(df.where("i < 40"), retrieval.build_cells(index.limit(0)), "i", "v").count() == 0


def test_cells_save_products_and_split_copies(spark, monkeypatch):
    """On clustered vectors under a tenth of all products; a third of the references are copies of one."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24))
    x = np.concatenate([centres[rng.integers(0, 60, 4000)] + 0.05 * rng.normal(size=(4000, 24)), np.repeat(centres[:1], 2000, 0)])
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)], "i long, v array<double>, c string")
    asked, index = df.where("i % 50 = 0"), retrieval.build_index(df, "i", "c", "c", "v")
    monkeypatch.setattr(retrieval, "BLOCK", 300)
    cells = retrieval.build_cells(index)
    assert cells.shells.size.max() <= 300 and cells.rows.count() == 6000 and cells.rows.groupBy("block").count().agg(F.max("count")).first()[0] < 450
    pairs = [v.groupBy("block").count().collect() for v in retrieval.visits(asked, cells, "i", "v", 5)]
    products = sum(r["count"] * int(cells.shells.size[r["block"]]) for found in pairs for r in found)
    ordinary = asked.where("i < 4000").where("v[0] <> " + repr(float(centres[0][0])))
    few = sum(r["count"] * int(cells.shells.size[r["block"]]) for v in retrieval.visits(ordinary, cells, "i", "v", 5) for r in v.groupBy("block").count().collect())
    assert few < 0.1 * ordinary.count() * 6000 and products < 0.4 * asked.count() * 6000
    key = lambda d: sorted((r["query_id"], r["rank"], round(r["sim"], 9)) for r in d.collect())
    assert key(retrieval.top_k_in_cells(asked, cells, "i", "v", 5)) == key(retrieval.top_k(asked, index, "i", "v", 5))


def test_jobs(spark, tmp_path):
    df = spark.createDataFrame([("вакансия",), ("очень хорошо купил",), ("плохо плохо сервис",), (None,)], "`Текст` string")
    labelled = spark.createDataFrame([("хорошо купил", "positive"), ("плохо сервис", "negative"), ("нормально обычно", "0.0"), ("?", "what")], "t string, label string")
    embedder = backends.HashingEmbedder(64)
    protos, stats = train.train(labelled, "t", "label", embedder, SentimentConfig(k_per_class=1))
    assert stats["rows_used"] == 3 and stats["classes"] == {0: 1, 1: 1, 2: 1} and stats["accuracy"] == 1
    counts = metrics.Counts()
    out = pipeline.comment_job(df, PROFILE, backends.KeepAll(), protos, embedder, counts=counts).cache()
    got = {r["Текст"]: (r["is_drop"], r["sentiment"], r["sentiment_source"]) for r in out.collect()}
    assert got["вакансия"] == ("Yes", None, "skip_drop") and got["очень хорошо купил"][1] == "positive" and got["плохо плохо сервис"][1] == "negative" and len(got) == 4
    stats = pipeline.comment_stats(counts, 2.0)
    assert stats == {"rows": 4, "drops": 1, "keeps": 3, "rule_drops": 1, "llm_calls": 1, "positive": stats["positive"], "negative": stats["negative"], "neutral": stats["neutral"], "total_s": 2.0, "comments_per_s": 2.0}
    assert stats["positive"] + stats["negative"] + stats["neutral"] == 3
    assert pipeline.comment_job(df.where("1 = 0"), PROFILE, prototypes=protos, embedder=embedder).count() == 0
    assert "sentiment" not in pipeline.comment_job(df, PROFILE).columns
    one = pipeline.one_comment(spark, "хорошо купил", PROFILE, None, protos, embedder)
    assert one["relevance"]["action"] == "keep" and one["sentiment"]["label"] == "positive" and set(one["sentiment"]["scores"]) == set(SENTIMENTS)
    refs = spark.createDataFrame([("доставка быстро курьер", "Доставка"), ("цена скидка", "Цена"), ("цена дорого", "Цена")], "`Текст` string, `Категория` string")
    more = out.select("Текст", "is_drop").union(spark.createDataFrame([("дорого цена", "No")], "a string, b string"))
    told = {r["Текст"]: (r[categories.PRED], r[categories.SOURCE]) for r in pipeline.category_job(more, "Раздели", PROFILE, None, refs, embedder, CategoryConfig(top_k=2)).collect()}
    assert told["дорого цена"] == ("Цена", "rag_llm") and told["вакансия"] == (None, "skip_drop") and told[None] == (None, "skip_empty")
    fixed = pipeline.category_job(more, "Раздели", PROFILE, backends.FirstToken(["A"]))
    assert {r[0] for r in rows(fixed.where(f"`{categories.SOURCE}` = 'llm'"), categories.PRED)} == {"A"}
    with pytest.raises(ValueError):
        pipeline.category_job(df, " ", PROFILE, backends.KeepAll())
    with pytest.raises(ValueError, match="missing"):
        require_columns(df, "нет")


def test_sentiment_fallback_is_strict(spark):
    df = spark.createDataFrame([(0, "х"), (1, "у")], "row_id long, t string")
    protos = spark.createDataFrame([(0, 0, [1.0] + [0.0] * 63)], "proto_id int, class_id int, centroid array<double>")
    out = sentiment.predict_texts(df, "row_id", "t", protos, backends.HashingEmbedder(64), PROFILE, fallback=backends.FirstToken(["positive"]))
    assert {r["pred_label"] for r in out.where("pred_source = 'llm'").collect()} == {"positive"}
    with pytest.raises(Exception, match="no answer"):
        sentiment.predict_texts(df, "row_id", "t", protos, backends.HashingEmbedder(64), PROFILE, fallback=backends.FirstToken(["?"])).collect()


def test_files(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("\ufeffТекст;n\n\"а\nб \"\"в\"\"\";1\nг;2\n".encode())
    df = readers.read_table(spark, str(path), "Текст")
    assert rows(df, "Текст", "n") == [('а\nб "в"', "1"), ("г", "2")]
    with pytest.raises(ValueError, match="missing"):
        readers.read_table(spark, str(path), "нет")
    writers.write_csv(df, str(tmp_path / "out.csv"))
    assert sorted(rows(readers.read_table(spark, str(tmp_path / "out.csv")), "Текст")) == sorted(rows(df, "Текст"))
    data, kind = writers.download_bytes(df)
    assert data.startswith(b"\xef\xbb\xbf") and kind == "text/csv"
    assert writers.export_name("a/b.xlsx") == ("filtered_b.xlsx", "xlsx") and writers.export_name("b.csv") == ("filtered_b.csv", "csv") and writers.export_name("b.csv", "categories")[1] == "xlsx"
    assert readers.separator("a\nb") == "," and readers.separator("a;b\n1;2\n") == ";"


def test_stats(spark):
    df = spark.createDataFrame([("Yes", "positive", "hiring"), (" no", None, None), (None, "negative", None)], "is_drop string, sentiment string, rule_code string")
    assert tuple(metrics.drop_counts(df).first()) == (3, 1, 2)
    assert tuple(metrics.job_stats(df, 2.0).first())[:4] == (3, 1, 1, 2.0)
    empty = spark.createDataFrame([], "a int, b int, p boolean")
    assert tuple(metrics.accuracy_coverage(empty, "a", "b", "p").first()) == (0.0, 0.0)


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), "вакансия" if m % 2 else "купил") for m in range(6)], "ts timestamp, t string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = drop_counts_by_window(ruled_stream(stream, "t", PROFILE), "ts").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(rows(spark.table("counts"), "rows", "drops")) == [(1, 1), (5, 2)]


def test_train_command(spark, tmp_path, capsys):
    (tmp_path / "l.csv").write_text("text,label\nхорошо купил,pos\nплохо сервис,neg\nобычно вещь,neu\n", encoding="utf-8")
    train.main(["--data", str(tmp_path / "l.csv"), "--text-col", "text", "--label-col", "label", "--out", str(tmp_path / "m"), "--k", "1"])
    assert "'rows_used': 3" in capsys.readouterr().out
    assert prototypes.load(spark, str(tmp_path / "m"))[2]["embedding"]["provider"] == "hashing"
