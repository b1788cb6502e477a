"""What a job asks its models: each thing once, whatever fails or is run again."""

import json
import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from opinarium.operators import backends, metrics, models, relevance, sentiment
from opinarium.operators.answerlog import AnswerLog
from opinarium.plans import catalog, pipeline
from opinarium.plans.config import BrandProfile, PipelineConfig, SentimentConfig

# Workers can't import this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROFILE = BrandProfile("Ромашка", "Магазины", ["ромашка"], ["(?i)ваканси"])


def note(path, *lines):
    """Appended by any worker."""
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND), "w") as f:
        f.write("".join(f"{x}\n" for x in lines))


def noted(path):
    return path.read_text().splitlines() if path.exists() else []


def counting(path, fail_at=None):
    class Counting:
        """Notes each item it is asked for; fails for a prompt with fail_at, once."""

        name = "counting"

        def ask(self, system, prompt):
            ids = [x.split(":")[0] for x in prompt.split("\n") if x[:1].isdigit()]
            if fail_at in ids and not os.path.exists(f"{path}.failed"):
                note(f"{path}.failed", "x")
                raise RuntimeError("no answer")
            note(path, *ids)
            return json.dumps({"results": [{"global_idx": int(i), "action": "keep" if int(i) % 3 else "drop", "label": "neutral"} for i in ids]})

    return Counting()


class CountingEmbedder(backends.HashingEmbedder):
    def __init__(self, path):
        super().__init__(8)
        self.path = path

    def embed(self, texts):
        note(self.path, *range(len(texts)))
        return super().embed(texts)


def comments(spark, n=40):
    return spark.createDataFrame([(i, "вакансия" if i % 10 == 9 else f"хорошая покупка вчера номер {i}") for i in range(n)], "row_id long, `Текст` string").repartition(4)


def test_one_run_asks_each_row_once_and_has_the_counts(spark, tmp_path):
    asked, embedded, counts = str(tmp_path / "asked"), str(tmp_path / "embedded"), metrics.Counts()
    protos = spark.createDataFrame([(0, 0, [1.0] + [0.0] * 7), (1, 2, [0.0, 1.0] + [0.0] * 6)], "proto_id int, class_id int, centroid array<double>")
    out = pipeline.comment_job(comments(spark), PROFILE, counting(asked), protos, CountingEmbedder(embedded), PipelineConfig(batch_size=4), row_id="row_id", counts=counts)
    out.write.parquet(str(tmp_path / "out"))
    stats = pipeline.comment_stats(counts, 4.0)
    kept = [i for i in range(40) if i % 10 != 9 and i % 3]
    assert sorted(map(int, noted(tmp_path / "asked"))) == [i for i in range(40) if i % 10 != 9]
    assert len(noted(tmp_path / "embedded")) == len(kept)
    again = spark.read.parquet(str(tmp_path / "out"))
    assert stats["rows"] == 40 and stats["rule_drops"] == 4 and stats["llm_calls"] == 9 and stats["keeps"] == len(kept) == again.where("is_drop = 'No'").count()
    assert stats["positive"] + stats["negative"] + stats["neutral"] == len(kept) and stats["comments_per_s"] == 10 and stats["mean_batch_latency_s"] >= 0


def test_a_failed_job_pays_once(spark, tmp_path):
    """A task fails after calls of its own: what was answered stays answered, in this job's next run and in others."""
    path, log = str(tmp_path / "asked"), AnswerLog(str(tmp_path / "log"))
    run = lambda: relevance.classify(comments(spark, 200), "row_id", PROFILE, counting(path, "77"), PipelineConfig(batch_size=2), log=log)
    with pytest.raises(Exception, match="no answer"):
        run().collect()
    before = len(noted(tmp_path / "asked"))
    assert 0 < before < 180
    got = {r["row_id"]: r["action"] for r in run().collect()}
    every = noted(tmp_path / "asked")
    assert got == {i: "drop" if i % 10 == 9 or not i % 3 else "keep" for i in range(200)}
    # Only what the failed chunks had under way, at most a chunk for each of the tasks, is asked again.
    assert set(map(int, every)) == {i for i in range(200) if i % 10 != 9} and len(every) <= 180 + 2 * 16 * 4
    again = len(every)
    run().write.format("noop").mode("overwrite").save()
    with pytest.raises(Exception, match="later"):
        run().select(F.raise_error(F.lit("later"))).collect()
    assert len(noted(tmp_path / "asked")) == again


def test_a_task_that_fails_after_its_calls(spark, tmp_path):
    """All answers had come; a later step of the same tasks failed."""
    path, log = str(tmp_path / "asked"), AnswerLog(f"file://{tmp_path}/log")
    df = spark.createDataFrame([(i,) for i in range(100)], "i long")
    out = models.told(df, "s", F.concat(F.col("i").cast("string"), F.lit(": x")), counting(path), log=log)
    with pytest.raises(Exception, match="later"):
        out.select(F.raise_error(F.concat(F.lit("later "), "told"))).collect()
    first = len(noted(tmp_path / "asked"))
    assert out.count() == 100 and out.select("told").distinct().count() == 100
    assert len(noted(tmp_path / "asked")) == 100 >= first
    assert log.answers(spark).count() == 100


def test_equal_prompts_are_asked_once_and_models_apart(spark, tmp_path):
    log = AnswerLog(str(tmp_path / "log"))
    df = spark.createDataFrame([(i % 3,) for i in range(30)], "i long").repartition(5)
    ask = lambda system, name: models.told(df, system, F.concat(F.col("i").cast("string"), F.lit(": x")), counting(str(tmp_path / name)), log=log).count()
    assert ask("s", "a") == 30 and len(noted(tmp_path / "a")) == 3
    assert ask("s", "b") == 30 and noted(tmp_path / "b") == []
    assert ask("other", "c") == 30 and len(noted(tmp_path / "c")) == 3
    none = df.where("i > 5")
    assert models.told(none, "s", F.lit("p"), counting(str(tmp_path / "d")), log=AnswerLog(str(tmp_path / "empty"))).count() == 0


def test_texts_of_a_model_are_preprocessed_once(spark, tmp_path):
    """Neither the sample for their ranges nor the filter of sure drops runs over them again."""
    seen = str(tmp_path / "seen")

    @F.udf("string")
    def noting(t):
        note(seen, t.split()[-1])
        return t

    out = relevance.classify(comments(spark, 200), "row_id", PROFILE, counting(str(tmp_path / "asked")), PipelineConfig(batch_size=4), preprocess=noting)
    assert out.count() == 200 and out.where("action = 'drop'").count() == 80
    assert sorted(map(int, noted(tmp_path / "seen"))) == [i for i in range(200) if i % 10 != 9]


def test_first_run_of_the_logged_query_asks_all(spark, sf, monkeypatch):
    """When the query hands over its second run, the log has every answer; that run asks for none."""
    logs = []
    monkeypatch.setattr(catalog, "AnswerLog", lambda folder: logs.append(AnswerLog(folder)) or logs[0])
    out = catalog.QUERIES["relevance_logged"](spark, sf)
    asked = out.where("asked").count()
    assert logs[0].answers(spark).count() == -(-asked // 6) > 0
    before = sorted(os.listdir(logs[0].folder.removeprefix("file:")))
    assert out.where("action = 'keep'").count() and sorted(os.listdir(logs[0].folder.removeprefix("file:"))) == before


def test_fallback_embeds_once(spark, tmp_path):
    protos = spark.createDataFrame([(0, 0, [1.0] + [0.0] * 7)], "proto_id int, class_id int, centroid array<double>")
    for fallback in (backends.FirstToken(["neutral"]), counting(str(tmp_path / "asked"))):
        path = tmp_path / f"e{type(fallback).__name__}"
        out = sentiment.predict_texts(comments(spark), "row_id", "Текст", protos, CountingEmbedder(str(path)), PROFILE, fallback=fallback)
        assert out.where("pred_source = 'llm' and pred_label <> 'neutral'").count() == 0 and len(noted(path)) == 40


def test_categories_embed_once(spark, tmp_path):
    """References and comments: each text is embedded once in a whole job."""
    refs = spark.createDataFrame([("быстрая доставка", "A"), ("цена товара", "B")], "`Текст` string, `Категория` string")
    out = pipeline.category_job(comments(spark, 20), "Раздели", PROFILE, None, refs, CountingEmbedder(str(tmp_path / "e")), row_id="row_id")
    assert out.count() == 20 and len(noted(tmp_path / "e")) == 22


def test_settings_reach_the_model(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def call(client, system, prompt, temperature):
        note(seen, temperature)
        raise TimeoutError

    model = models.ChatModel("m", object, call)
    with pytest.raises(Exception, match="no answer"):
        relevance.asked_model(comments(spark, 1).withColumn("t", F.lit("a")), "row_id", "t", PROFILE, models.configured(model, attempts=2), PipelineConfig(temperature=0.3)).collect()
    assert noted(tmp_path / "seen") == ["0.3"] * 2
    assert models.configured(models.ChatModel("m", object, call, 0.9, 3), temperature=0.1, attempts=5).temperature == 0.9
    assert models.configured(model, attempts=SentimentConfig().max_retries).attempts == 6 and model.attempts is None
    keep = backends.KeepAll()
    assert models.configured(keep, temperature=1.0) is keep
