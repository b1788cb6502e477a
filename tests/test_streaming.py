"""The relevance job over a stream: what was asked is remembered."""

import json
import os
import sys
import time

from pyspark import cloudpickle

from opinarium.operators.answerlog import AnswerLog
from opinarium.plans.config import BrandProfile, PipelineConfig
from opinarium.streaming.comments import relevance_stream

cloudpickle.register_pickle_by_value(sys.modules[__name__])
PROFILE = BrandProfile("Ромашка", "Магазины", ["ромашка"], ["(?i)ваканси"])


class Noting:
    name = "noting"

    def __init__(self, path):
        self.path = path

    def ask(self, system, prompt):
        text = next(x for x in prompt.split("\n") if x.startswith("0: "))[3:]
        with os.fdopen(os.open(self.path, os.O_WRONLY | os.O_CREAT | os.O_APPEND), "w") as f:
            f.write(f"{text}\n")
        return "нет" if "странно" in text else json.dumps({"results": [{"global_idx": 0, "action": "drop" if "плох" in text else "keep"}]})


def noted(path):
    return sorted(path.read_text().splitlines()) if path.exists() else []


def put(spark, folder, rows):
    spark.createDataFrame(rows, "row_id long, `Текст` string").coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, name, checkpoint, **more):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema("row_id long, `Текст` string").parquet(str(tmp_path / "in"))
    out = relevance_stream(stream, "row_id", PROFILE, Noting(str(tmp_path / name)), PipelineConfig(), **more)
    query = out.writeStream.format("parquet").option("path", str(tmp_path / f"out-{checkpoint}")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).outputMode("append").start()
    ended = query.awaitTermination(100)
    query.stop()
    assert ended
    return {r["row_id"]: (r["action"], r["asked"], r["is_drop"]) for r in spark.read.parquet(str(tmp_path / f"out-{checkpoint}")).collect()}


def test_a_text_is_asked_once(spark, tmp_path):
    put(spark, tmp_path / "in", [(0, "вакансия"), (1, "хорошая покупка вчера"), (2, "плохая погода сегодня"), (3, "хорошая покупка вчера"), (4, None)])
    first = run(spark, tmp_path, "asked", "c1")
    assert first[0] == ("drop", False, "Yes") and first[1] == first[3] == ("keep", True, "No") and first[2] == ("drop", True, "Yes") and len(first) == 5
    asked = noted(tmp_path / "asked")
    assert [a for a in asked if a] == ["плохая погода сегодня", "хорошая покупка вчера"]
    put(spark, tmp_path / "in", [(5, "хорошая покупка вчера"), (6, "очень странно всё это"), (7, "плохая погода сегодня")])
    both = run(spark, tmp_path, "asked", "c1")
    assert {k: both[k] for k in first} == first and both[5][0] == "keep" and both[6][0] == "keep" and both[7][0] == "drop"
    assert noted(tmp_path / "asked") == sorted([*asked, "очень странно всё это"])


def test_a_replay_asks_nothing(spark, tmp_path):
    """The whole stream runs again without its state: the log has all answers."""
    log = AnswerLog(str(tmp_path / "log"))
    put(spark, tmp_path / "in", [(i, f"хорошая покупка номер {i % 4}") for i in range(12)])
    first = run(spark, tmp_path, "asked", "c1", log=log)
    assert len(noted(tmp_path / "asked")) == 4 and len(first) == 12
    assert run(spark, tmp_path, "again", "c2", log=log) == first and noted(tmp_path / "again") == []


def test_answers_are_forgotten_after_a_time(spark, tmp_path):
    put(spark, tmp_path / "in", [(0, "хорошая покупка вчера")])
    run(spark, tmp_path, "asked", "c1", remember_ms=1)
    time.sleep(1.1)
    put(spark, tmp_path / "in", [(1, "плохая погода сегодня")])
    run(spark, tmp_path, "asked", "c1", remember_ms=1)
    put(spark, tmp_path / "in", [(2, "хорошая покупка вчера")])
    assert run(spark, tmp_path, "asked", "c1", remember_ms=1)[2][0] == "keep"
    assert noted(tmp_path / "asked").count("хорошая покупка вчера") == 2
