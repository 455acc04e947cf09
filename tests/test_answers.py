"""The store of answers: each prompt once over several runs, whatever fails in between."""

import os
import pathlib
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vellumspark.operators import answers, deep, model, scan
from vellumspark.session import written


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Counting:
    """Writes down each prompt; fails on some, or ends its task at one, while a file is there."""

    def __init__(self, folder: str, fails: str = "", dies: str = "") -> None:
        self.folder, self.fails, self.dies = folder, fails, dies

    def chat(self, prompt: str, system: str, as_json: bool) -> str:
        broken = os.path.exists(f"{self.folder}/broken")
        if broken and self.dies and prompt.endswith(self.dies):
            raise SystemExit("the task is lost")
        pathlib.Path(self.folder, f"asked-{os.getpid()}").open("a").write(prompt.replace("\n", " ") + "\n")
        if broken and self.fails and prompt.endswith(self.fails):
            raise RuntimeError("no answer")
        return f"<{prompt}>"


def asked(folder):
    return sorted(x for p in pathlib.Path(folder).glob("asked-*") for x in p.read_text().splitlines())


def test_each_prompt_is_asked_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"prompt {i % 40}") for i in range(100)] + [(200, None)], "n int, prompt string").withColumn("key", F.lit(1)).repartition(4)
    held = answers.Stored(Counting(str(tmp_path), fails="7"), "m", str(tmp_path / "store"))
    (tmp_path / "broken").touch()
    first = written(deep.ask(rows, held), "a")
    assert first.columns == ["n", "prompt", "key", "answer", "error"] and first.count() == 101
    assert {r["prompt"] for r in first.filter("error is not null").collect()} == {"prompt 7", "prompt 17", "prompt 27", "prompt 37"}
    (tmp_path / "broken").unlink()
    again = written(deep.ask(rows, held), "b")
    assert again.filter("error is not null or (prompt is not null and answer is null)").count() == 0
    assert all(r["answer"] == f"<{r['prompt']}>" for r in again.filter("prompt is not null").collect())
    twice = ["prompt 17", "prompt 27", "prompt 37", "prompt 7"]
    assert asked(tmp_path) == sorted([f"prompt {i}" for i in range(40)] + twice)
    # Another name is another model: nothing of the first's is taken.
    assert answers.ask(rows.filter("n = 5"), answers.Stored(held.client, "other", held.path), "s").filter("answer is not null").count() == 1
    answers.compact(spark, held.path, str(tmp_path / "small"))
    assert answers.stored(spark, str(tmp_path / "small")).count() == answers.stored(spark, held.path).count() == 41


def test_a_stopped_job_asks_only_what_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"prompt {i:03}") for i in range(60)], "n int, prompt string").repartition(2)
    held = answers.Stored(Counting(str(tmp_path), dies="5"), "m", str(tmp_path / "store"))
    (tmp_path / "broken").touch()
    with pytest.raises(Exception, match="(?s)lost|exit|crash"):
        deep.ask(rows, held).count()
    known = answers.stored(spark, held.path).count()
    (tmp_path / "broken").unlink()
    assert deep.ask(rows, held).filter("answer is null").count() == 0
    assert known > 0 and asked(tmp_path) == [f"prompt {i:03}" for i in range(60)]


def test_a_reading_is_resumed(spark, tmp_path):
    docs = model.assemble(spark.createDataFrame([(f"d{i}", 1, f"Abstract\ntext of {i} " + "x " * 3000) for i in range(3)], "doc_id string, page int, text string"))
    held = answers.Stored(Counting(str(tmp_path)), "m", str(tmp_path / "store"))
    for _ in range(2):
        rows = deep.analyse(docs, scan.scan(docs, ["text"]), held, size=4000).collect()
    prompts = asked(tmp_path)
    assert len(rows) == 3 and len(prompts) == len(set(prompts)) > 15


def test_files_grow_with_time_not_with_answers(spark, tmp_path, monkeypatch):
    class Quick:
        def chat(self, prompt, system, as_json):
            return prompt

    held = answers.Stored(Quick(), "m", str(tmp_path / "store"))
    rows = spark.range(3000).select(F.col("id").cast("string").alias("prompt"))
    assert answers.ask(rows, held, "s", prompts=False).columns == ["answer", "error"]
    assert answers.stored(spark, held.path).count() == 3000 and len(list((tmp_path / "store").glob("*.parquet"))) <= 32
    # A slow client's answers are kept one by one.
    monkeypatch.setattr(answers, "FILE_SECONDS", 0.0)
    slow = answers.Stored(Quick(), "m", str(tmp_path / "slow"))
    list(answers._asked(slow, "s", False)(iter([pa.RecordBatch.from_pydict({"key": list("abc"), "prompt": list("abc")})])))
    assert len(list((tmp_path / "slow").glob("*.parquet"))) == 3


def test_whole_texts_are_not_carried_through_the_stages(spark):
    docs = model.assemble(spark.createDataFrame([(i, 1, f"Abstract\nfirst {i}\n\nDiscussion\nsecond {i}\n\nLimitations\nthird {i}") for i in range(3)], "doc_id int, page int, text string"))
    context = deep.contexts(docs, spark.createDataFrame([(1, 0, "a note")], "doc_id int, index int, note string"))
    got = {r["doc_id"]: (r["context"], r["extra"]) for r in context.collect()}
    assert got[1] == ("### Notas de leitura\na note\n\n### Secao resumo\nAbstract\nfirst 1\n\n", "Limitations\nthird 1")
    assert got[2][0].startswith("### Notas de leitura\n\n\n### Secao resumo")
