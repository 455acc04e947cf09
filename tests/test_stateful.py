"""Triage and events of readings as streams: any cut into micro-batches, restarts, repeats and silence."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import batch
from vellumspark.streaming import stateful

UPLOADS = "session_id string, arrival long, content_sha256 string"
ANSWERS = "session_id string, total int, doc_id string, name string, position int, stage string, error string"


def put(folder, n, rows, columns):
    """A file of rows, whose name is its place."""
    folder.mkdir(exist_ok=True)
    path = folder / f"{n:05}.json"
    path.write_text("".join(json.dumps(dict(zip(columns, r, strict=True))) + "\n" for r in rows))
    os.utime(path, (1_700_000_000 + n,) * 2)  # files are taken by their time


def names(ddl):
    return [c.split()[0] for c in ddl.split(", ")]


def run(spark, folder, ddl, made, out, checkpoint):
    """One run over what has arrived, a file for each micro-batch."""
    # Else batches without data, which look for what has timed out, go on for ever.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(folder))
    query = made(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert query.exception() is None


@pytest.mark.parametrize("cuts", [1, 4])
def test_seats_as_in_one_batch(spark, tmp_path, cuts):
    draw = random.Random(cuts)
    rows = [(draw.choice(["a", "b", None]), i, f"h{draw.randrange(9)}") for i in range(60)]
    places = sorted(draw.sample(range(1, 60), cuts - 1))
    parts = [rows[a:b] for a, b in zip([0, *places], [*places, 60], strict=True)]
    for n, part in enumerate(parts):
        put(tmp_path / "in", n, draw.sample(part, len(part)), names(UPLOADS))
        if n % 2 or n == len(parts) - 1:  # started anew from the checkpoint in between
            run(spark, tmp_path / "in", UPLOADS, lambda s: stateful.triage(s, 3), tmp_path / "out", tmp_path / "state")
    got = spark.read.parquet(str(tmp_path / "out"))
    table = spark.createDataFrame(rows, UPLOADS)
    # The batch takes a null session for one that has no rows to join, so it is named.
    named = lambda df: df.withColumn("session_id", F.coalesce("session_id", F.lit("none")))
    want = batch.triage(named(table), limit=3).select(*got.columns)
    assert sorted(map(str, named(got).collect())) == sorted(map(str, want.collect()))


def test_events_in_order_and_once(spark, tmp_path):
    stages = ("summary", "findings")
    row = lambda s, d, stage=None, error=None: (s, 2, f"{s}{d}", f"doc {s}{d}", d, stage, error)
    parts = [
        [row("a", 1), row("b", 1)], [row("a", 1, "findings"), row("a", 2)], [row("a", 1, "summary"), row("a", 1, "findings"), row("b", 1, "summary")],
        [row("a", 2, "summary"), row("a", 2, None, "no model"), row("a", 2, "findings")], [row("b", 2, "summary"), row("b", 2, "findings"), row("b", 1, "findings")], [row("a", 2, "summary"), row("b", 1, "findings")],
    ]
    for n, part in enumerate(parts):
        put(tmp_path / "in", n, part, names(ANSWERS))
        if n in (1, 2, 5):
            run(spark, tmp_path / "in", ANSWERS, lambda s: stateful.reading_events(s, stages), tmp_path / "out", tmp_path / "state")
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("session_id", "number").collect():
        got.setdefault(r["session_id"], []).append((r["number"], r["kind"], r["position"], r["stage"], r["message"]))
    told = lambda *events: [(i, *e, *[None] * (4 - len(e))) for i, e in enumerate(events)]
    assert got["a"] == told(("inicio",), ("artigo_inicio", 1), ("progresso", 1, "summary"), ("progresso", 1, "findings"), ("artigo_fim", 1), ("artigo_inicio", 2), ("progresso", 2, "summary"), ("progresso", 2, "findings"), ("artigo_erro", 2, None, "no model"), ("fim", None, None, "1; doc a2"))
    assert got["b"] == told(("inicio",), ("artigo_inicio", 1), ("progresso", 1, "summary"), ("progresso", 1, "findings"), ("artigo_fim", 1), ("artigo_inicio", 2), ("progresso", 2, "summary"), ("progresso", 2, "findings"), ("artigo_fim", 2), ("fim", None, None, "2"))


def test_silent_sessions_end(spark, tmp_path):
    row = lambda d, stage=None: ("a", 2, f"a{d}", f"doc {d}", d, stage, None)
    put(tmp_path / "in", 0, [row(1), row(1, "summary"), row(2)], names(ANSWERS))
    made = lambda s: stateful.reading_events(s, ("summary",), 1)
    run(spark, tmp_path / "in", ANSWERS, made, tmp_path / "out", tmp_path / "state")
    put(tmp_path / "in", 1, [("b", 1, "b1", "doc", 1, None, None)], names(ANSWERS))
    run(spark, tmp_path / "in", ANSWERS, made, tmp_path / "out", tmp_path / "state")
    kinds = [(r["kind"], r["message"]) for r in spark.read.parquet(str(tmp_path / "out")).filter("session_id = 'a'").orderBy("number").collect()]
    assert kinds == [("inicio", None), ("artigo_inicio", None), ("progresso", None), ("artigo_fim", None), ("artigo_inicio", None), ("artigo_erro", "no answer"), ("fim", "1; doc 2")]
