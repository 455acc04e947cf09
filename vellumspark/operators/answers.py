"""A store of a client's answers by content, so that a reading that was stopped asks only what is missing.

An answer is kept under the hash of all that it depends on: the client's name, the system text, the prompt and the form
asked for. Tasks append files to the store's folder as answers come, each under a name of its own that is given once the
file is whole; so what was answered stays, whether its task, its job or the application ends well or not. A file holds
what came in a few seconds: a slow client's answers are written a few at a time, a fast one's by thousands, so that the
number of files grows with the time of the asking, not with the answers. A job asks for the prompts whose hash the store
lacks (an anti-join), each once, however many rows have it.

``Stored(client, name, path)`` is a client for the operators of ``deep``. Failures are not kept: they are asked again the
next time. Two jobs at once may ask for the same prompt; the least answer counts, for both.

Defined results: a null prompt has neither answer nor error and is not asked; rows that repeat have the same answer; an
answer that is null is kept as one.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import qualified, written

#: Answers of a file at most, and seconds after which the next answer closes it: no more is lost with a process.
FILE_ROWS, FILE_SECONDS = 4096, 2.0
_STORED = "key string, answer string"


@dataclass(frozen=True)
class Stored:
    """A client with the name under which its answers are kept (with its model and options), and the store's folder."""

    client: Any
    name: str
    path: str

    def chat(self, prompt: str, system: str, as_json: bool) -> str:
        return self.client.chat(prompt, system, as_json)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer) of all that a store holds; an empty table if there is none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    rows = spark.read.schema(_STORED).parquet(path) if there else spark.createDataFrame([], _STORED)
    return rows.groupBy("key").agg(F.min("answer").alias("answer"))


def _append(folder: str, rows: list[tuple[str, str | None]]) -> None:
    """A file of answers, under its name only once it is whole."""
    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    system.create_dir(root)
    name = f"{uuid.uuid4().hex}.parquet"
    pq.write_table(pa.table({"key": pa.array([k for k, _ in rows], pa.string()), "answer": pa.array([a for _, a in rows], pa.string())}), f"{root}/_{name}", filesystem=system)
    system.move(f"{root}/_{name}", f"{root}/part-{name}")


def _asked(held: Stored, system: str, as_json: bool):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            got: list[tuple[str, str | None]] = []
            failed: list[tuple[str, str]] = []
            since = time.monotonic()
            try:
                for key, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    try:
                        got.append((key, held.client.chat(prompt, system, as_json)))
                    except Exception as e:  # noqa: BLE001  a client's failure is a result
                        failed.append((key, str(e) or type(e).__name__))
                    if len(got) >= FILE_ROWS or got and time.monotonic() - since >= FILE_SECONDS:
                        _append(held.path, got)
                        got, since = [], time.monotonic()
            finally:
                # What was answered stays, also if the task ends here.
                if got:
                    _append(held.path, got)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in failed], pa.string()), pa.array([e for _, e in failed], pa.string())], names=["key", "error"])

    return run


def ask(rows: DataFrame, held: Stored, system: str, as_json: bool = False, prompts: bool = True) -> DataFrame:
    """Adds answer and error to rows with a prompt: from the store, and from the client where the store has none.

    The rows are read twice, so costly ones should be written. Without ``prompts`` these don't stay in the result.
    """
    spark = rows.sparkSession
    held = Stored(held.client, held.name, qualified(spark, held.path))
    kind = f"{held.name}\0{system}\0{as_json}\0"
    keyed = rows.withColumn("__key", F.when(F.col("prompt").isNotNull(), F.sha2(F.concat(F.lit(kind), "prompt"), 256)))
    wanted = keyed.filter("__key is not null").groupBy(F.col("__key").alias("key")).agg(F.first("prompt").alias("prompt"))
    missing = wanted.join(stored(spark, held.path).select("key"), "key", "left_anti")
    # Written: the client is asked in this job, once for each key, and never for a later use of the result.
    failed = written(missing.mapInArrow(_asked(held, system, as_json), "key string, error string"), "failures")
    answers = stored(spark, held.path).withColumnRenamed("key", "__key")
    faults = failed.groupBy(F.col("key").alias("__key")).agg(F.min("error").alias("error"))
    stay = [F.col(f"`{c}`") for c in rows.columns if prompts or c != "prompt"]
    out = keyed.join(answers, "__key", "left").join(faults, "__key", "left").select(*stay, "answer", "error")
    # Written: in one plan, Spark would take two states of the store, which are one path, for the same table.
    return written(out, "answered")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write a store anew to another folder, as a few files instead of one for every few answers."""
    stored(spark, path).repartition(max(1, stored(spark, path).count() // 100_000)).write.mode("overwrite").parquet(target)
