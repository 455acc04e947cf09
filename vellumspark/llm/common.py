"""What the corpus operators share: word rules, and tables written to the shared folder and read again."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import counted, discard, in_order, new_path, qualified, shared_dir, written

__all__ = ["counted", "discard", "in_order", "new_path", "qualified", "shared_dir", "written"]

#: Bytes of a word: digits, ASCII letters (lower-cased) and every byte above 0x7F. All others become a blank.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)
#: The same words as a regular expression over text whose A-Z are lower-cased.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words of a text with A-Z lower-cased; a null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of a name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def bucket(col: str, n: int, seed: int = 0):
    """A bucket from 0 to n-1 by hash; rows with a null get the bucket of the seed."""
    return F.pmod(F.xxhash64(F.col(col), F.lit(seed)), F.lit(n)).cast("int")


def batches(rows: Iterable[tuple], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield to_batch(held, schema)
            held = []
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def filtered(docs: DataFrame, decide, column: str = "text") -> DataFrame:
    """Rows whose value in a column is kept; all columns pass as they are.

    ``decide`` is called in each task and gives a function from a list of values to a list of booleans.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = decide()
        for batch in source:
            yield batch.filter(pa.array(keep(batch.column(batch.schema.get_field_index(column)).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
