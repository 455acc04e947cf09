"""Chunks with overlap. Where one chunk ends decides where the next begins, so places are found in an Arrow function."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Sizes of the library, of the configuration, and the most chunks that a model sees.
SIZE, OVERLAP, MODEL_SIZE, MODEL_CHUNKS = 6000, 400, 8000, 24

#: Where a paragraph ends and where a sentence does; how long these signs are, and how much of them stays in the chunk.
_BORDERS, _WIDTHS = (r"(?=\n\n)", r"\. "), ((2, 0), (2, 1))


def places(text: str, size: int, overlap: int) -> list[tuple[int, int]]:
    """Half-open places of chunks that are not blank.

    Borders of paragraphs and of sentences are listed in one pass. A chunk takes what fits; if text remains, it ends at
    the last border of a paragraph in its second half, else at the last of a sentence there, else where it is full. The
    next begins the overlap earlier, which is half a chunk at most, but always later than its predecessor.
    """
    borders = [[m.start() for m in re.finditer(p, text)] for p in _BORDERS]
    back, last, out, begin = min(max(overlap, 0), size // 2), len(text), [], 0

    def cut(low: int, full: int) -> int:
        for found, (length, shift) in zip(borders, _WIDTHS, strict=True):
            i = bisect.bisect_right(found, full - length) - 1
            if i >= 0 and found[i] >= low:
                return found[i] + shift
        return full

    while begin < last:
        full = begin + size
        end = last if full >= last else cut(begin + size // 2, full)
        if not text[begin:end].isspace() and end > begin:
            out.append((begin, end))
        begin = last if end == last else max(end - back, begin + 1)
    return out


def _places(size: int, overlap: int):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([[{"start": a, "end": b} for a, b in places(t or "", size, overlap)] for t in part])

    return F.pandas_udf(run, "array<struct<start:int,end:int>>")


def label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("p. "), first)).otherwise(F.concat(F.lit("p. "), first, F.lit("-"), last))


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, index, start, end, text, first_page, last_page, label); a size below 1 is an error."""
    if size <= 0:
        raise ValueError("size must be positive")
    rows = docs.select("doc_id", "text", "pages", F.posexplode(_places(size, overlap)("text")).alias("index", "c"))
    start, end = F.col("c.start"), F.col("c.end")
    rows = rows.select("doc_id", "index", start.alias("start"), end.alias("end"), T.strip(F.substr("text", start + 1, end - start)).alias("text"), T.page_at(F.col("pages"), start).alias("first_page"), T.page_at(F.col("pages"), F.greatest(start, end - 1)).alias("last_page"))
    return rows.withColumn("label", label(F.col("first_page"), F.col("last_page")))
