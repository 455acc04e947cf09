"""Scan for thousands of keywords, which come as a table.

One automaton over the folded first parts of all keywords reads a text once. Where one of them stands at the beginning of
a word, the keyword's other parts, with their endings and separators, are tried at that place; occurrences of a keyword
don't overlap. The results are those of ``scan``, which has a pattern for each keyword, but the time grows with what is
found, not with the number of keywords.

The automaton is built in each task from the keywords' folded texts, which are sent with the plan: groups of bounded bytes,
each of which reads the texts (a user's list fits in one).

Defined results: keywords that are null, blank or hyphens alone take no part; ones that repeat, or fold alike, are rows of
their own as they are written, each spelling once. A null text has no words. Documents that repeat an id, or have none, are
searched each for itself. Only what is found gives rows. Other columns stay where they are named in ``keep``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from . import scan

#: Bytes of keywords in one automaton (some fifty times that in memory); rows of a batch.
GROUP_BYTES, BATCH_ROWS = 4 << 20, 4096

_FOUND = StructType([StructField("keyword", StringType()), StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType()))])
_BREAK = re.compile(r"[\s\-]+")


@cache
def is_word(c: str) -> bool:
    """Whether a character belongs to a word, as in the patterns of ``scan``."""
    return c.isalnum() or unicodedata.category(c) in ("Mn", "Mc", "Me", "Pc", "Nl") or c in "‌‍"


class Finder:
    """The automaton: for each first part, the keywords that begin with it."""

    def __init__(self, keywords: list[str], flexible: bool) -> None:
        self.ending = T.SUFFIXES if flexible else ""
        self.parts: list[tuple[str, list[str]]] = []
        firsts: dict[str, list[int]] = {}
        for k in keywords:
            parts = [p for p in _BREAK.split(T.fold_text(k).strip()) if p]
            if parts:
                firsts.setdefault(parts[0], []).append(len(self.parts))
                self.parts.append((k, parts))
        self.built = ahocorasick.Automaton()
        for first, ids in firsts.items():
            self.built.add_word(first, (len(first), ids))
        if firsts:
            self.built.make_automaton()
        self.patterns: dict[tuple[str, ...], re.Pattern] = {}

    def _ends(self, norm: str, at: int, parts: list[str]) -> int:
        """Where an occurrence of all parts that begins here ends; -1 if there is none."""
        key = tuple(parts)
        if key not in self.patterns:
            # Longer endings are tried as the pattern of ``scan`` does; what follows must not be part of the word.
            self.patterns[key] = re.compile(r"[\s\-]+".join(re.escape(p) + self.ending for p in parts) + r"(?!\w)")
        m = self.patterns[key].match(norm, at)
        return m.end() if m else -1

    def found(self, norm: str) -> dict[int, list[tuple[int, int]]]:
        """Half-open places in folded text of each keyword that has some."""
        out: dict[int, list[tuple[int, int]]] = {}
        if not self.parts:
            return out
        for last, (length, ids) in self.built.iter(norm):
            at = last + 1 - length
            if at and is_word(norm[at - 1]):
                continue
            for i in ids:
                before = out.get(i)
                if before and before[-1][1] > at:
                    continue
                end = self._ends(norm, at, self.parts[i][1])
                if end >= 0:
                    out.setdefault(i, []).append((at, end))
        return out


def _find(keywords: list[str], flexible: bool, places: bool):
    """Rows with a text as their last column; gives the others, once for each keyword found, with its places."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(keywords, flexible)
        for batch in source:
            kept, held = batch.schema.names[:-1], []
            for at, text in enumerate(batch.column(len(kept)).to_pylist()):
                norm, back = T.fold_with_map(text or "") if places else (T.fold_text(text or ""), None)
                for i, spans in finder.found(norm).items():
                    held.append((at, finder.parts[i][0], [int(back[a]) if places else a for a, _ in spans], [int(back[b - 1]) + 1 if places else b for _, b in spans]))
                if len(held) >= BATCH_ROWS:
                    yield _batch(batch, kept, held)
                    held = []
            if held:
                yield _batch(batch, kept, held)

    return run


def _batch(batch: pa.RecordBatch, kept: list[str], held: list[tuple]) -> pa.RecordBatch:
    at, names, starts, ends = zip(*held, strict=True)
    places = [pa.array(list(x), pa.list_(pa.int32())) for x in (starts, ends)]
    return pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at)) for i in range(len(kept))), pa.array(names, pa.string()), *places], names=[*kept, *_FOUND.names])


def _groups(keywords: DataFrame, column: str, group_bytes: int) -> Iterator[list[str]]:
    """Distinct keywords, group by group: each of about so many bytes."""
    given = keywords.select(T.named(column).cast("string").alias("keyword")).filter("keyword is not null").distinct()
    size = given.agg(F.sum(F.octet_length("keyword"))).first()[0] or 0
    n = max(1, -(-size // group_bytes))
    for g in range(n):
        yield sorted(r[0] for r in given.filter(F.pmod(F.xxhash64("keyword"), F.lit(n)) == g).collect())


def search(docs: DataFrame, keywords: DataFrame, flexible: bool = True, column: str = "keyword", keep: tuple[str, ...] = ("doc_id",), places: bool = True, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(columns to keep, keyword, starts, ends): half-open places in the original text of each keyword found in a text.

    With ``places`` off, places are those of the folded text: enough to count.
    """
    rows = docs.select(*map(T.named, keep), F.col("text").alias("__text"))
    schema = StructType([*rows.schema.fields[:-1], *_FOUND.fields])
    found = None
    for part in _groups(keywords, column, group_bytes):
        hits = rows.mapInArrow(_find(part, flexible, places), schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def totals(docs: DataFrame, keywords: DataFrame, flexible: bool = True, column: str = "keyword", keep: tuple[str, ...] = ("doc_id",), group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(columns to keep, keyword, total, density) of what is found."""
    rows = docs.select(*map(T.named, keep), "text", T.word_count(F.coalesce("text", F.lit(""))).alias("n_words"))
    hits = search(rows, keywords, flexible, column, (*keep, "n_words"), False, group_bytes).withColumn("total", F.size("starts"))
    return hits.select(*map(T.named, keep), "keyword", "total", T.density(F.col("total"), F.col("n_words")).alias("density"))


def occurrences(docs: DataFrame, keywords: DataFrame, flexible: bool = True, column: str = "keyword", window: int = scan.WINDOW, listed: int = scan.LISTED) -> DataFrame:
    """(doc_id, keyword, total, pages, occurrences) of what is found, as ``scan.scan`` gives them."""
    hits = search(docs, keywords, flexible, column, ("doc_id", "text", "pages", "sections"))
    spans = F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end"))
    pages = F.array_sort(F.array_distinct(F.transform("starts", lambda s: T.page_at(F.col("pages"), s))))

    def occurrence(s):
        return F.struct(
            T.page_at(F.col("pages"), s["start"]).alias("page"), T.section_at(F.col("sections"), s["start"]).alias("section"), s["start"].alias("start"), s["end"].alias("end"),
            T.snippet(F.col("text"), s["start"], s["end"], window).alias("snippet"), F.substr("text", s["start"] + 1, s["end"] - s["start"]).alias("term"),
        )

    hits = hits.withColumn("spans", spans)
    return hits.select("doc_id", "keyword", F.size("spans").alias("total"), pages.alias("page_numbers"), F.transform(F.slice("spans", 1, listed), occurrence).alias("occurrences")).withColumnRenamed("page_numbers", "pages")
