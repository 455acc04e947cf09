"""License scans: an exact set-similarity join between license templates and blocks of documents.

Texts are cut into overlapping blocks: for a template of up to 33 words, of 64 words that start every 32 words; for
longer ones both numbers double until any run of the template's length lies whole in a block. Template tokens are ordered by their frequency in all documents, rarest first. A template can only be contained
in a block at its threshold if the block has one of the template's first ``size - needed + 1`` tokens (prefix filter),
and if enough tokens of both remain from the first match on (length and positional filter). What passes is verified on the
whole sets, so the filters lose nothing.

The three base phrases are templates with threshold 1, verified further: their words must stand consecutively. The
other templates are public license notices; they add their labels where a block contains enough of them.

Defined results: a null or empty text has no words, no places, empty labels and score 0; repeated documents give
repeated rows. The score is the largest containment of a template that was found (1 for a base phrase), else 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, words_of

#: Words between the starts of blocks for short templates; a block has twice as many.
STRIDE = 32


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    threshold: float
    #: The words must stand consecutively.
    phrase: bool = False

    @property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @property
    def tokens(self) -> list[bytes]:
        return sorted(set(self.words))

    @property
    def stride(self) -> int:
        """Blocks that start every so many words, and have twice as many, hold any run of the template's length."""
        n = STRIDE
        while n + 1 < len(self.words):
            n *= 2
        return n

    @property
    def needed(self) -> int:
        n = len(self.tokens)
        return next(k for k in range(n + 1) if k >= self.threshold * n)


#: The phrases of the contract, then openings and whole texts of public license notices.
TEMPLATES = (
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.8),
    Template("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", 0.8),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", 0.8),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 0.8),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without "
        "warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
        "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other "
        "dealings in the software",
        0.8,
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in "
        "all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall "
        "the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or "
        "other tortious action arising out of or in connection with the use or performance of this software",
        0.8,
    ),
)


class Matcher:
    """Templates with their tokens as ranks in the global order."""

    def __init__(self, templates: tuple[Template, ...], counts: dict[bytes, int]) -> None:
        order = sorted({t for x in templates for t in x.tokens}, key=lambda t: (counts.get(t, 0), t))
        self.rank = {t: r for r, t in enumerate(order)}
        self.templates = templates
        self.sets = [sorted(self.rank[t] for t in x.tokens) for x in templates]
        self.strides = {n: frozenset(k for k, x in enumerate(templates) if x.stride == n) for n in sorted({x.stride for x in templates})}
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for k, (x, ranks) in enumerate(zip(templates, self.sets, strict=True)):
            for i, r in enumerate(ranks[: len(ranks) - x.needed + 1]):
                self.prefixes.setdefault(r, []).append((k, i))

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, float, list[int]]]:
        """(template, block, containment, starts of a phrase) for every pair at its threshold."""
        if self.rank.keys().isdisjoint(words):
            return
        rank = self.rank.get
        hits = [(i, r) for i, w in enumerate(words) if (r := rank(w)) is not None]
        if not any(r in self.prefixes for _, r in hits):
            return
        for stride, own in self.strides.items():
            yield from self._in_blocks(words, hits, stride, own)

    def _in_blocks(self, words: list[bytes], hits: list[tuple[int, int]], stride: int, own: frozenset[int]) -> Iterator[tuple[int, int, float, list[int]]]:
        blocks: dict[int, set[int]] = {}
        for i, r in hits:
            b = i // stride
            blocks.setdefault(b, set()).add(r)
            if b:
                blocks.setdefault(b - 1, set()).add(r)
        for b, found in sorted(blocks.items()):
            ranks = sorted(found)
            tried = set()
            for j, r in enumerate(ranks):
                for k, i in self.prefixes.get(r, ()):
                    if k in tried or k not in own:
                        continue
                    tried.add(k)
                    need, tokens = self.templates[k].needed, self.sets[k]
                    if min(len(tokens) - i, len(ranks) - j) < need:
                        continue
                    common = len(found.intersection(tokens))
                    if common < need:
                        continue
                    starts: list[int] = []
                    if self.templates[k].phrase:
                        phrase = self.templates[k].words
                        end = min(len(words), (b + 2) * stride)
                        starts = [p for p in range(b * stride, end - len(phrase) + 1) if words[p] == phrase[0] and words[p : p + len(phrase)] == phrase]
                        if not starts:
                            continue
                    yield k, b, common / len(tokens), starts


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ]
)
_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(matcher: Matcher):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                places, base, labels, score = set(), set(), set(), 0.0
                for k, _, containment, starts in matcher.matches(words):
                    template = matcher.templates[k]
                    labels.add(template.label)
                    score = max(score, containment)
                    if template.phrase:
                        base.add(template.label)
                        places.update((p, k) for p in starts)
                at = [p for p, _ in places]
                rows.append((doc, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            columns = zip(*rows, strict=True) if rows else [[] for _ in _OUT]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)

    return run


def _count(vocabulary: frozenset[bytes]):
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in source:
            for text in batch.column(0).to_pylist():
                counts.update(filter(vocabulary.__contains__, words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, text_col: str, templates: tuple[Template, ...]) -> dict[bytes, int]:
    """Frequencies of the templates' tokens in all documents; as many rows as the templates have tokens."""
    vocabulary = frozenset(t for x in templates for t in x.tokens)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(vocabulary), "token binary, n long")
    return {bytes(r[0]): r[1] for r in counted.groupBy("token").agg(F.sum("n")).collect()}


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per document: places of base phrases, labels of the phrases and of all templates, and the score."""
    matcher = Matcher(templates, token_counts(docs, text_col, templates))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(matcher), _DDL)


def op8_licenses(spark, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quote = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    phrases = ", ".join(f"('{t.label}', {quote(t.words)})" for t in TEMPLATES if t.phrase)
    others = ", ".join(f"('{t.label}', {quote(t.tokens)}, {t.needed}, {t.stride})" for t in TEMPLATES if not t.phrase)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS k FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) AS p(label, ph)),
o AS (SELECT * FROM (VALUES {others}) AS o(label, ts, needed, stride)),
hits AS (SELECT k, label, i - 1 AS pos FROM (SELECT k, w, label, ph, unnest(range(1, len(w) - len(ph) + 2)) AS i FROM d, p WHERE len(w) >= len(ph)) WHERE w[i:i + len(ph) - 1] = ph),
base AS (SELECT k, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY k),
blocks AS (SELECT k, stride, list_distinct(w[stride * b + 1:stride * (b + 2)]) AS bw FROM (SELECT k, w, stride, unnest(range(0, (len(w) + stride - 1) // stride)) AS b FROM d, (SELECT DISTINCT stride FROM o))),
found AS (SELECT k, label, len(list_intersect(ts, bw)) / len(ts) AS c FROM blocks JOIN o USING (stride) WHERE len(list_intersect(ts, bw)) >= needed),
every AS (SELECT k, label, 1.0::DOUBLE AS c FROM hits UNION ALL SELECT k, label, c FROM found),
l AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM every GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN base USING (k) LEFT JOIN l USING (k)
"""


ORACLE = _oracle()
