"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of test items.

Words of windows are coded by three characters each, so the automaton reads a text word by word and a match's end tells
the word's number. Matches are mapped to code-point offsets of the original text. Test items are cut into pieces that
share all but one word of a window, and pieces come in groups of bounded size, so the automaton in a worker's memory is
bounded. One group (the usual case) means one scan; for more, texts are written once with a number, all groups scan them
side by side in one job, and only the numbers and places of hits are brought together.

Defined results: a null or empty text has no words, no hits and is not contaminated. Items with a null id or without
words take no part; an id that occurs on several rows counts once. Repeated documents give repeated rows. Columns other
than the id and the text are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, filtered, named, table, to_batch, words_of, written

WINDOW = 13
#: Bytes of item text for which one automaton is built (of some 350 MB at most); more items go to further groups.
GROUP_BYTES = 1 << 20
#: Words of an item that stay together.
PIECE = 2000
#: A document is contaminated when at least one in so many of its words is hit.
SHARE = 20

_WORD = re.compile(WORD_PATTERN)


def item_windows(rows: list[tuple], window: int = WINDOW) -> dict[bytes, list[str]]:
    """Item windows, joined by blanks, with the ids of their items (as strings)."""
    found: dict[bytes, set[str]] = defaultdict(set)
    for item, text in rows:
        words = words_of(text)
        if item is None or not words:
            continue
        for i in range(max(1, len(words) - window + 1)):
            found[b" ".join(words[i : i + window])].add(str(item))
    return {w: sorted(ids) for w, ids in found.items()}


class Windows:
    """The automaton over windows. The three characters of a code come from three alphabets, so none begins inside of another."""

    WIDTH, UNKNOWN = 3, "\0\0\0"

    def __init__(self, windows: dict[bytes, list[str]]) -> None:
        self.codes: dict[bytes, str] = {}
        for w in sorted({w for x in windows for w in x.split(b" ")}):
            n = len(self.codes)
            self.codes[w] = chr(1 + n % 180) + chr(200 + n // 180 % 180) + chr(400 + n // 32400)
        self.built = ahocorasick.Automaton()
        for x, ids in windows.items():
            words = x.split(b" ")
            self.built.add_word("".join(map(self.codes.__getitem__, words)), (len(words), ids))
        self.built.make_automaton()

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(first word, word after the last, item ids) of every window occurrence, by end."""
        if not self.codes or self.codes.keys().isdisjoint(words):
            return
        known = self.codes.get
        for end, (n, ids) in self.built.iter("".join([known(w, self.UNKNOWN) for w in words])):
            yield (end + 1) // self.WIDTH - n, (end + 1) // self.WIDTH, ids


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans in the original text of half-open spans of words."""
    if not spans:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [(places[a][0], places[b - 1][1]) for a, b in spans]


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


_LOWER = {c: c + 32 for c in range(65, 91)}
_SPANS = pa.list_(pa.int32())
_HITS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", _SPANS), ("ends", _SPANS), ("from_", _SPANS), ("to", _SPANS), ("items", pa.list_(pa.string()))])
_HITS_DDL = "row long, doc_id long, n_words long, starts array<int>, ends array<int>, from_ array<int>, to array<int>, items array<string>"
_OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("hit_starts", _SPANS), ("hit_ends", _SPANS),
    ]
)
OUT_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, hit_starts array<int>, hit_ends array<int>"

_built: dict[str, Windows] = {}


def _windows_of(held) -> Windows:
    """The automaton of a broadcast, built once in a worker."""
    key, windows = held.value
    if key not in _built:
        _built.clear()
        _built[key] = Windows(windows)
    return _built[key]


def _scan(held, every: bool):
    """Hits of each text: spans of words, spans of the original text, items. ``every``: texts without hits, too."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows_of(held)
        for batch in source:
            rows = []
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = words_of(text)
                found = list(windows.occurrences(words))
                if not found and not every:
                    continue
                spans = merged([(a, b) for a, b, _ in found])
                places = original_spans(text, spans)
                rows.append((row, doc, len(words), *([x[i] for x in some] for some in (spans, places) for i in (0, 1)), sorted({i for x in found for i in x[2]})))
            yield to_batch(rows, _HITS)

    return run


def _decided(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the hits of a document, of one group or of all, to what the operator returns."""
    for batch in source:
        rows = []
        for _, doc, n_words, starts, ends, places, stops, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans, original, ids = merged(list(zip(starts, ends, strict=True))), _joined(starts, ends, places, stops), sorted(set(items))
            n_hit = sum(b - a for a, b in spans)
            rows.append((doc, n_words, n_hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), is_contaminated(n_hit, n_words), ids, [a for a, _ in original], [b for _, b in original]))
        yield to_batch(rows, _OUT)


def _joined(starts: list[int], ends: list[int], places: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Spans of the original text whose words overlap or touch become one."""
    out: list[list[int]] = []
    for a, b, c, d in sorted(zip(starts, ends, places, stops, strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, d
        else:
            out.append([a, b, c, d])
    return [(c, d) for _, _, c, d in out]


def _pieces(window: int):
    """Items in pieces of bounded length that together have all of their windows."""
    schema = pa.schema([("item", pa.string()), ("piece", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                rows += [(item, b" ".join(words[i : i + PIECE + window - 1])) for i in range(0, max(1, len(words) - window + 1), PIECE)] if words else []
            yield to_batch(rows, schema)

    return run


def _groups(items: DataFrame, item_col: str, text_col: str, window: int, group_bytes: int) -> list:
    """Broadcasts of item windows: each of about ``group_bytes`` of item text."""
    pieces = items.select(named(item_col).cast("string").alias("item"), named(text_col).alias("text")).filter("item is not null").mapInArrow(_pieces(window), "item string, piece binary")
    pieces = written(pieces, "items")
    size = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))
    spark, out = items.sparkSession, []
    for g in range(groups):
        part = pieces.filter(F.pmod(F.xxhash64("item", "piece"), F.lit(groups)) == g)
        windows = item_windows([(r[0], bytes(r[1]).decode("utf-8", "surrogatepass")) for r in part.collect()], window)
        out.append(spark.sparkContext.broadcast((hashlib.sha256(repr(sorted(windows.items())).encode()).hexdigest(), windows)))
    return out


def _hits(rows: DataFrame, held: list) -> DataFrame:
    """One row per row of (row, doc_id, text), with the hits of all groups."""
    scans = [rows.mapInArrow(_scan(h, every=not g), _HITS_DDL) for g, h in enumerate(held)]
    if len(scans) == 1:
        return scans[0]
    found = scans[0]
    for scan in scans[1:]:
        found = found.unionByName(scan)
    listed = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "from_", "to", "items")]
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *listed)


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: words, hit words, items found with a digest, the decision, and hit spans in the original.

    ``hit_starts`` and ``hit_ends`` are code-point offsets of the merged hits, ends exclusive.
    """
    held = _groups(items, item_col, item_text_col, window, group_bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    return _hits(written(rows, "texts") if len(held) > 1 else rows, held).mapInArrow(_decided, OUT_DDL)


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Documents that are not contaminated, with all their columns."""
    held = _groups(items, "item_id", "text", window, group_bytes)
    if len(held) > 1:
        # Hits of all groups count together; the decision is joined to the documents by their number.
        rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "texts")
        found = _hits(rows.select("row", F.lit(None).cast("long").alias("doc_id"), "doc.text"), held)
        n_hit = found.select("row", "n_words", "starts", "ends").mapInArrow(_bad, "row long")
        return rows.join(n_hit, "row", "left_anti").select("doc.*")

    def decide():
        windows = _windows_of(held[0])

        def keep(texts: list[str | None]) -> list[bool]:
            out = []
            for text in texts:
                words = words_of(text)
                n_hit = sum(b - a for a, b in merged([(a, b) for a, b, _ in windows.occurrences(words)]))
                out.append(not is_contaminated(n_hit, len(words)))
            return out

        return keep

    return filtered(docs, decide)


def _bad(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        rows = [(row,) for row, n, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True) if is_contaminated(sum(b - a for a, b in merged(list(zip(starts, ends, strict=True)))), n)]
        yield to_batch(rows, pa.schema([("row", pa.int64())]))


def op10_contamination(spark, sf_dir: str) -> DataFrame:
    """One row per document with the columns of the contract."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "hit_starts", "hit_ends")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS k FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bn AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dw AS (SELECT k, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bn) WHERE len(w) >= n)),
h AS (SELECT k, item, i, n FROM dw JOIN bw USING (n, win)),
hw AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM h) GROUP BY k),
hi AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (k) LEFT JOIN hi USING (k)
"""
