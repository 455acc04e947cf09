"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the decision.

Documents with the same words are one class from the start. Of each class one document gets a MinHash signature of its
word n-grams, cut into bands. The number of bands is the least that reaches the target recall at the threshold for the
given number of rows in a band. Band hashes are shuffled, and classes that share one are a bucket.

A large bucket is cut into blocks of bounded size, and a task looks at one pair of blocks. Two passes are made. The
first moves signatures alone, in larger blocks: a pair is a candidate in the first band that it shares and only there, and only if the
sizes of both sets allow the threshold. The second moves the full sets (as 64-bit fingerprints of the n-grams) to just
those pairs of smaller blocks where a class has a candidate, and verifies. So each pair that shares a band is verified once,
pairs that share none never meet, no bucket is ever gathered in one task, and pairs are counted, not listed. What a pair
of blocks emits is one row per class: how many links it has there, and the least class that it is connected with there.

Documents are told apart by id and words. A link is a pair of documents whose sets have at least the threshold in
common, copies included. Texts of fewer words than n are one n-gram.

Defined results: a document without words (or null) has no links and is a class alone; so has a null id. Rows that
repeat an id with the same words are one document. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, named, table, words_of, written
from .graph import components

NGRAM, THRESHOLD = 5, 0.8
#: Probability with which a pair at the threshold shares a band; rows in a band.
RECALL, ROWS = 0.9995, 6
#: A block has so many classes, and so many n-grams, on average at most; and blocks of a larger one for signatures alone.
BLOCK_CLASSES, BLOCK_NGRAMS, LARGER = 256, 400_000, 2

_MIX, _PRIME = 0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """The least number of bands of so many rows that finds a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def fingerprints(words: list[bytes], n: int = NGRAM) -> np.ndarray:
    """Distinct 64-bit fingerprints of the word n-grams.

    A polynomial over the bytes of the words, one blank apart: that of a stretch is the difference of two prefix values,
    divided by the power of its start (powers of an odd number have inverses).
    """
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_PRIME, len(data)), out=sums[1:])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(n, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    return np.unique(_mixed((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]) + np.uint64(k < n))


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Signer:
    """MinHash signatures cut into bands."""

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows = bands, rows
        draw = np.random.default_rng(20_240_229)
        self.xor, self.times = (draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) for _ in range(2))
        self.times |= np.uint64(1)

    def sign(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(grams), 1024):
            part = (grams[i : i + 1024, None] ^ self.xor) * self.times
            np.minimum(least, part.min(axis=0), out=least)
        least = _mixed(least).reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(_PRIME)
        for r in range(self.rows):
            out = _mixed((out ^ least[:, r]) * np.uint64(_PRIME) + np.uint64(r + 1))
        return out.view(np.int64)


def class_key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SIGNED_DDL = "doc_id long, text_hash long, key binary, n long, bands array<long>"


def _sign(n: int, bands: int, rows: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for batch in source:
            keys, sizes, signed = [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                grams = fingerprints(words, n)
                keys.append(class_key(words) if words else None)
                sizes.append(len(grams))
                signed.append(signer.sign(grams) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signed, pa.list_(pa.int64()))], schema=_SIGNED)

    return run


_CANDIDATE = pa.schema([("node", pa.int64()), ("band", pa.int64()), ("number", pa.int32()), ("first", pa.int32()), ("second", pa.int32()), ("block", pa.int32())])
_CANDIDATE_DDL = "node long, band long, number int, first int, second int, block int"
_FOUND = pa.schema([("node", pa.int64()), ("texts", pa.int64()), ("docs", pa.int64()), ("least", pa.int64())])
_FOUND_DDL = "node long, texts long, docs long, least long"


def due(bands: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, across: bool, number: int, threshold: float) -> np.ndarray:
    """Which pairs of a pair of blocks are to be verified there: a symmetric matrix of booleans.

    ``number`` must be the first band that they share, their set sizes must allow the threshold, and they must lie in
    different blocks if the task looks across two.
    """
    wanted = bands[:, None, number] == bands[:, number]
    for earlier in range(number):
        wanted &= bands[:, None, earlier] != bands[:, earlier]
    wanted &= np.minimum(sizes[:, None], sizes) >= threshold * np.maximum(sizes[:, None], sizes) - 1e-9
    if across:
        wanted &= blocks[:, None] != blocks
    np.fill_diagonal(wanted, False)
    return wanted


def _candidates(bands: int, threshold: float):
    """Over rows in the order of their pairs of larger blocks: each class with every smaller block where it has a candidate."""

    def held_rows(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        columns = [part.column(i).to_numpy() for i in range(6)]
        return (*columns, part.column(6).flatten().to_numpy().reshape(-1, bands), part.column(7).to_numpy(), part.column(8).to_numpy())

    def chosen(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        node, band, number, first, second, sizes, signed, larger, block = rows
        change = np.flatnonzero((np.diff(band) != 0) | (np.diff(first) != 0) | (np.diff(second) != 0)) + 1
        starts, ends = np.r_[0, change], np.r_[change, len(node)]
        twos = starts[ends - starts == 2]
        # Most buckets have two classes; these are looked at together.
        same = signed[twos] == signed[twos + 1]
        fits = np.minimum(sizes[twos], sizes[twos + 1]) >= threshold * np.maximum(sizes[twos], sizes[twos + 1]) - 1e-9
        apart = (first[twos] == second[twos]) | (larger[twos] != larger[twos + 1])
        good = twos[(same.argmax(axis=1) == number[twos]) & fits & apart]
        mine, other = [good, good + 1], [block[good + 1], block[good]]
        for a, b in zip(starts, ends, strict=True):
            if b - a > 2:
                x, y = np.nonzero(due(signed[a:b], sizes[a:b], larger[a:b], first[a] != second[a], int(number[a]), threshold))
                if len(x):
                    pairs = np.unique(x * (1 << 32) + block[a:b][y])
                    mine.append(a + (pairs >> 32))
                    other.append(pairs & ((1 << 32) - 1))
        at, other = np.concatenate(mine), np.concatenate(other)
        own = block[at]
        columns = (node[at], band[at], number[at], np.minimum(own, other), np.maximum(own, other), own)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _CANDIDATE, strict=True)], schema=_CANDIDATE)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None
        for part in source:
            if not part.num_rows:
                continue
            rows = held_rows(part)
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
            last = np.flatnonzero((rows[1] != rows[1][-1]) | (rows[3] != rows[3][-1]) | (rows[4] != rows[4][-1]))
            # The last pair of blocks may go on in the next batch.
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield chosen(tuple(x[:cut] for x in rows))
            held = tuple(x[cut:] for x in rows)
        if held is not None:
            yield chosen(held)

    return run


def shared(sets: list[np.ndarray], width: int = 1 << 15) -> np.ndarray:
    """Sizes of all pairwise intersections, by matrix products over the n-grams that occur twice or more."""
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = counts[place] > 1
    owners, place = owners[kept], (np.cumsum(counts > 1) - 1)[place[kept]]
    order = np.argsort(place, kind="stable")
    owners, place = owners[order], place[order]
    out = np.zeros((len(sets), len(sets)))
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [low, low + width])
        part = np.zeros((len(sets), min(width, int(place[b - 1]) - low + 1)), np.float32)
        part[owners[a:b], place[a:b] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _verify(bands: int, threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes, copies, sizes, blocks = (group.column(c).to_numpy() for c in ("node", "copies", "n", "block"))
        if len(nodes) < 2:
            return _FOUND.empty_table()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("grams")]
        signed = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, bands)
        first, second, number = (group.column(c)[0].as_py() for c in ("first", "second", "number"))
        linked = due(signed, sizes, blocks, first != second, number, threshold)
        if linked.any():
            common = shared(sets)
            linked &= common >= threshold * (sizes[:, None] + sizes - common) - 1e-9
        least = nodes.copy()
        while True:
            spread = np.minimum(least, np.where(linked, least[None, :], least.max()).min(axis=1))
            if (spread == least).all():
                break
            least = spread
        some = linked.any(axis=1)
        columns = [nodes[some], linked.sum(axis=1)[some], (linked @ copies)[some], least[some]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)

    return run


_SETS_DDL = "node long, copies long, n long, bands array<long>, grams binary"


def _sets(n: int):
    """The n-gram sets of texts, of which only those with the words of their class count: an id may stand on several."""
    schema = pa.schema([("node", pa.int64()), ("copies", pa.int64()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())), ("grams", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys, texts = batch.column(4), batch.column(5)
            kept, grams = [], []
            for i in range(batch.num_rows):
                words = words_of(texts[i].as_py())
                if class_key(words) == keys[i].as_py():
                    kept.append(i)
                    grams.append(fingerprints(words, n).tobytes())
            own = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(own.column(i) for i in range(4)), pa.array(grams, pa.binary())], schema=schema)

    return run


def _members(classes: DataFrame) -> DataFrame:
    """Classes in every pair of larger blocks of their buckets: node, band, number (of the band), first, second, n, bands, larger, block."""
    banded = classes.select("node", "n", F.posexplode("bands").alias("number", "band"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_NGRAMS)).cast("long")
    buckets = banded.groupBy("band").agg(F.count("*").alias("size"), blocks.alias("blocks")).filter("size > 1")
    buckets = buckets.select("band", "blocks", F.ceil(F.col("size") / (LARGER * BLOCK_CLASSES)).cast("long").alias("parts"))
    rows = banded.drop("n").join(buckets, "band").join(classes.select("node", "n", "bands"), "node")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("larger", F.pmod("block", "parts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.select("node", "band", "number", F.least("larger", "other").alias("first"), F.greatest("larger", "other").alias("second"), "n", "bands", "larger", "block")


def jaccard_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the table: doc_id, text_hash, class_id (least id of all that are connected), n_links, n_texts, kept.

    ``n_links`` counts linked documents, ``n_texts`` the different texts among them other than its own. ``kept`` is true
    for one document of each class, that with the least id and then the least hash of its text (on all rows that repeat
    it).
    """
    count = bands_for(threshold, recall, rows)
    source = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = written(source.select("doc_id", "text_hash", "text").mapInArrow(_sign(n, count, rows), _SIGNED_DDL), "signatures")
    is_known = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    each = signed.filter(is_known).groupBy("key", "doc_id").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = each.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min_by("text_hash", "doc_id").alias("text_hash"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # Numbers of rows, written with them: unlike hashes they never meet.
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    place = ["band", "first", "second"]
    ordered = _members(classes).repartition(*place).sortWithinPartitions(*place)
    candidates = written(ordered.mapInArrow(_candidates(count, threshold), _CANDIDATE_DDL), "candidates")
    wanted = classes.join(candidates.select("node").distinct(), "node")
    texts = source.withColumnRenamed("doc_id", "rep").join(wanted, ["rep", "text_hash"]).select("node", "copies", "n", "bands", "key", "text")
    sets = written(texts.dropDuplicates(["node"]).mapInArrow(_sets(n), _SETS_DDL), "sets")
    found = candidates.join(sets, "node").groupBy(*place).applyInArrow(_verify(count, threshold), _FOUND_DDL)
    found = written(found, "links")
    discard(candidates, sets)
    links = found.groupBy("node").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    linked = written(classes.select("node", "rep", "text_hash").join(links, "node").join(roots, "node"), "linked")
    names = linked.groupBy("root").agg(F.min(F.struct("rep", "text_hash")).alias("name"))
    called = linked.join(names, "root").select("node", "name", "texts", "docs")
    own = F.coalesce("name", F.struct("rep", "text_hash"))
    result = classes.select("node", "key", "rep", "text_hash", "copies").join(called, "node", "left")
    result = result.select("key", own["rep"].alias("class_id"), own["text_hash"].alias("kept_hash"), (F.col("copies") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    # Written, so that both sides of the last join are plain exchanges and a class of very many copies can be split.
    result = written(result, "results")
    discard(found, linked, classes)
    kept = (F.col("doc_id") == F.col("class_id")) & (F.col("text_hash") == F.col("kept_hash"))
    known = signed.filter(is_known).select("doc_id", "text_hash", "key").join(result, "key")
    known = known.select("doc_id", "text_hash", "class_id", F.col("n_links").cast("long").alias("n_links"), F.col("n_texts").cast("long").alias("n_texts"), kept.alias("kept"))
    none = F.lit(0).cast("long")
    alone = signed.filter(~is_known).select("doc_id", "text_hash", F.col("doc_id").alias("class_id"), none.alias("n_links"), none.alias("n_texts"), F.lit(True).alias("kept"))
    return known.unionByName(alone)


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("text_hash", "kept")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns; of repeated rows one. Rows with a null id stay.

    The user's columns lie in a struct meanwhile, so no name can clash.
    """
    kept = jaccard_classes(docs).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).distinct()
    rows = docs.select(F.struct("*").alias("doc"), named("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    first = rows.join(kept, ["id", "hash"]).dropDuplicates(["id", "hash"]).select("doc")
    return first.union(rows.filter("id is null").select("doc")).select("doc.*")
