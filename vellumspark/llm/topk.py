"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, tree merging.

Vectors are packed into tiles of bounded size, one row each: ids and a matrix of numbers. Tiles of queries and of
candidates are put in groups of bounded bytes, and both are shuffled to every pair of their groups (nothing is
broadcast): a task multiplies the tiles of one group by those of another and keeps, per query, the best k. Those lists
are merged in rounds of bounded fan-in. Groups are large, since candidates are shuffled once for each group of queries.

Components x become floor(scale * x) with x as double; what leaves the range of doubles counts as the largest double.
Products are exact: they run in single precision if every partial sum fits 24 bits, else in double precision if it fits
53, else in Python's integers. Scores beyond 64 bits count as the nearest such number.

Defined results: vectors that are null, or hold null, NaN or infinite components, and rows with a null id take no part.
Vectors of different lengths are never compared. A query's own row is told by its id: rows with
that id are never found for it. If several rows have a query's id, the least vector is the query. Ties go to the
smaller id; candidate rows that repeat count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .tiles import best, candidates, finite, products, scaled

SCALE, K, QUERY_EVERY = 256, 5, 50
#: Vectors of a tile at most; bytes of a group of tiles on average; groups of candidates at least, if there are tiles.
TILE, GROUP_BYTES, LEAST_GROUPS = 2048, 32 << 20, 8
#: Lists that one merge takes.
FAN_IN = 16

_TILE = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("numbers", pa.binary()), ("largest", pa.float64())])
_TILE_DDL = "dim int, n int, ids binary, numbers binary, largest double"


def _pack(scale: int):
    def tile(dim: int, ids: list[np.ndarray], rows: list[np.ndarray]) -> pa.RecordBatch:
        joined, keys = np.concatenate(rows), np.concatenate(ids)
        order = np.argsort(keys, kind="stable")
        joined = joined[order]
        largest = float(np.abs(joined).max(initial=0))
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((dim, len(keys), keys[order].astype("<i8").tobytes(), joined.astype("<f8").tobytes(), largest), _TILE, strict=True)], schema=_TILE)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in source:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
            flat, ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), batch.column(0).to_numpy()
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                rows = flat[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))
                kept = held.setdefault(int(dim), ([], []))
                kept[0].append(ids[at])
                kept[1].append(scaled(rows, scale))
                if sum(map(len, kept[0])) >= TILE:
                    keys, all_rows = np.concatenate(kept[0]), np.concatenate(kept[1])
                    whole = len(keys) // TILE * TILE
                    for i in range(0, whole, TILE):
                        yield tile(int(dim), [keys[i : i + TILE]], [all_rows[i : i + TILE]])
                    held[int(dim)] = ([keys[whole:]], [all_rows[whole:]])
        for dim, (keys, rows) in held.items():
            if sum(map(len, keys)):
                yield tile(dim, keys, rows)

    return run


_PART = pa.schema([("query_id", pa.int64()), ("tile", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])
_PART_DDL = "query_id long, tile long, score long, vec_id long"


def _multiply(k: int):
    def run(key: tuple, tiles: pa.Table, blocks: pa.Table) -> pa.Table:
        """The tiles of one group with the query tiles of another: each query's best k of the group."""

        def unpacked(held: pa.Table) -> list[tuple]:
            rows = []
            for r in range(held.num_rows):
                dim, n, largest = (held.column(c)[r].as_py() for c in ("dim", "n", "largest"))
                view = lambda c, kind: np.frombuffer(held.column(c)[r].as_buffer(), kind)  # noqa: B023, E731
                rows.append((dim, view("ids", "<i8"), view("numbers", "<f8").reshape(n, dim), largest))
            return rows

        rows, kept = unpacked(tiles), []
        for dim, own, queries, q_largest in unpacked(blocks):
            found = []
            for other, ids, numbers, largest in rows:
                if other == dim:
                    scores = products(queries, numbers, max(q_largest, largest))
                    q, c = candidates(scores, own[:, None] != ids[None, :], k)
                    found.append((q, scores[q, c], ids[c]))
            if found:
                q, scores, ids = best(*map(np.concatenate, zip(*found, strict=True)), k)
                kept.append((own[q], np.full(len(q), key[0].as_py()), scores, ids))
        columns = map(np.concatenate, zip(*kept, strict=True)) if kept else [np.zeros(0, np.int64)] * len(_PART)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PART, strict=True)], schema=_PART)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best rows for every query: query_id, rank (from 1), vec_id, score."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), is_query.alias("is_query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & finite(F.col("vector"))).withColumn("vector", F.col("vector").cast("array<double>"))
    numbered = lambda df: df.withColumn("tile", F.monotonically_increasing_id())
    # Written, so that the numbers of tiles hold.
    tiles = written(numbered(rows.select("vec_id", "vector").mapInArrow(_pack(scale), _TILE_DDL)), "vectors")
    queries = rows.filter("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = written(numbered(queries.mapInArrow(_pack(scale), _TILE_DDL)), "queries")
    n_tiles, n_blocks = max(_groups(tiles), min(LEAST_GROUPS, tiles.count())), _groups(blocks)
    place = lambda n: F.pmod(F.xxhash64("tile"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pair = ["row_key", "query_key"]
    left = tiles.withColumn("row_key", place(n_tiles)).withColumn("query_key", every(n_blocks)).groupBy(*pair)
    right = blocks.withColumn("query_key", place(n_blocks)).withColumn("row_key", every(n_tiles)).groupBy(*pair)
    return _merge(left.cogroup(right).applyInArrow(_multiply(k), _PART_DDL), n_tiles, k)


def _groups(tiles: DataFrame) -> int:
    return max(1, -(-(tiles.agg(F.sum(F.length("numbers"))).first()[0] or 0) // GROUP_BYTES))


def _merge(parts: DataFrame, places: int, k: int) -> DataFrame:
    """Merge lists of tiles by the fan-in until one is left per query."""
    best = F.slice(F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id"))), 1, k)
    # Numbers of tiles have gaps, so groups are made by hash.
    while True:
        places = -(-places // FAN_IN)
        group = F.pmod(F.xxhash64("tile"), F.lit(places)) if places > 1 else F.lit(0)
        parts = parts.groupBy("query_id", group.cast("long").alias("tile")).agg(best.alias("best"))
        if places <= 1:
            break
        parts = parts.select("query_id", "tile", F.explode("best").alias("b")).select("query_id", "tile", F.bitwise_not(F.col("b.s")).alias("score"), "b.vec_id")
    return parts.select("query_id", F.posexplode("best").alias("place", "b")).select("query_id", (F.col("place") + 1).alias("rank"), "b.vec_id", F.bitwise_not(F.col("b.s")).alias("score"))


def op9_topk(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
