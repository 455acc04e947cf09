"""Hard negatives by a Voronoi-partitioned kNN join.

Scores are inner products of whole numbers, floor(scale * x). Every vector gets one more component, by which all have the
same norm M (anchors get a zero there): then a higher score is a smaller distance. Pivots divide that space into Voronoi
cells. Rows of a cell are sorted by distance to its pivot and packed into tiles, each a ring of the cell; anchors are put
in groups of neighbouring cells. By the triangle inequality a ring can hold partners of a group only if

    |pivot - pivot'| - (reach of the group's anchors) - (limit of the group) <= ring's far edge, and likewise inside,

where the limit is the largest distance to the k-th partner that an anchor has already. The limits come from an exact
join of each group with its own cells; then only the rings that may hold something better are replicated to the group,
and joined exactly. This is done twice: for positives (same label), then for negatives, where each pair of anchor and
positive has a window of scores and the limits come from the tenth negative of each window.

A task joins one group of bounded rows with a few tiles of bounded rows and keeps the best of each; lists are merged by
anchor afterwards. So a label, a cell or a vector that holds a third of all rows is spread over many tiles. In data
without structure the bounds exclude nothing and every tile meets every group: the result is still whole.

Pivots are a bounded sample of vectors by hash; they decide what is skipped, never what is found. Vectors whose length is
not among those of the sample share one cell per length.

Defined results: rows with a null id or label, a null vector, or one with null or non-finite components take no part.
Vectors of different lengths are never compared. Rows with the anchor's id are never its partners; if several rows have
an anchor's id, the least (vector, label) is the anchor. Ties go to the smaller id; rows that repeat count as often as
they occur, as positives with the same rows for each. Scores beyond 64 bits count as the nearest such number, and
components whose multiple leaves the range of doubles as the largest double. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, in_order, named, table, written
from .tiles import LEAST_SCORE, MOST_SCORE, best, by_length, candidates, finite, products, scaled

SCALE, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256, 100, 7, 10
#: Positives of an anchor, negatives of a positive, and the window of a negative's score in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Pivots at most, of one length; the sample that they come from is as large.
PIVOTS = 128
#: Rows and bytes of a tile at most, anchors of a group, tiles that a task joins with a group on average.
TILE, TILE_BYTES, GROUP, TILES_PER_TASK = 2048, 1 << 20, 512, 16
#: Share of M by which distances may be off.
MARGIN = 1e-6

_PLACED_DDL = "vec_id long, label string, vector array<double>, is_anchor boolean, dim int, cell int, dist double, norm2 double"
_PLACED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("vector", pa.list_(pa.float64())), ("is_anchor", pa.bool_()), ("dim", pa.int32()), ("cell", pa.int32()), ("dist", pa.float64()), ("norm2", pa.float64())])
_TILE_DDL = "dim int, cell int, near double, far double, ids binary, labels array<string>, numbers binary, largest double"
_TILE = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("near", pa.float64()), ("far", pa.float64()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("numbers", pa.binary()), ("largest", pa.float64())])
_FOUND_DDL = "anchor_id long, slot int, score long, vec_id long"
_FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64())])


def _sizes(scale: int):
    """Per batch and length: the largest component, and the largest norm in units of it."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            peaks, norms = [], []
            for _, _, rows in by_length(batch.column(0)):
                rows = scaled(rows, scale)
                peak = float(np.abs(rows).max(initial=0)) or 1.0
                peaks.append(peak)
                norms.append(peak * float(np.sqrt(((rows / peak) ** 2).sum(axis=1).max(initial=0))))
            yield pa.RecordBatch.from_arrays([pa.array(peaks, pa.float64()), pa.array(norms, pa.float64())], names=["peak", "norm"])

    return run


class Cells:
    """Pivots by length, numbered along a chain of neighbours, in units of the largest norm."""

    def __init__(self, sample: list[list[float]], scale: int, unit: float) -> None:
        self.scale, self.unit, self.pivots = scale, unit, {}
        for dim in {len(v) for v in sample}:
            rows = np.unique(scaled(np.array([v for v in sample if len(v) == dim], dtype=np.float64).reshape(-1, dim), scale), axis=0)
            at, left, order = 0, set(range(1, len(rows))), [0]
            points = self.augmented(rows)
            while left:
                at = min(left, key=lambda j: (float(((points[at] - points[j]) ** 2).sum()), j))
                order.append(at)
                left.remove(at)
            self.pivots[dim] = points[order]

    def augmented(self, rows: np.ndarray, anchors: bool = False) -> np.ndarray:
        rows = rows / self.unit
        rest = np.zeros(len(rows)) if anchors else np.sqrt(np.maximum(0, 1 - (rows**2).sum(axis=1)))
        return np.concatenate([rows, rest[:, None]], axis=1)

    def of(self, dim: int) -> np.ndarray:
        return self.pivots.get(dim, np.eye(1, dim + 1, dim))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pivots = self.of(points.shape[1] - 1)
        square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
        cell = square.argmin(axis=1)
        return cell, np.sqrt(((points - pivots[cell]) ** 2).sum(axis=1))

    def gaps(self, spark) -> DataFrame:
        """dim, cell, other, gap: distances between pivots of a length, both ways; a bounded table."""
        rows = [(int(dim), i, j, float(np.sqrt(((a - b) ** 2).sum()))) for dim, p in self.pivots.items() for i, a in enumerate(p) for j, b in enumerate(p)]
        return spark.createDataFrame(rows, "dim int, cell int, other int, gap double")


def _place(cells: Cells):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            is_anchor = batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            dims, cell, dist, norm2 = np.zeros(len(is_anchor), int), np.zeros(len(is_anchor), int), np.zeros(len(is_anchor)), np.zeros(len(is_anchor))
            for dim, at, rows in by_length(batch.column(2)):
                numbers = scaled(rows, cells.scale)
                dims[at], norm2[at] = dim, ((numbers / cells.unit) ** 2).sum(axis=1)
                for anchors in (False, True):
                    own = is_anchor[at] == anchors
                    cell[at[own]], dist[at[own]] = cells.nearest(cells.augmented(numbers[own], anchors))
            more = [pa.array(x, f.type) for x, f in zip((dims, cell, dist, norm2), list(_PLACED)[4:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=_PLACED)

    return run


def _pack(scale: int, most: int):
    """Sorted rows as tiles, each of one length and cell."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def tile() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            numbers = scaled(np.array([r[2] for r in rows], dtype=np.float64).reshape(len(rows), -1), scale)
            dist = [r[5] for r in rows]
            values = (rows[0][3], rows[0][4], min(dist), max(dist), np.array([r[0] for r in rows], "<i8").tobytes(), [r[1] for r in rows], numbers.astype("<f8").tobytes(), float(np.abs(numbers).max(initial=0)))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _TILE, strict=True)], schema=_TILE)

        for batch in source:
            ids, labels, dims, cell, dist = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("vec_id", "label", "dim", "cell", "dist"))
            vectors = batch.column(batch.schema.get_field_index("vector"))
            for i in range(batch.num_rows):
                if rows and (len(rows) >= max(1, min(most, TILE_BYTES // (8 * max(1, rows[0][3])))) or rows[0][3:5] != (dims[i], cell[i])):
                    yield tile()
                    rows = []
                rows.append((ids[i], labels[i], vectors[i].values.to_numpy(zero_copy_only=False), dims[i], cell[i], dist[i]))
        if rows:
            yield tile()

    return run


def _local(k: int, scale: int, same: bool):
    """A group's anchors with some tiles: the best k of each window of each anchor, with the same label or another."""

    def run(key: tuple, anchors: pa.Table, tiles: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        ids, codes = anchors.column("anchor_id").to_numpy(), {}
        coded = lambda column: np.array([codes.setdefault(x, len(codes)) for x in column], dtype=np.int64)
        labels = coded(anchors.column("label").to_pylist())
        windows = anchors.column("windows").to_pylist()
        slots = max(map(len, windows), default=0)
        # Windows in columns; an anchor with fewer has some that nothing fits.
        edge = lambda name, empty: np.array([[w[i][name] if i < len(w) else empty for i in range(slots)] for w in windows], dtype=np.int64).reshape(len(ids), slots)
        low, high = edge("low", 1), edge("high", 0)
        by_dim = {dim: (at, scaled(rows, scale)) for dim, at, rows in by_length(anchors.column("vector").combine_chunks())}
        for t in range(tiles.num_rows):
            dim, largest = tiles.column("dim")[t].as_py(), tiles.column("largest")[t].as_py()
            if dim not in by_dim:
                continue
            at, rows = by_dim[dim]
            own = np.frombuffer(tiles.column("ids")[t].as_buffer(), "<i8")
            numbers = np.frombuffer(tiles.column("numbers")[t].as_buffer(), "<f8").reshape(len(own), dim)
            scores = products(rows, numbers, max(largest, float(np.abs(rows).max(initial=0))))
            theirs = coded(tiles.column("labels")[t].as_py())
            allowed = ((labels[at][:, None] == theirs[None, :]) == same) & (ids[at][:, None] != own[None, :])
            for slot in range(slots):
                fits = allowed & (scores >= low[at, slot][:, None]) & (scores <= high[at, slot][:, None])
                r, c = candidates(scores, fits, k)
                if len(r):
                    found.append((at[r] * slots + slot, scores[r, c], own[c]))
            if len(found) >= 32:
                found = [best(*map(np.concatenate, zip(*found, strict=True)), k)]
        rows, scores, vec_ids = best(*map(np.concatenate, zip(*found, strict=True)), k) if found else [np.zeros(0, np.int64)] * 3
        at, slot = np.divmod(rows, max(1, slots))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip((ids[at] if len(at) else at, slot, scores, vec_ids), _FOUND, strict=True)], schema=_FOUND)

    return run


def _rings(cells: DataFrame, gaps: DataFrame) -> DataFrame:
    """For (group, dim, cell, reach, limit, from): group, dim, other cell, and the ring of it that may serve, from near to far.

    A partner lies within ``limit`` of an anchor and not within ``from``; an anchor lies within ``reach`` of its pivot.
    """
    # Lengths without pivots have one cell; the table of gaps is bounded.
    other = cells.join(F.broadcast(gaps), ["dim", "cell"], "left").withColumn("other", F.coalesce("other", "cell")).withColumn("gap", F.coalesce("gap", F.lit(0.0)))
    far = F.col("gap") + F.col("reach") + F.col("limit") + MARGIN
    # Nearer than either: the pivot is too far for the limit, or all of the ring lies within ``from``.
    near = F.greatest(F.col("gap") - F.col("reach") - F.col("limit"), F.col("from") - F.col("gap") - F.col("reach")) - MARGIN
    return other.select("group", "dim", "other", near.alias("from_near"), far.alias("to_far"))


class Join:
    """Tiles and anchor groups of a table, and exact joins between the ones that may serve each other."""

    def __init__(self, rows: DataFrame, scale: int, tile: int = TILE, group: int = GROUP) -> None:
        self.spark, self.scale = rows.sparkSession, scale
        peak = rows.select("vector").mapInArrow(_sizes(scale), "peak double, norm double").agg(F.max("norm")).first()[0]
        sample = rows.orderBy(F.xxhash64("vector"), "vec_id").limit(PIVOTS).select("vector").collect()
        self.cells = Cells([r[0] for r in sample], scale, peak or 1.0)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = [F.col(c) for c in ("dim", "cell", "dist", "vec_id", "label")]
        # All rows are candidates; anchors are placed once more, without the norm.
        every = rows.withColumn("is_anchor", F.lit(False)).mapInArrow(_place(self.cells), _PLACED_DDL)
        packed = every.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pack(scale, tile), _TILE_DDL)
        self.tiles = written(packed.withColumn("tile", F.monotonically_increasing_id()), "negatives-tiles")
        own = rows.filter("is_anchor").groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("x")).select("vec_id", "x.label", "x.vector", F.lit(True).alias("is_anchor"))
        placed = in_order(own.mapInArrow(_place(self.cells), _PLACED_DDL), order, "negatives-anchors")
        self.anchors = placed.select(F.floor(F.col("nth") / group).alias("group"), F.col("vec_id").alias("anchor_id"), "label", "vector", "dim", "cell", "dist", "norm2")
        self.gaps = self.cells.gaps(self.spark)
        self.slices = max(1, -(-self.tiles.count() // TILES_PER_TASK))
        self.kept = [self.tiles, placed]

    def home(self) -> DataFrame:
        """(group, tile): a group with the tiles of its own cells."""
        return self.anchors.select("group", "dim", "cell").distinct().join(self.tiles.select("dim", "cell", "tile"), ["dim", "cell"]).select("group", "tile")

    def others(self, limits: DataFrame) -> DataFrame:
        """(group, tile) that may hold partners, the home ones left out; ``limits``: anchor_id, furthest and nearest score."""
        unit = self.cells.unit
        # Saturated scores tell nothing about distances.
        square = lambda c: F.col("norm2") + 1 - F.col(c).cast("double") / unit * (2 / unit)
        limit = F.when(F.col("furthest") > LEAST_SCORE, F.sqrt(F.greatest(F.lit(0.0), square("furthest")))).otherwise(F.lit(float("inf")))
        start = F.when(F.col("nearest") < MOST_SCORE, F.sqrt(F.greatest(F.lit(0.0), square("nearest")))).otherwise(F.lit(0.0))
        bounds = self.anchors.join(limits, "anchor_id").groupBy("group", "dim", "cell").agg(F.max("dist").alias("reach"), F.max(limit).alias("limit"), F.min(start).alias("from"))
        rings = _rings(bounds, self.gaps)
        meta = self.tiles.select("dim", F.col("cell").alias("other"), "near", "far", "tile")
        some = rings.join(meta, ["dim", "other"]).filter("far >= from_near and near <= to_far").select("group", "tile").distinct()
        return some.join(self.home(), ["group", "tile"], "left_anti")

    def joined(self, pairs: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """The best k of each anchor and window, over the tiles paired with its group: anchor_id, slot, score, vec_id."""
        pairs = written(pairs.withColumn("slice", F.pmod(F.xxhash64("tile"), F.lit(self.slices)).cast("int")), "negatives-pairs")
        self.kept.append(pairs)
        left = self.anchors.join(windows, "anchor_id").join(pairs.select("group", "slice").distinct(), "group")
        right = pairs.join(self.tiles, "tile").select(F.col("group").alias("with_group"), F.col("slice").alias("with_slice"), "dim", "ids", "labels", "numbers", "largest")
        parts = left.select("group", "slice", "anchor_id", "label", "vector", "windows").groupBy("group", "slice")
        return parts.cogroup(right.groupBy("with_group", "with_slice")).applyInArrow(_local(k, self.scale, same), _FOUND_DDL)


def _kept(found: DataFrame, k: int) -> DataFrame:
    """Lists of all tasks merged: anchor_id, slot, best (array of negated score and id, in order)."""
    # The complement of a 64-bit number reverses the order without leaving the range.
    ordered = F.array_sort(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), "vec_id")))
    return found.groupBy("anchor_id", "slot").agg(F.slice(ordered, 1, k).alias("best"))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, tile: int = TILE, group: int = GROUP) -> DataFrame:
    """For each anchor and positive its hardest negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    label = named("label") if label is None else label
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), named(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector"))).withColumn("vector", F.col("vector").cast("array<double>"))
    join = Join(rows, scale, tile, group)
    window = lambda lo, hi: F.struct(lo.cast("long").alias("low"), hi.cast("long").alias("high"))
    whole = (F.lit(LEAST_SCORE), F.lit(MOST_SCORE))

    # Positives: what an anchor finds at home limits what else it needs.
    names = join.anchors.select("anchor_id")
    at_home = written(join.joined(join.home(), names.withColumn("windows", F.array(window(*whole))), positives, True), "negatives-home")
    kth = lambda c, k: F.when(F.size(c) >= k, F.bitwise_not(F.element_at(c, k)["s"]))
    limits = written(names.join(_kept(at_home, positives), "anchor_id", "left").select("anchor_id", F.coalesce(kth(F.col("best"), positives), whole[0]).alias("furthest"), whole[1].alias("nearest")), "negatives-limits")
    rest = join.joined(join.others(limits), limits.select("anchor_id", F.array(window(F.col("furthest"), whole[1])).alias("windows")), positives, True)
    chosen = _kept(at_home.unionByName(rest), positives).select("anchor_id", F.posexplode("best").alias("slot", "b"))
    positive = F.bitwise_not(F.col("b.s"))
    # Decimals, so that no product leaves its range.
    part = lambda percent: positive.cast("decimal(38,0)") * percent
    chosen = chosen.select("anchor_id", "slot", F.col("b.vec_id").alias("positive_id"), positive.alias("positive_score"), _rounded(part(low), True).alias("low"), _rounded(part(high), False).alias("high"))
    chosen = written(chosen, "negatives-positives")

    # Negatives: the same, with a window of scores for each positive.
    slots = lambda df, lo: df.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", lo.cast("long").alias("low"), "high"))), lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("windows"))
    near_home = written(join.joined(join.home(), slots(chosen, F.col("low")), negatives, False), "negatives-near")
    limited = chosen.join(_kept(near_home, negatives), ["anchor_id", "slot"], "left").withColumn("furthest", F.coalesce(kth(F.col("best"), negatives), F.col("low"))).drop("best")
    limited = written(limited, "negatives-windows")
    open_ = limited.filter("low <= high").groupBy("anchor_id").agg(F.min("furthest").alias("furthest"), F.max("high").alias("nearest"))
    rest = join.joined(join.others(open_), slots(limited, F.col("furthest")), negatives, False)
    merged = _kept(near_home.unionByName(rest), negatives)
    out = chosen.join(merged, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("place", "b"))
    out = written(out.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("b.vec_id").alias("negative_id"), "positive_score", F.bitwise_not(F.col("b.s")).alias("negative_score")), "negatives")
    discard(*join.kept, at_home, limits, chosen, near_home, limited)
    return out


def _rounded(hundredfold: Column, up: bool) -> Column:
    """A hundredth of a decimal as a long, rounded up or down; without a quotient that could be rounded first."""
    rest = F.pmod(hundredfold, F.lit(100))
    whole = ((hundredfold - rest) / 100).cast("decimal(38,0)")
    return (whole + F.when(rest > 0, 1).otherwise(0) if up else whole).cast("long")


def relabelled(every: int = RELABEL_EVERY, labels: int = LABELS) -> Column:
    return F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % ANCHOR_EVERY == 0, label=relabelled())


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id AS vec_id, c.label AS label, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM v a, v c WHERE a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.e) = len(c.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.own AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
