"""Near-duplicate embeddings by an epsilon grid order join.

Vectors of norm one lie within eps = sqrt(2 - 2 c) of each other if and only if their cosine is at least c. They are
projected on their leading principal dimensions, sorted by the cells of a grid of width eps there, and cut into sequence
intervals: groups of bounded bytes, which hold blocks of a few hundred vectors. Intervals are joined recursively: of the
pair of the whole sequence with itself, each side is divided, and pairs whose boxes are further apart than eps are
skipped, level by level, down to pairs of groups (as joins of small tables) and pairs of blocks (in the tasks). Only there
vectors are multiplied: in single precision, and once more in double precision near the threshold.

Links are never listed. A pair of groups gives for each vector the number of its partners and, for connectivity, the
edges of a spanning forest: at most as many as vectors. Exact copies are one vector with a weight before anything else,
so a vector that holds a third of all rows costs no product; near copies lie in consecutive blocks and are counted by
products of blocks.

The principal dimensions are those of a bounded sample by hash. They decide what is skipped, never what is found: any
orthonormal directions give a valid bound. Lengths that the sample lacks use their first components.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
component; so do vectors of different lengths. Rows that repeat are vectors of their own, linked with each other.
``component_id`` is the smallest id of the component; a null id is the smallest of none but its own. ``kept`` is true for
each row that has its component's id, so rows that repeat an id are kept together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import counted, discard, named, table, written
from .tiles import by_length, finite

COSINE = 0.95
#: Leading dimensions that order and bound; vectors of the sample that they come from.
LEADING, SAMPLE = 16, 2000
#: Vectors of a block; bytes of a group; groups at least (for parallel work on small tables); intervals in one above.
BLOCK, GROUP_BYTES, LEAST_GROUPS, FAN = 256, 8 << 20, 16, 4
#: Distances to the threshold within which cosines are computed again; margin of squared distances between boxes.
UNSURE, MARGIN = 1e-5, 1e-9

_PLACED_DDL = "dim int, cells array<int>, number long, weight long, vector array<double>"
_PLACED = pa.schema([("dim", pa.int32()), ("cells", pa.list_(pa.int32())), ("number", pa.int64()), ("weight", pa.int64()), ("vector", pa.list_(pa.float64()))])
_GROUP_DDL = "dim int, low array<double>, high array<double>, numbers binary, weights binary, boxes binary, units binary"
_GROUP = pa.schema([("dim", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), *((c, pa.binary()) for c in ("numbers", "weights", "boxes", "units"))])
_FOUND_DDL = "number long, links long, other long"
_FOUND = pa.schema([("number", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def units(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their norms, without leaving the range of doubles on the way."""
    rows = rows / np.abs(rows).max(axis=1, initial=0)[:, None]
    return rows / np.sqrt((rows**2).sum(axis=1))[:, None]


class Grid:
    """Leading directions by length, and the cells of width eps along them."""

    def __init__(self, sample: list[list[float]], least: float) -> None:
        self.width, self.axes = max(float(np.sqrt(max(0.0, 2 - 2 * least))), 1e-6), {}
        for dim in {len(v) for v in sample}:
            rows = units(np.array([v for v in sample if len(v) == dim], dtype=np.float64))
            self.axes[dim] = np.linalg.svd(rows - rows.mean(axis=0), full_matrices=False)[2][:LEADING]

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Coordinates in the leading directions; zeros where a length has fewer."""
        dim = rows.shape[1]
        out = np.zeros((len(rows), LEADING))
        axes = self.axes.get(dim, np.eye(min(LEADING, dim), dim))
        out[:, : len(axes)] = rows @ axes.T
        return out


def _place(grid: Grid):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for dim, at, rows in by_length(batch.column(2)):
                cells = np.floor(grid.project(units(rows)) / grid.width).astype(np.int32)
                some = [c.take(pa.array(at)) for c in batch.columns]
                offsets = pa.array(np.arange(0, cells.size + 1, LEADING), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), dim), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel())), some[0], some[1], some[2]], schema=_PLACED)

    return run


def _pack(grid: Grid, most_bytes: int):
    """Sorted rows as groups of one length: numbers, weights, units, and a box for each block."""

    def group(dim: int, held: list[tuple]) -> pa.RecordBatch:
        numbers, weights, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        spots = grid.project(rows)
        boxes = np.array([[spots[i : i + BLOCK].min(axis=0), spots[i : i + BLOCK].max(axis=0)] for i in range(0, len(rows), BLOCK)])
        values = (dim, boxes[:, 0].min(axis=0).tolist(), boxes[:, 1].max(axis=0).tolist(), numbers.astype("<i8").tobytes(), weights.astype("<i8").tobytes(), boxes.astype("<f8").tobytes(), rows.astype("<f8").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _GROUP, strict=True)], schema=_GROUP)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, n = -1, 0
        for batch in source:
            for dim, at, rows in by_length(batch.column(3)):  # sorted by length
                for i in range(0, len(at), BLOCK):
                    part = at[i : i + BLOCK]
                    if held and (dim != last or (n + len(part)) * 8 * dim > most_bytes):
                        yield group(last, held)
                        held, n = [], 0
                    held.append((batch.column(1).to_numpy()[part], batch.column(2).to_numpy()[part], units(rows[i : i + BLOCK])))
                    last, n = dim, n + len(part)
        if held:
            yield group(last, held)

    return run


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the links of a block pair connect: a row with its columns, a column with its rows."""
    rows, columns = np.nonzero(links)
    if len(rows) <= sum(links.shape):
        return list(zip(rows.tolist(), columns.tolist(), strict=True))
    edges, left = [], links.any(axis=1)
    while left.any():
        seen, new = np.zeros(links.shape[1], bool), np.zeros(links.shape[0], bool)
        new[left.argmax()] = True
        while new.any():
            left &= ~new
            for r in np.flatnonzero(new):
                fresh = links[r] & ~seen
                edges += [(int(r), int(c)) for c in np.flatnonzero(fresh)]
                seen |= fresh
            reached = links[:, seen] & left[:, None]
            new = reached.any(axis=1)
            # Each newly reached row hangs on one column that is seen already.
            places = np.flatnonzero(seen)
            edges += [(int(r), int(places[reached[r].argmax()])) for r in np.flatnonzero(new)]
    return edges


class _Sets:
    """Union-find over numbers; remembers the edges that joined two sets."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = above
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, b))


class _Group:
    def __init__(self, rows: pa.Table, side: str) -> None:
        view = lambda c, kind: np.frombuffer(rows.column(f"{side}_{c}")[0].as_buffer(), kind)
        self.dim = rows.column(f"{side}_dim")[0].as_py()
        self.numbers, self.weights = view("numbers", "<i8"), view("weights", "<i8")
        self.units, self.boxes = view("units", "<f8").reshape(len(self.numbers), self.dim), view("boxes", "<f8").reshape(-1, 2, LEADING)
        self.single, self.links = self.units.astype(np.float32), np.zeros(len(self.numbers), np.int64)


def _links(a: np.ndarray, b: np.ndarray, single: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    cosine = single[0] @ single[1].T
    links = cosine >= least
    r, c = np.nonzero(np.abs(cosine - least) <= UNSURE)
    if len(r):
        links[r, c] = (a[r] * b[c]).sum(axis=1) >= least
    return links


def _join(least: float):
    """A pair of groups: numbers of links by vector, and edges of a spanning forest."""
    eps2 = 2 - 2 * least + MARGIN

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a = _Group(left, "a")
        # A group with itself comes once.
        b = _Group(right, "b") if right.num_rows else a
        sets, near, same = _Sets(), _near(a.boxes, b.boxes) <= eps2, a is b
        for i, j in zip(*np.nonzero(near if a.dim == b.dim else near[:0]), strict=True):
            if same and i > j:
                continue
            x, y = slice(i * BLOCK, (i + 1) * BLOCK), slice(j * BLOCK, (j + 1) * BLOCK)
            links = _links(a.units[x], b.units[y], (a.single[x], b.single[y]), least)
            if same and i == j:
                np.fill_diagonal(links, False)
            if not links.any():
                continue
            a.links[x] += links @ b.weights[y]
            if not (same and i == j):
                b.links[y] += a.weights[x] @ links
            for u, v in forest(links):
                sets.join(int(a.numbers[x][u]), int(b.numbers[y][v]))
        found = [_rows(g.numbers[some], links=g.links[some]) for g in {id(a): a, id(b): b}.values() for some in [np.flatnonzero(g.links)]]
        ends = np.array(sets.edges, np.int64).reshape(-1, 2)
        return pa.Table.from_batches([*found, _rows(ends[:, 0], others=ends[:, 1])])

    return run


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between boxes."""
    gap = np.maximum(0, np.maximum(a[:, None, 0] - b[None, :, 1], b[None, :, 0] - a[:, None, 1]))
    return (gap**2).sum(axis=2)


def _rows(numbers: np.ndarray, links: np.ndarray | None = None, others: np.ndarray | None = None) -> pa.RecordBatch:
    column = lambda x: pa.nulls(len(numbers), pa.int64()) if x is None else pa.array(x, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), column(links), column(others)], schema=_FOUND)


def _pairs(groups: DataFrame, n: int, least: float) -> DataFrame:
    """(a, b), a <= b: pairs of groups whose boxes may hold a link; found from the top interval down."""
    spark, shift = groups.sparkSession, FAN.bit_length() - 1
    levels = 0
    while n > FAN**levels:
        levels += 1
    boxes = groups.select("nth", "dim", *(F.col(c)[i].alias(f"{c}{i}") for c in ("low", "high") for i in range(LEADING)))
    pairs = written(spark.createDataFrame([(0, 0)], "a long, b long"), "near-pairs")
    for level in reversed(range(levels)):
        ends = [F.min("dim").alias("dim0"), F.max("dim").alias("dim1"), *(F.min(f"low{i}").alias(f"low{i}") for i in range(LEADING)), *(F.max(f"high{i}").alias(f"high{i}") for i in range(LEADING))]
        spans = boxes.groupBy(F.shiftright("nth", shift * level).alias("at")).agg(*ends)
        side = lambda x, spans=spans: spans.select(*(F.col(c).alias(f"{x}_{c}") for c in spans.columns))
        child = lambda c: F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: (F.shiftleft(c, shift) + i)))
        down = pairs.select(child("a").alias("a"), "b").select("a", child("b").alias("b")).filter("a <= b")
        down = down.join(side("a"), F.col("a") == F.col("a_at")).join(side("b"), F.col("b") == F.col("b_at"))
        gaps = [F.greatest(F.lit(0.0), F.col(f"a_low{i}") - F.col(f"b_high{i}"), F.col(f"b_low{i}") - F.col(f"a_high{i}")) for i in range(LEADING)]
        down = down.filter("a_dim0 <= b_dim1 and b_dim0 <= a_dim1").filter(sum(g * g for g in gaps) <= 2 - 2 * least + MARGIN)
        above, pairs = pairs, written(down.select("a", "b"), "near-pairs")
        discard(above)
    return pairs


def near_duplicates(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select(named(id_col).cast("long").alias("vec_id"), named(vector_col).cast("array<double>").alias("vector"))
    fits = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    # Two hashes make a class of equal vectors; 128 bits tell more vectors apart than there can be.
    one, two = F.xxhash64(F.lit(1), "vector").alias("one"), F.xxhash64("vector", F.lit(2)).alias("two")
    classes = rows.filter(fits).groupBy(one, two).agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("number", F.monotonically_increasing_id()), "near-classes")
    size = classes.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)) * 8).first()[0]
    sample = [r[0] for r in classes.orderBy(F.xxhash64("one", "two"), "number").limit(SAMPLE).select("vector").collect()]
    grid = Grid(sample, least)
    parts = max(LEAST_GROUPS, -(-size // group_bytes))
    placed = classes.select("number", "weight", "vector").mapInArrow(_place(grid), _PLACED_DDL)
    order = ["dim", "cells", "number"]
    packed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("dim", "number", "weight", "vector")
    groups = packed.mapInArrow(_pack(grid, group_bytes), _GROUP_DDL).withColumn("__at", F.monotonically_increasing_id())
    groups = counted(written(groups, "near-groups"))
    pairs = _pairs(groups.select("nth", "dim", "low", "high"), groups.count(), least)
    side = lambda x: groups.select(F.col("nth").alias(f"{x}_at"), *(F.col(c).alias(f"{x}_{c}") for c in ("dim", "numbers", "weights", "boxes", "units")))
    other = pairs.filter("a < b").select(F.col("a").alias("with_a"), F.col("b").alias("with_b")).join(side("b"), F.col("with_b") == F.col("b_at"))
    met = pairs.join(side("a"), F.col("a") == F.col("a_at")).groupBy("a", "b").cogroup(other.groupBy("with_a", "with_b"))
    found = written(met.applyInArrow(_join(least), _FOUND_DDL), "near-found")

    roots = graph.components(found.filter("other is not null").select(F.col("number").alias("u"), F.col("other").alias("v")))
    counts = found.filter("links is not null").groupBy("number").agg(F.sum("links").alias("links"))
    known = classes.select("one", "two", "number", "least", "weight").join(counts, "number", "left").join(roots.withColumnRenamed("node", "number"), "number", "left")
    known = written(known.withColumn("root", F.coalesce("root", "number")), "near-known")
    # Written, so that a component with very many vectors can be split among tasks.
    firsts = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "near-firsts")
    linked = known.join(firsts, "root").select("one", "two", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = written(linked, "near-linked")
    discard(classes, groups, pairs, found, known, firsts)
    some = rows.filter(fits).select("vec_id", one, two).join(linked, ["one", "two"]).select("vec_id", "n_links", "component_id")
    none = rows.filter(~F.coalesce(fits, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_near_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a, v b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.n > 0 AND b.n > 0 AND list_sum(list_transform(list_zip(a.e, b.e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / (a.n * b.n) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id
"""
