"""Hard negatives and near-duplicate embeddings against all pairs, on structured, skewed and awkward vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumspark.llm import hard_negatives, near_embeddings, tiles

DDL = "vec_id long, embedding array<double>, label int"


def clustered(seed, n, dim, spread=0.05, labels=3):
    """Vectors around a few centres; a third are copies of one."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, dim))
    rows = centres[draw.integers(0, 6, n)] + spread * draw.normal(size=(n, dim))
    rows[: n // 3] = rows[0]
    return [(int(i), [float(np.float32(x)) for x in r], int(draw.integers(0, labels))) for i, r in enumerate(draw.permutation(rows))]


AWKWARD = [
    (9001, None, 1), (9002, [None, 1.0, 2.0], 1), (9003, [math.nan, 0.0, 1.0], 1), (9004, [math.inf, 0.0, 1.0], 2), (9005, [0.0, -0.0, 0.0], 1), (9006, [1.0, 2.0], 1), (9000, [1.0, 2.1], 1), (9008, [1.0, 2.0], 0),
    (9009, [], 1), (None, [1.0, 0.0, 0.0], 1), (9010, [1.0, 0.0, 0.0], None), (9011, [1e9, -1e9, 3e8], 1), (9100, [1e9, 1e9, 1e9], 1), (9012, [1e300, -1e300, 0.0], 0), (9013, [1e-300, 1e-300, 0.0], 0), (9200, [1e308, 1.0, 1.0], 1),
    (9014, [2e9, -2e9, 6e8], 1), (9015, [0.5, 0.5, 0.5], 2), (9015, [0.5, 0.5, 0.5], 2), (9300, [0.5, 0.5, 0.4], 2), (9300, [0.5, 0.4, 0.4], 1),
]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# --- 12 ------------------------------------------------------------------------------------------------------


def plain_negatives(rows, every=100, k_pos=5, k_neg=10, low=30, high=90):
    number = lambda x: int(max(-tiles.MOST_NUMBER, min(tiles.MOST_NUMBER, np.floor(np.float64(256) * x))))
    with np.errstate(over="ignore"):
        rows = [(i, lab, [number(x) for x in v], v) for i, v, lab in rows if i is not None and lab is not None and usable(v)]
    anchors = {}
    for i, lab, e, v in rows:
        if i % every == 0 and (i not in anchors or (v, str(lab)) < anchors[i][2:]):
            anchors[i] = (lab, e, v, str(lab))
    out = []
    for a, (lab, e, *_) in anchors.items():
        scored = [(min(max(sum(x * y for x, y in zip(e, f, strict=True)), tiles.LEAST_SCORE), tiles.MOST_SCORE), i, m) for i, m, f, _ in rows if i != a and len(f) == len(e)]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for p, i, _ in [r for r in scored if r[2] == lab][:k_pos]:
            fits = [r for r in scored if r[2] != lab and low * p <= 100 * r[0] <= high * p][:k_neg]
            out += [(a, i, rank + 1, j, p, s) for rank, (s, j, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dim", "spread"), [(900, 8, 0.02), (700, 3, 0.3)])
def test_negatives_in_clusters(spark, n, dim, spread):
    rows = clustered(n, n, dim, spread) + [r for r in AWKWARD if dim == 3]
    table = spark.createDataFrame(rows, DDL).withColumns({c: F.lit(1) for c in ("group", "tile", "dim", "cell", "score", "slot")}).repartition(3)
    got = hard_negatives.mine(table, F.col("vec_id") % 50 == 0, tile=32, group=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, 50)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_bounds_leave_rings_out(spark):
    rows = clustered(5, 900, 8, 0.01)
    vectors = spark.createDataFrame(rows, DDL).select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 90 == 0).alias("is_anchor"))
    join = hard_negatives.Join(vectors, 256, 16, 1)
    limits = join.anchors.select("anchor_id", F.col("norm2"), "cell")
    # A limit of what lies as near as the anchor's own cluster: other clusters' tiles can't serve.
    found = join.joined(join.home(), limits.select("anchor_id", F.array(F.struct(F.lit(tiles.LEAST_SCORE).alias("low"), F.lit(tiles.MOST_SCORE).alias("high"))).alias("windows")), 5, True)
    worst = found.groupBy("anchor_id").agg(F.min("score").alias("furthest"), F.lit(tiles.MOST_SCORE).alias("nearest"))
    every = join.tiles.count() * join.anchors.select("group").distinct().count()
    assert join.others(worst).count() + join.home().count() < 0.7 * every


def test_negatives_of_nothing(spark):
    none = spark.createDataFrame([], DDL)
    assert hard_negatives.mine(none, F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, None, None), (2, [3.0], 1)], DDL)
    assert hard_negatives.mine(alone, F.col("vec_id") % 100 == 0).collect() == []


def test_hundredths_are_rounded_exactly(spark):
    values = [0, 1, -1, 7, 33, 10**18, tiles.MOST_SCORE, tiles.LEAST_SCORE]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    product = F.col("v").cast("decimal(38,0)") * 90
    got = df.select("v", hard_negatives._rounded(product, True).alias("up"), hard_negatives._rounded(product, False).alias("down")).collect()
    assert [(r.up, r.down) for r in got] == [(-(-90 * v // 100), 90 * v // 100) for v in values]


# --- 13 ------------------------------------------------------------------------------------------------------


def plain_links(rows, least=0.95):
    def unit(v):
        top = max(map(abs, v), default=0) if usable(v) else 0
        return np.array(v) / top / np.linalg.norm(np.array(v) / top) if top else None

    vectors = [unit(v) for _, v, _ in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(vectors):
        for j in range(i):
            b = vectors[j]
            if a is not None and b is not None and len(a) == len(b) and (rows[i][1] == rows[j][1] or float(a @ b) >= least):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    ids = {}
    for i, (vec_id, _, _) in enumerate(rows):
        r = root(i)
        ids[r] = vec_id if ids.get(r) is None else ids[r] if vec_id is None else min(vec_id, ids[r])
    return [(r[0], links[i], ids[root(i)], r[0] == ids[root(i)]) for i, r in enumerate(rows)]


@pytest.mark.parametrize(("n", "dim", "spread", "bytes_"), [(1500, 8, 0.1, 4096), (700, 3, 0.4, 1 << 20), (900, 20, 0.15, 1 << 16)])
def test_links_in_clusters(spark, n, dim, spread, bytes_):
    rows = clustered(n + 1, n, dim, spread) + AWKWARD + [(100_000 + i, [math.cos(i / 10), math.sin(i / 10)], 0) for i in range(40)]
    table = spark.createDataFrame(rows, DDL).withColumns({c: F.lit(1) for c in ("number", "one", "two", "links", "dim", "nth", "root")}).repartition(3)
    got = near_embeddings.near_duplicates(table, group_bytes=bytes_)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_links(rows), key=key)


def test_links_of_nothing(spark):
    assert near_embeddings.near_duplicates(spark.createDataFrame([], DDL)).collect() == []
    assert [tuple(r) for r in near_embeddings.near_duplicates(spark.createDataFrame([(3, None, 1)], DDL)).collect()] == [(3, 0, 3, True)]


def test_forest_connects_what_links_connect():
    draw = random.Random(4)
    for density in (0.002, 0.02, 0.5, 1.0):
        links = np.array([[draw.random() < density for _ in range(60)] for _ in range(50)])
        full, some = near_embeddings._Sets(), near_embeddings._Sets()
        for r, c in zip(*np.nonzero(links), strict=True):
            full.join(int(r), 100 + int(c))
        edges = near_embeddings.forest(links)
        assert len(edges) <= 110 and all(links[r, c] for r, c in edges)
        for r, c in edges:
            some.join(r, 100 + c)
        assert {x: full.root(x) for x in full.up} == {x: some.root(x) for x in full.up}


def test_boxes_far_apart_are_skipped(spark):
    grid = near_embeddings.Grid([[1.0, 0.0], [0.0, 1.0], [0.7, 0.7]], 0.95)
    assert math.isclose(grid.width, math.sqrt(0.1))
    line = [(i, [math.cos(i / 100), math.sin(i / 100)], 0) for i in range(300)]
    rows = spark.createDataFrame([(0, float(math.cos(i / 100)), 2, i) for i in range(64)], "x int, low0 double, dim int, nth long")
    ends = [F.array(F.col("low0"), *[F.lit(0.0)] * (near_embeddings.LEADING - 1)).alias(c) for c in ("low", "high")]
    assert near_embeddings._pairs(rows.select("nth", "dim", *ends), 64, 0.999999).count() < 64 * 65 // 2
    assert all(r.n_links > 0 for r in near_embeddings.near_duplicates(spark.createDataFrame(line, DDL)).collect())
