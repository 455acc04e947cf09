"""Importance resampling against a plain version, over several orders and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellumspark.llm import resampling
from vellumspark.llm.common import WORD_PATTERN


def words(text):
    return re.findall(WORD_PATTERN, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, target, orders, n, least, percent, seed):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, orders + 1) for i in range(len(w) - k + 1)]

    s, t = (Counter(b for text in texts for b in features(text)) for texts in ([x for _, x in docs], target))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + n) / ((s[b] + 1) * (T + n))))
    out = []
    for doc, text in docs:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r, ranks.get(id(r))) for r in out]


DDL = "doc_id long, text string"


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_against_a_plain_version(spark, orders):
    draw = random.Random(orders)
    text = lambda: " ".join(draw.choice(["alpha", "Beta", "é", "x1", "gamma-delta", "'", "中"]) for _ in range(draw.randrange(9)))
    docs = [(i, text()) for i in range(150)] + [(7, None), (8, ""), (None, "alpha beta"), (None, None), (9, "alpha " * 30_000)]
    docs += [(200, "same text here")] * 5
    target = [text() for _ in range(20)] + [None, ""]
    table = spark.createDataFrame(docs, DDL).withColumns({c: F.lit(1) for c in ("row", "word", "place", "bucket", "gain", "score", "rank", "n", "part")})
    got = resampling.resample(table.repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), orders, 50, 2, 40, 5)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got, want = [tuple(r) for r in got.collect()], plain(docs, target, orders, 50, 2, 40, 5)
    # Which of equal rows has which of their ranks is open.
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(r[5] for r in got if r[5]) == list(range(1, len([r for r in want if r[5]]) + 1))


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], DDL), spark.createDataFrame([(1, "a b c"), (2, None)], DDL)
    assert resampling.resample(none, some).collect() == []
    got = sorted(map(tuple, resampling.resample(some, none, least_words=1, percent=100).collect()))
    assert got == sorted(plain([(1, "a b c"), (2, None)], [], 1, resampling.BUCKETS, 1, 100, resampling.SEED))


def test_words_are_only_shuffled_for_higher_orders(spark):
    docs = spark.createDataFrame([(1, "a b c")], DDL)
    plan = lambda orders: resampling.counts(docs, orders)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(1) and "lead" in plan(2)
