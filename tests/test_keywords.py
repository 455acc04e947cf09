"""Thousands of keywords in one automaton, against one pattern for each."""

import random
import time

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import keywords, model, scan

TEXTS = ["A Regressão logística; regressoes-logisticas, e regressão  linear. C++ e c++s, c# x", "dado dados dado-dado dado dado", "ﬁm de ½ dia, FIM", "", None, "viés\nviés-amostral VIES  AMOSTRAIS ã", "aa aa aa a a b", "_dado dado_ dado"]
WORDS = ["regressao logistica", "Regressão", "c++", "c#", "dado", "dado dado", "vies amostral", "viés", "fim", "1⁄2", "a a", "aa", "x", " ", "--", "linear.", "dia", "ã"]


@pytest.mark.parametrize("flexible", [True, False])
def test_as_with_a_pattern_for_each(spark, flexible):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, TEXTS[1]), (None, TEXTS[5])], "doc_id long, text string").withColumns({"keyword": F.lit("k"), "starts": F.lit(1)})
    table = spark.createDataFrame([(w,) for w in [*WORDS, None, "dado"]], "keyword string")
    paged = docs.withColumn("pages", F.array(F.struct(F.lit(1).alias("number"), F.lit(0).alias("start"), F.lit(30).alias("end")), F.struct(F.lit(2).alias("number"), F.lit(30).alias("start"), F.lit(99).alias("end")))).withColumn("sections", model.sections_of(F.col("text")))
    want = sorted((tuple(r) for r in scan.totals(docs, WORDS, flexible).filter("total > 0").select("doc_id", "keyword", "total", "density").collect()), key=repr)
    for size in (1 << 20, 30):
        got = keywords.totals(docs, table, flexible, group_bytes=size)
        assert sorted(map(tuple, got.collect()), key=repr) == [(d, k.strip(), t, x) for d, k, t, x in want]
    full = lambda df: sorted((str((r["doc_id"], r["keyword"], r["total"], r["pages"], r["occurrences"])) for r in df.filter("total > 0").collect()))
    assert full(keywords.occurrences(paged, table, flexible)) == full(scan.scan(paged, WORDS, flexible))
    assert keywords.totals(docs, table.filter("false")).count() == 0 and keywords.totals(docs.filter("false"), table).count() == 0


def test_time_does_not_follow_the_number_of_keywords(spark):
    draw = random.Random(2)
    vocabulary = ["".join(draw.choice("abcdefghij") for _ in range(7)) for _ in range(20_000)]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(20_000)) for _ in range(20)]

    def took(words):
        finder, best = keywords.Finder(words, False), 1e9
        for _ in range(2):
            began = time.perf_counter()
            n = sum(len(s) for t in texts for s in finder.found(t).values())
            best = min(best, time.perf_counter() - began)
        return best, n

    few, many = took(["zzzzzzz"] * 5), took([f"k{w}" for w in vocabulary[:2000]])
    assert many[1] == 0 and many[0] < 2 * few[0] + 0.5
    wanted = set(vocabulary[:2000])
    assert took(vocabulary[:2000])[1] == sum(w in wanted for t in texts for w in t.split())
