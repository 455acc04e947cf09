"""Locating terms and passages on pages: word boxes, highlights, the most similar sentence, and what was not found.

Defined results: no terms give no marks; a null page or target has no sentence; pages without words or without a box have
no marks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Least ratio of a passage, least lengths of what is sought and of a sentence, and where sentences end.
SIMILARITY, LEAST_TARGET, LEAST_SENTENCE, SENTENCE_END = 0.55, 15, 25, r"(?<=[.;!?])\s+|\n"
#: Colours of highlights.
COLOURS = {"keyword": "ffe066", "evidencia": "8ce99a", "limitacao": "ffc078"}

def page_words(words: DataFrame) -> DataFrame:
    """(doc_id, page, norm, words): folded words of a page joined by line ends, each with its box.

    A word's own white space becomes blanks, so line ends part words alone.
    """
    rows = words.withColumn("norm", F.regexp_replace(T.fold("text"), f"(?U){T.SPACE}", " "))
    listed = F.array_sort(F.collect_list(F.struct("idx", "norm", "x0", "x1", "top", "bottom")))
    return rows.groupBy("doc_id", "page").agg(listed.alias("words")).withColumn("norm", F.array_join("words.norm", "\n"))


def _line_ends(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def word_spans(norm: Column, pattern: str) -> Column:
    """Numbers of the first and last word of all matches: array<struct<first:int,last:int>>.

    Words are counted by the line ends of matches and of what stands between, once for all matches: the time doesn't grow
    with the product of both. Matches begin and end within words.
    """

    def counted(matches: Column) -> Column:
        gaps = F.slice(F.split(norm, pattern, -1), 1, F.size(matches))
        last = T.running_sums(F.zip_with(matches, gaps, lambda m, g: _line_ends(m) + _line_ends(g)))
        spans = F.zip_with(matches, last, lambda m, n: F.struct((n - _line_ends(m)).alias("first"), n.alias("last")))
        return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast("array<struct<first:int,last:int>>"))

    return T.let(F.regexp_extract_all(norm, F.lit(pattern), F.lit(0)), counted)


def _words_of(span: Column) -> Column:
    return F.slice(F.col("words"), span["first"] + 1, span["last"] - span["first"] + 1)


def boxes(words: Column, height: Column, left: Column, base: Column) -> Column:
    """A box for each line of a match, measured from the foot of the page: array<struct<x0,y0,x1,y1>>."""
    lines = F.array_distinct(F.transform(words, lambda w: F.bround(w["top"])))

    def box(line: Column) -> Column:
        own = F.filter(words, lambda w: F.bround(w["top"]) == line)
        least, most = lambda k: F.array_min(F.transform(own, lambda w: w[k])), lambda k: F.array_max(F.transform(own, lambda w: w[k]))
        return F.struct((least("x0") + left).alias("x0"), (height - most("bottom") + base).alias("y0"), (most("x1") + left).alias("x1"), (height - least("top") + base).alias("y1"))

    return F.transform(lines, box)


def quads(rects: Column) -> Column:
    """Corner points in the order upper left, upper right, lower left, lower right."""
    return F.flatten(F.transform(rects, lambda r: F.array(r["x0"], r["y1"], r["x1"], r["y1"], r["x0"], r["y0"], r["x1"], r["y0"])))


def bounds(rects: Column) -> Column:
    least, most = lambda k: F.array_min(F.transform(rects, lambda r: r[k])), lambda k: F.array_max(F.transform(rects, lambda r: r[k]))
    return F.struct(least("x0").alias("x0"), least("y0").alias("y0"), most("x1").alias("x1"), most("y1").alias("y1"))


def mark_terms(words: DataFrame, page_boxes: DataFrame, terms: list[str], flexible: bool = True) -> DataFrame:
    """(doc_id, page, category, comment, target, n, rects) for every occurrence of a term; n counts them on the page."""
    patterns = [(t, p) for t in terms if (p := T.keyword_pattern(t, flexible))]
    rows = page_words(words).join(page_boxes, ["doc_id", "page"])
    # Boxes are made from the page's row: what is exploded holds no words.
    marked = lambda p: F.transform(word_spans(F.col("norm"), p), lambda s: boxes(_words_of(s), F.col("height"), F.col("left"), F.col("bottom")))
    listed = F.array(*(F.struct(F.lit(t).alias("target"), marked(p).alias("found")) for t, p in patterns))
    kind = "array<struct<target:string,found:array<array<struct<x0:double,y0:double,x1:double,y1:double>>>>>"
    hits = rows.select("doc_id", "page", F.explode(listed.cast(kind)).alias("hit")).select("doc_id", "page", F.col("hit.target").alias("target"), F.posexplode("hit.found").alias("n", "rects"))
    return hits.select("doc_id", "page", F.lit("keyword").alias("category"), F.concat(F.lit("Keyword: "), "target").alias("comment"), "target", "n", "rects")


def best_sentence(page: str | None, target: str | None, least: float = SIMILARITY) -> tuple[str | None, float]:
    """The sentence of a page most like the target, the first among equals, and its ratio; none below the least ratio."""
    wanted = re.sub(r"\s+", " ", target or "").strip()
    if len(wanted) < LEAST_TARGET or not page:
        return None, 0.0
    # Bounds of the ratio are cheaper than the ratio: what cannot be better than the best so far is left out.
    match, ratio, best = SequenceMatcher(None, "", T.fold_text(wanted)), 0.0, None
    for sentence in map(str.strip, re.split(SENTENCE_END, page)):
        if len(sentence) > LEAST_SENTENCE:
            match.set_seq1(T.fold_text(sentence))
            if match.real_quick_ratio() > ratio and match.quick_ratio() > ratio and (now := match.ratio()) > ratio:
                ratio, best = now, sentence
    return (best, ratio) if best is not None and ratio >= least else (None, ratio)


def _best(least: float):
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pages, targets in parts:
            yield pd.DataFrame([best_sentence(p, t, least) for p, t in zip(pages, targets, strict=True)], columns=["sentence", "ratio"])

    return F.pandas_udf(run, "sentence string, ratio double")


def fuzzy(pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Adds sentence and ratio to rows with page_text and target."""
    return pairs.withColumn("best", _best(least)("page_text", "target")).withColumn("sentence", F.col("best.sentence")).withColumn("ratio", F.col("best.ratio")).drop("best")


def targets(keywords: list[str], results: DataFrame, findings: DataFrame, limitations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms (doc_id, position, term) and passages (doc_id, pages, target, comment, category) to mark.

    Given keywords come before analysed ones; of terms that agree in lower case the first stays. Findings count with
    evidence, on the pages of their label; limitations on any page.
    """
    docs = results.select("doc_id").union(findings.select("doc_id")).union(limitations.select("doc_id")).distinct()
    given = F.array(*(F.struct(F.lit(i - len(keywords)).alias("position"), F.lit(k).alias("term")) for i, k in enumerate(keywords))) if keywords else F.array().cast("array<struct<position:int,term:string>>")
    terms = docs.select("doc_id", F.explode(given).alias("t")).select("doc_id", "t.position", "t.term").unionByName(results.select("doc_id", "position", F.col("keyword").alias("term")))
    place = F.row_number().over(Window.partitionBy("doc_id", F.lower("term")).orderBy("position"))
    terms = terms.filter(T.strip(F.col("term")) != "").withColumn("place", place).filter("place = 1").drop("place")
    evidence = findings.filter(F.coalesce("evidence", F.lit("")) != "").select("doc_id", T.label_pages(F.coalesce("page_label", F.lit(""))).alias("pages"), F.col("evidence").alias("target"), F.concat(F.lit("Achado: "), F.col("claim")).alias("comment"), F.lit("evidencia").alias("category"))
    limits = limitations.select("doc_id", F.lit(None).cast("array<int>").alias("pages"), F.col("text").alias("target"), F.lit("Limitacao apontada na analise").alias("comment"), F.lit("limitacao").alias("category"))
    return terms, evidence.unionByName(limits)


def mark_passages(words: DataFrame, page_boxes: DataFrame, page_texts: DataFrame, passages: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, page, category, comment, target, rects): each passage once at most on a page, at its most similar sentence."""
    rows = page_texts.join(passages, "doc_id").filter(F.col("pages").isNull() | F.array_contains("pages", F.col("page").cast("int")))
    rows = fuzzy(rows.withColumnRenamed("text", "page_text"), least).filter("sentence is not null")
    rows = rows.withColumn("wanted", T.fold("sentence")).join(page_words(words), ["doc_id", "page"]).join(page_boxes, ["doc_id", "page"])
    at = F.instr(F.replace("norm", F.lit("\n"), F.lit(" ")), F.col("wanted")) - 1
    upto = lambda n: _line_ends(F.left("norm", n))
    # A sentence that ends in a word, not before it.
    found = _words_of(F.struct(upto(at).alias("first"), upto(at + F.length(F.rtrim("wanted"))).alias("last")))
    return rows.filter(at >= 0).select("doc_id", "page", "category", "comment", "target", boxes(found, F.col("height"), F.col("left"), F.col("bottom")).alias("rects"))


def not_located(wanted: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, target) of targets without a mark."""
    return wanted.join(marks.select("doc_id", "target").distinct(), ["doc_id", "target"], "left_anti")


def by_category(marks: DataFrame) -> DataFrame:
    return marks.groupBy("doc_id", "category").agg(F.count("*").cast("int").alias("n"))


def annotations(marks: DataFrame) -> DataFrame:
    """Marks as highlight annotations: bounding box, corner points, colour and comment."""
    colour = F.coalesce(F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))[F.col("category")], F.lit("ffff00"))
    return marks.select("doc_id", "page", "category", "comment", bounds(F.col("rects")).alias("rect"), quads(F.col("rects")).alias("quads"), colour.alias("colour"))
