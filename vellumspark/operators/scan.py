"""Scan: literal keyword search over folded text, with pages, sections, snippets and density.

Text is folded once per document. Documents whose characters fold one to one are folded by native expressions; only the
others' text goes to an Arrow function, which also maps places back to the original.

Defined results: a null text is searched as an empty one; documents that repeat an id, or have none, are searched each
for itself; no keywords give no rows; other columns of the documents stay in ``search`` and, where named, in ``totals``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

LISTED, WINDOW = 40, 220


def folded(docs: DataFrame) -> DataFrame:
    """Adds norm and places (null where a character's place doesn't change)."""
    rows = docs.withColumn("slow", T.slow_fold(F.col("text")))
    return rows.withColumn("norm", F.coalesce("slow.norm", T.fold_simple(F.col("text")))).withColumn("places", F.col("slow.places")).drop("slow")


def _original(spans: Column) -> Column:
    """Places in the original text: of the first character, and one after that of the last."""
    back = lambda i: F.get("places", i)
    moved = F.transform(spans, lambda s: F.struct(back(s["start"]).alias("start"), (back(s["end"] - 1) + 1).alias("end")))
    return F.when(F.col("places").isNull(), spans).otherwise(moved)


def _patterns(keywords: list[str], flexible: bool) -> list[tuple[int, str, str]]:
    given = [k.strip() for k in keywords if k.strip()]
    return [(i, k, p) for i, k in enumerate(given) if (p := T.keyword_pattern(k, flexible))]


def _per_keyword(keywords: list[str], flexible: bool, name: str, kind: str, value) -> Column:
    """Explodes to structs of position, keyword and a value of the folded text, which is worked out once."""
    entries = lambda n: F.array(*(F.struct(F.lit(i).alias("position"), F.lit(k).alias("keyword"), value(n, p).alias(name)) for i, k, p in _patterns(keywords, flexible)))
    listed = F.get(F.transform(F.array(F.coalesce("norm", F.lit(""))), entries), F.lit(0)) if _patterns(keywords, flexible) else F.array()
    return F.explode(listed.cast(f"array<struct<position:int,keyword:string,{name}:{kind}>>"))


def search(docs: DataFrame, keywords: list[str], flexible: bool = True) -> DataFrame:
    """One row per document and keyword: position, keyword, spans of all its occurrences. The documents' columns stay."""
    rows = folded(docs).withColumn("hit", _per_keyword(keywords, flexible, "spans", "array<struct<start:int,end:int>>", T.match_spans))
    return rows.withColumn("position", F.col("hit.position")).withColumn("keyword", F.col("hit.keyword")).withColumn("spans", _original(F.col("hit.spans"))).drop("hit", "norm", "places")


def scan(docs: DataFrame, keywords: list[str], flexible: bool = True, window: int = WINDOW, listed: int = LISTED) -> DataFrame:
    """One row per document and keyword: total, pages of all occurrences, density, and the first occurrences in full.

    Documents without words have density 0 of at least one word; ones without pages have page 0.
    """
    rows = search(docs, keywords, flexible)
    words = T.word_count(F.coalesce("text", F.lit("")))

    def occurrence(s: Column) -> Column:
        return F.struct(
            T.page_at(F.col("pages"), s["start"]).alias("page"), T.section_at(F.col("sections"), s["start"]).alias("section"), s["start"].alias("start"), s["end"].alias("end"),
            T.snippet(F.col("text"), s["start"], s["end"], window).alias("snippet"), F.substr("text", s["start"] + 1, s["end"] - s["start"]).alias("term"),
        )

    pages = F.array_sort(F.array_distinct(F.transform("spans", lambda s: T.page_at(F.col("pages"), s["start"]))))
    total = F.size("spans")
    found = rows.select("doc_id", "position", "keyword", total.alias("total"), (total > 0).alias("found"), pages.alias("page_numbers"), T.density(total, words).alias("density"), F.transform(F.slice("spans", 1, listed), occurrence).alias("occurrences"))
    return found.withColumnRenamed("page_numbers", "pages")


def totals(docs: DataFrame, keywords: list[str], flexible: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keyword, total, density, and columns to keep): the counts alone."""
    rows = folded(docs.select("doc_id", "text", *map(T.named, keep), T.word_count(F.coalesce("text", F.lit(""))).alias("n_words")))
    rows = rows.select("doc_id", *map(T.named, keep), "n_words", _per_keyword(keywords, flexible, "total", "int", lambda n, p: F.regexp_count(n, F.lit(p))).alias("hit"))
    return rows.select("doc_id", "hit.keyword", "hit.total", T.density(F.col("hit.total"), F.col("n_words")).alias("density"), *map(T.named, keep))


def listed_by_page(scanned: DataFrame) -> DataFrame:
    """(doc_id, page, n, most): listed occurrences of all keywords on each page, and the largest of the document's pages.

    Those are the first of each keyword in the whole document, at most as many as the scan lists; each is on the page
    where it starts, also if it goes on over the page's end.
    """
    rows = scanned.select("doc_id", F.explode("occurrences.page").alias("page")).groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("n"))
    return rows.withColumn("most", F.max("n").over(Window.partitionBy("doc_id")))


def parsed_keywords(lists: DataFrame, column: str = "raw") -> DataFrame:
    """(…, position, keyword) from lists at commas, semicolons and line ends; the first of spellings that fold alike stays.

    Each row is parsed for itself, so lists that repeat give their keywords as often; a null or blank list gives none.
    """
    bare = lambda part: F.regexp_replace(F.regexp_replace(T.strip(part), '^"+|"+$', ""), "^'+|'+$", "")
    terms = F.filter(F.transform(F.split(T.named(column), "[,;\n]+", -1), bare), lambda t: t != "")
    rows = lists.withColumn("terms", terms)
    # All terms are folded as one text; what parts them folds to itself.
    rows = rows.withColumn("norms", F.split(T.fold(F.array_join("terms", "\n")), "\n", -1))
    first = F.filter(F.transform("terms", lambda t, i: F.when(F.array_position("norms", F.get("norms", i)) == i + 1, t)), lambda t: t.isNotNull())
    return rows.select(*map(T.named, lists.columns), F.posexplode(first).alias("position", "keyword"))
