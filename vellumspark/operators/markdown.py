"""The Markdown view: lines classified, wrapped lines joined to blocks, offsets counted anew.

Every line gets a kind from its own form. What a plain line belongs to follows from the last line before it that is not
plain: if that is a list entry which begins with a hyphen or a figure from 1 to 9, the line continues it; else it is
part of a paragraph. So blocks are groups of lines, and no line's state depends on more than that one line.

Documents and pages are told apart by a number of their row, not by their id, and are shuffled once by it; what belongs
to the document travels with its first line. Defined results: documents that repeat an id, or have none, stay rows of
their own; one without pages or with blank ones has a text of page marks alone; null texts are empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .model import SECTIONS

#: Forms of bullets, numbered entries, numbered titles and bibliography lines.
_BULLET = r"(?dU)^[•▪◦·‣∙*]\s+(.+)$"
_NUMBERED = r"(?dU)^(\d{1,2}[.)])\s+(.+)$"
_NUMBERED_TITLE = r"(?dU)^(\d{1,2}(?:\.\d{1,2}){0,2})[.)]?\s+([^\n.;:]{3,70})\s*$"
_ENTRY = r"(?dU)^(?:\[\d{1,3}\]|\(\d{1,3}\))\s+\S"
TITLE_WORDS = 10


def _section(line: Column) -> Column:
    """struct<name,title> of a section title, else null."""
    tests = [(name, rf"(?idU)^\s*(?:\d{{1,2}}[.)]?\s*)?({titles})\s*:?\s*$") for name, titles in SECTIONS]
    made = lambda name, p: F.struct(F.lit(name).alias("name"), T.strip(F.regexp_extract(line, p, 1)).alias("title"))
    (name, p), *rest = tests
    return reduce(lambda c, t: c.when(line.rlike(t[1]), made(*t)), rest, F.when(line.rlike(p), made(name, p)))


def classified(pages: DataFrame) -> DataFrame:
    """Adds at, line, kind, head, name, title to pages without their text: a row per line; head is what its block begins with.

    Kinds: blank, section, entry, bullet, heading, numbered, plain.
    """
    kept = [T.named(c) for c in pages.columns if c != "text"]
    rows = pages.select(*kept, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "raw")).withColumn("line", T.strip(F.col("raw")))
    line = F.col("line")
    rows = rows.withColumn("section", _section(line))
    body = F.regexp_extract(line, _NUMBERED_TITLE, 2)
    heading = line.rlike(_NUMBERED_TITLE) & (T.word_count(body) <= TITLE_WORDS)
    kind = F.when(line == "", "blank").when(F.col("section").isNotNull(), "section").when(line.rlike(_ENTRY), "entry").when(line.rlike(_BULLET), "bullet").when(heading, "heading").when(line.rlike(_NUMBERED), "numbered").otherwise("plain")
    rows = rows.withColumn("kind", kind)
    part = lambda p, g: T.strip(F.regexp_extract(line, p, g))
    head = (
        F.when(F.col("kind") == "section", F.concat(F.lit("## "), F.col("section.title"))).when(F.col("kind") == "entry", F.concat(F.lit("- "), line)).when(F.col("kind") == "bullet", F.concat(F.lit("- "), part(_BULLET, 1)))
        .when(F.col("kind") == "heading", F.concat(F.lit("### "), F.regexp_extract(line, _NUMBERED_TITLE, 1), F.lit(" "), T.strip(body))).when(F.col("kind") == "numbered", F.concat(F.regexp_extract(line, _NUMBERED, 1), F.lit(" "), part(_NUMBERED, 2)))
    )
    return rows.select(*kept, "at", "line", "kind", head.alias("head"), F.col("section.name").alias("name"), F.col("section.title").alias("title"))


def _grouped(pages: DataFrame, *first: str) -> DataFrame:
    """(key, number, block, text, kind, name, title, …): blocks of the pages of (key, number, text), blank ones, too.

    Columns named in ``first`` are taken from a page's first line.
    """
    place = ["key", "number"]
    seen = Window.partitionBy(*place).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind") != "plain", F.struct("at", "kind", "head")), ignorenulls=True).over(seen)
    rows = classified(pages).withColumn("last", last)
    rows = rows.withColumns({c: F.when(F.col("at") == 0, F.col(c)) for c in first})
    open_list = F.col("last.kind").isin("entry", "bullet", "numbered") & F.col("last.head").rlike("^(?:- |[1-9])")
    rows = rows.withColumn("part", F.when(F.col("kind") != "plain", 0).when(F.coalesce(open_list, F.lit(False)), 0).otherwise(1))
    rows = rows.groupBy(*place, F.coalesce("last.at", F.lit(-1)).alias("of"), "part").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("head", "line").alias("piece")))).alias("pieces"),
        F.min(F.struct("at", "kind", "name", "title")).alias("begin"),
        *(F.first(c, ignorenulls=True).alias(c) for c in first),
    )
    joined = F.array_join(F.col("pieces.piece"), " ")
    text = F.when(F.col("part") == 1, T.strip(F.regexp_replace(joined, f"(?U){T.SPACE}{{2,}}", " "))).otherwise(joined)
    kind = F.when(F.col("part") == 1, "paragraph").otherwise(F.col("begin.kind"))
    rows = rows.withColumn("kind", kind).withColumn("shown", (F.col("kind") != "blank").cast("int"))
    number = F.sum("shown").over(Window.partitionBy(*place).orderBy("of", "part").rowsBetween(Window.unboundedPreceding, 0)) - 1
    own = lambda c: F.when(F.col("part") == 0, F.col(f"begin.{c}")).alias(c)
    return rows.select(*place, number.cast("int").alias("block"), text.alias("text"), "kind", own("name"), own("title"), *first)


def blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page, block, text, kind, name, title): Markdown blocks of each page, numbered from 0."""
    rows = pages.select(F.monotonically_increasing_id().alias("key"), F.lit(0).alias("number"), "text", F.struct("doc_id", "page").alias("of_page"))
    made = _grouped(rows.repartition("key"), "of_page")
    # A page's id and number came with its first line, so with its first block.
    whole = F.first("of_page", ignorenulls=True).over(Window.partitionBy("key"))
    return made.withColumn("of_page", whole).filter("kind <> 'blank'").select("of_page.doc_id", "of_page.page", "block", "text", "kind", "name", "title")


def view(docs: DataFrame, mark_pages: bool = True) -> DataFrame:
    """Documents of the Markdown view from documents of the raw view; page numbers agree, offsets are its own."""
    title = T.strip(F.coalesce(F.col("metadata")["titulo"], F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.struct("doc_id", "metadata", "warnings", title.alias("title")).alias("doc"), "pages")
    # Numbered before pages are parted, in a step of its own.
    rows = rows.select("key", "doc", F.posexplode_outer("pages").alias("number", "p"))
    first = F.coalesce("number", F.lit(0)) == 0
    rows = rows.select("key", F.coalesce("number", F.lit(0)).alias("number"), F.col("p.text").alias("text"), F.col("p.number").alias("page"), F.when(first, F.col("doc")).alias("doc")).repartition("key")
    shown = F.when(F.col("kind") != "blank", F.struct("block", "text", "name", "title"))
    pages = _grouped(rows, "page", "doc").groupBy("key", "number").agg(F.array_sort(F.collect_list(shown)).alias("blocks"), F.first("page", ignorenulls=True).alias("page"), F.first("doc", ignorenulls=True).alias("doc"))
    none = F.lit(None).cast("string")
    marker = F.array(F.struct(F.lit(-1).alias("block"), F.concat(F.lit("<!-- p. "), F.col("page").cast("string"), F.lit(" -->")).alias("text"), none.alias("name"), none.alias("title")))
    if mark_pages:
        pages = pages.withColumn("blocks", F.when(F.col("page").isNull(), F.col("blocks")).otherwise(F.concat(marker, "blocks")))
    pages = pages.withColumn("lead", F.when((F.col("number") == 0) & (F.col("doc.title") != ""), F.concat(F.lit("# "), F.col("doc.title"), F.lit("\n\n"))).otherwise(""))
    pages = pages.withColumn("text", F.concat("lead", F.array_join(F.col("blocks.text"), "\n\n")))
    before = Window.partitionBy("key").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int")).withColumn("end", (F.col("start") + F.length("text") + 2).cast("int"))
    ends = T.running_sums(F.transform("blocks", lambda b: F.length(b["text"]) + 2))
    begins = F.zip_with("blocks", ends, lambda b, end: F.struct((F.col("start") + F.length("lead") + end - F.length(b["text"]) - 2).alias("start"), b["name"].alias("name"), b["title"].alias("title")))
    whole = pages.withColumn("titles", F.filter(begins, lambda s: s["name"].isNotNull())).groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct("number", "page", "text", "start", "end")))).alias("pages"),
        F.array_sort(F.flatten(F.collect_list("titles"))).alias("titles"),
        F.first("doc", ignorenulls=True).alias("doc"),
    )
    whole = whole.withColumn("pages", F.transform("pages", lambda p: F.struct(p["page"].alias("number"), p["text"].alias("text"), p["start"].alias("start"), p["end"].alias("end"))))
    whole = whole.withColumn("text", T.strip(F.array_join(F.col("pages.text"), "\n\n")))
    whole = whole.withColumn("titles", F.filter("titles", lambda s, i: F.array_position(F.col("titles.name"), s["name"]) == i + 1))
    stops = F.concat(F.transform(F.slice("titles", 2, len(SECTIONS)), lambda s: s["start"]), F.array(F.length("text")))
    sections = F.zip_with("titles", F.slice(stops, 1, F.size("titles")), lambda s, e: F.struct(s["name"].alias("name"), s["title"].alias("title"), s["start"].alias("start"), e.alias("end")))
    return whole.select("doc.doc_id", F.lit("markdown").alias("view"), "text", "pages", sections.alias("sections"), "doc.metadata", "doc.warnings")
