"""Skim: section openings, paragraph skeletons, sentences with numbers and concluding sentences, without a model.

A document's paragraphs are shuffled once, by a number of its row, and everything follows from them. Defined results:
documents that repeat an id, or have none, stay rows of their own; one without text is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Folded phrases that mark a conclusion.
MARKERS = (
    "concluimos", "conclui-se", "concluiu-se", "em conclusao", "os resultados mostram", "os achados sugerem", "este estudo mostra", "portanto",
    "em suma", "por fim", "os resultados sugerem", "os achados indicam", "sugere que", "sugerem que", "mostram que", "our findings", "suggest that",
    "indicate that", "we conclude", "in conclusion", "the results show", "these findings suggest", "taken together", "therefore", "in summary",
)
#: Folded titles of concluding sections.
CONCLUDING = ("conclusao", "conclusoes", "conclusion", "conclusions", "consideracoes finais")
#: Numbering before a title, where sentences are cut, what counts as a number, and Markdown headings.
_NUMBERING = r"(?dU)^\s*(?:\d{1,2}(?:\.\d{1,2})*|[ivxIVX]{1,5})(?:\s*[.)\-–]\s*|\s+)"
_CUT = "(?U)(?<=[.!?])\\s+(?=[\"“'(\\[]?[A-ZÀ-Ú])"
_NUMBER = r"(?U)\d+[.,]\d+|\d+\s*%|\b\d{2,}\b"
_HEADING = r"(?dU)^(#{2,6})\s+(.+?)\s*$"
_PAGE_MARK = r"(?dU)^<!--\s*p\.\s*\d+\s*-->$"
UNTITLED = "Inicio do artigo"
NUMBERS, CONCLUSIONS = 12, 8


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(T.squeeze(c), _CUT, -1), T.strip), lambda s: s != "")


def has_number(c: Column) -> Column:
    return c.rlike(_NUMBER)


def has_marker(folded: Column) -> Column:
    return reduce(lambda a, m: a | F.contains(folded, F.lit(m)), MARKERS[1:], F.contains(folded, F.lit(MARKERS[0])))


def concluding_title(title: Column) -> Column:
    """Titles that are or begin with the name of a concluding section, numbering aside."""
    bare = T.strip(T.fold_simple(F.regexp_replace(title, _NUMBERING, "")))
    return reduce(lambda a, n: a | (bare == n) | bare.startswith(n + " "), CONCLUDING, F.lit(False))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(key, at, doc, offset, page, block, is_heading, title, section, sentences, real): blocks of the Markdown view.

    ``section`` counts headings up to the block; 0 is what stands before any. Page marks, the document's title and blank
    blocks are not real. ``doc`` (doc_id and title) stands at the first block.
    """
    doc = F.struct("doc_id", T.strip(F.coalesce(F.col("metadata")["titulo"], F.lit(""))).alias("title"))
    places = F.transform("pages", lambda p: F.struct(p["number"].alias("number"), p["start"].alias("start"), p["end"].alias("end")))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), doc.alias("doc"), places.alias("pages"), F.coalesce("text", F.lit("")).alias("text"))
    # Numbered before texts are parted, in a step of its own.
    rows = rows.select("key", "doc", "pages", F.posexplode(F.split("text", "\n\n", -1)).alias("at", "raw"))
    rows = rows.withColumn("doc", F.when(F.col("at") == 0, F.col("doc"))).repartition("key")
    before = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("cursor", F.coalesce(F.sum(F.length("raw") + 2).over(before), F.lit(0))).withColumn("block", T.strip(F.col("raw")))
    rows = rows.withColumn("offset", (F.col("cursor") + F.length("raw") - F.length(T.lstrip(F.col("raw")))).cast("int")).withColumn("page", T.page_at(F.col("pages"), F.col("offset")))
    block = F.col("block")
    rows = rows.withColumn("is_heading", block.rlike(_HEADING)).withColumn("title", F.when(F.col("is_heading"), T.strip(F.regexp_extract("block", _HEADING, 2))))
    shown = (block != "") & ~block.rlike(_PAGE_MARK) & ~block.startswith("# ")
    rows = rows.withColumn("sentences", F.when(shown & ~F.col("is_heading"), sentences(block)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("real", shown & (F.col("is_heading") | (F.size("sentences") > 0)))
    upto = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum((F.col("real") & F.col("is_heading")).cast("int")).over(upto).cast("int")).select("key", "at", "doc", "offset", "page", "block", "is_heading", "title", "section", "sentences", "real")


def skim(docs: DataFrame, numbers: int = NUMBERS, conclusions: int = CONCLUSIONS) -> DataFrame:
    """One nested row per document: title, sections, numbers, conclusions and whether there is nothing.

    Sections have number, title, page, opening (the first paragraph whole) and skeleton (first and last sentences of the
    others); numbers and conclusions are the first sentences of their kind, with position, page and section.
    """
    rows = paragraphs(docs)
    within = Window.partitionBy("key", "section").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(F.when(F.col("real"), c), ignorenulls=True).over(within)
    rows = rows.withColumn("section_title", first(F.coalesce("title", F.lit(UNTITLED)))).withColumn("section_page", first(F.col("page")))
    # All sentences of a paragraph are folded as one text; what parts them folds to itself.
    rows = rows.withColumn("norms", F.split(T.fold(F.array_join("sentences", "\x01")), "\x01", -1)).withColumn("ends_it", concluding_title(F.col("section_title")))
    rated = F.transform("sentences", lambda s, i: F.struct(s.alias("sentence"), F.col("page").alias("page"), F.col("section_title").alias("section"), has_number(s).alias("numbered"), (F.col("ends_it") | has_marker(F.get("norms", i))).alias("concluding")))
    text = F.col("real") & ~F.col("is_heading")
    rows = rows.select("key", "section", "section_title", "section_page", "doc", "real", F.when(text, F.struct("at", "sentences")).alias("paragraph"), F.when(text, F.struct("at", rated.alias("rated"))).alias("rated"))
    parts = rows.groupBy("key", "section").agg(
        F.first("section_title", ignorenulls=True).alias("title"), F.first("section_page", ignorenulls=True).alias("page"), F.first("doc", ignorenulls=True).alias("doc"), F.max("real").alias("real"),
        F.array_sort(F.collect_list("paragraph")).alias("paragraphs"), F.array_sort(F.collect_list("rated")).alias("rated"),
    )
    ends = lambda p: F.when(F.size(p["sentences"]) > 1, F.array(F.get(p["sentences"], F.lit(0)), F.element_at(p["sentences"], -1))).otherwise(p["sentences"])
    opening = F.coalesce(F.array_join(F.get("paragraphs", F.lit(0))["sentences"], " "), F.lit(""))
    skeleton = F.flatten(F.transform(F.slice("paragraphs", 2, 1 << 30), ends))
    section = F.when(F.col("real"), F.struct("section", "title", "page", opening.alias("opening"), skeleton.alias("skeleton")))
    whole = parts.groupBy("key").agg(F.array_sort(F.collect_list(section)).alias("sections"), F.array_sort(F.collect_list(F.struct("section", F.flatten(F.col("rated.rated")).alias("rated")))).alias("rated"), F.first("doc", ignorenulls=True).alias("doc"))
    every = F.flatten(F.col("rated.rated"))
    listed = lambda flag, most: F.transform(F.slice(F.filter(every, lambda s: s[flag]), 1, most), lambda s, i: F.struct((i + 1).alias("position"), s["sentence"].alias("sentence"), s["page"].alias("page"), s["section"].alias("section")))
    rows = whole.select("doc.doc_id", "doc.title", "sections", listed("numbered", numbers).alias("numbers"), listed("concluding", conclusions).alias("conclusions"))
    return rows.withColumn("empty", (F.size("sections") == 0) & (F.size("numbers") == 0) & (F.size("conclusions") == 0))


def listed(skimmed: DataFrame, part: str) -> DataFrame:
    """A row per entry of ``sections``, ``numbers`` or ``conclusions`` of skimmed documents."""
    return skimmed.select("doc_id", F.explode(part).alias("of")).select("doc_id", "of.*")
