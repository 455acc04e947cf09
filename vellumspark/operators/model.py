"""The document model: pages, text, sections and metadata, assembled from raw pages.

A document is a row: doc_id, view, text, pages (number, text, start, end), sections (name, title, start, end), metadata
and warnings. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Canonical section names and the titles that stand for them.
SECTIONS = (
    ("resumo", r"(?:abstract|resumo)"),
    ("introducao", r"(?:introduction|introdu[cç][aã]o)"),
    ("revisao", r"(?:related\s+work|literature\s+review|revis[aã]o\s+(?:da\s+)?literatura|referencial\s+te[oó]rico)"),
    ("metodo", r"(?:methods?|methodology|materials?\s+and\s+methods|m[eé]todos?|metodologia|materiais\s+e\s+m[eé]todos)"),
    ("resultados", r"(?:results?|resultados?)"),
    ("discussao", r"(?:discussion|discuss[aã]o)"),
    ("conclusao", r"(?:conclusions?|considera[cç][oõ]es\s+finais|conclus[aã]o|conclus[oõ]es)"),
    ("limitacoes", r"(?:limitations?|limita[cç][oõ]es)"),
    ("referencias", r"(?:references?|bibliography|refer[eê]ncias?|bibliografia)"),
)
#: A title may be numbered, in decimal or Roman figures.
_NUMBERED = r"(?:\d{1,2}(?:\.\d{1,2})*[.)]?[ \t]*|[IVXivx]{1,5}[.)\-][ \t]*)?"
#: DOIs, entries of a bibliography, years.
_DOI = r"\b10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+\b"
_ENTRY = r"^\s*(?:\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}\.)\s+\S"
_YEAR = r"\b(19|20)\d{2}\b"
#: Words of a person's name and what may connect them.
_NAME = r"[A-ZÀ-Ý][a-zà-ÿ'\-]+|de|da|do|dos|das|e|El|Von|von|van|Jr\.?"
_AUTHORS = rf"^(?:{_NAME})(?:\s+(?:{_NAME})){{1,5}}[\s\d,\*†‡]{{0,10}}$"
OCR_WARNING = "Hardly any text was extracted: the file is probably scanned and would need OCR."

_PAGE = "struct<number:int,text:string,start:int,end:int>"


def repeated_lines(pages: DataFrame, share: float = 0.6, least_pages: int = 4) -> DataFrame:
    """(doc_id, line, n_pages): stripped lines of 4 to 119 characters on most pages of a document of at least four."""
    lines = pages.select("doc_id", "page", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), T.strip))).alias("line"))
    lines = lines.filter(F.length("line").between(4, 119)).groupBy("doc_id", "line").agg(F.countDistinct("page").alias("n_pages"))
    sizes = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("size"))
    sizes = sizes.withColumnRenamed("doc_id", "of")
    # Pages without an id are of one document.
    found = lines.join(sizes, F.col("doc_id").eqNullSafe(F.col("of"))).filter((F.col("size") >= least_pages) & (F.col("n_pages") >= F.greatest(F.lit(3), F.floor(F.col("size") * share))))
    return found.select("doc_id", "line", F.col("n_pages").cast("int").alias("n_pages"))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages without repeated lines and bare page numbers, dehyphenated, white space brought to one form.

    Page numbers go only where repeated lines were found. Lines to drop are found in the raw text.
    """
    drop = repeated_lines(pages).groupBy(F.col("doc_id").alias("__of")).agg(F.collect_set("line").alias("drop"))
    rows = pages.join(drop, F.col("doc_id").eqNullSafe(F.col("__of")), "left").drop("__of").withColumn("text", T.dehyphenate(F.col("text")))

    def kept(line: Column) -> Column:
        bare = T.strip(line)
        return ~(F.array_contains("drop", bare) | bare.rlike(r"(?U)^\d{1,4}$"))

    lines = F.array_join(F.filter(F.split("text", "\n", -1), kept), "\n")
    return rows.withColumn("text", T.clean_space(F.when(F.col("drop").isNull(), F.col("text")).otherwise(lines))).drop("drop")


def sections_of(text: Column) -> Column:
    """Sections in order of their first title: array<struct<name,title,start,end>>; each ends where the next begins.

    The text is read once, for lines that are any title; only these few are told apart.
    """
    titled = lambda titles: rf"(?imdU)^[ \t]*{_NUMBERED}({titles})[ \t]*:?[ \t]*$"
    any_title = titled("|".join(titles for _, titles in SECTIONS))

    def lined(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.substr(text, s["start"] + 1, s["end"] - s["start"]).alias("line")))

    def first(lines: Column, i: int, name: str, titles: str) -> Column:
        hit = F.get(F.filter(lines, lambda x: x["line"].rlike(titled(titles))), F.lit(0))
        return F.struct(hit["start"].alias("start"), F.lit(i).alias("order"), F.lit(name).alias("name"), T.strip(F.regexp_extract(hit["line"], titled(titles), 1)).alias("title"))

    firsts = lambda lines: F.array_sort(F.filter(F.array(*(first(lines, i, *x) for i, x in enumerate(SECTIONS))), lambda s: s["start"].isNotNull()))

    def closed(ordered: Column) -> Column:
        ends = F.concat(F.transform(F.slice(ordered, 2, len(SECTIONS)), lambda s: s["start"]), F.array(F.length(text)))
        return F.zip_with(ordered, F.slice(ends, 1, F.size(ordered)), lambda s, e: F.struct(s["name"].alias("name"), s["title"].alias("title"), s["start"].alias("start"), e.alias("end")))

    return T.let(T.let(lined(T.match_spans(text, any_title)), firsts), closed)


def doi_of(text: Column) -> Column:
    return F.rtrim(F.regexp_extract(F.left(text, F.lit(6000)), f"(?U){_DOI}", 0), F.lit("."))


def reference_count(text: Column, sections: Column) -> Column:
    """Numbered lines of the references, if at least three; else long lines with a year."""
    block = T.section_text(text, sections, "referencias", 1 << 30)
    lines = F.split(block, "\n", -1)
    numbered = F.size(F.filter(lines, lambda x: x.rlike(f"(?U){_ENTRY}")))
    dated = F.size(F.filter(lines, lambda x: (F.length(T.strip(x)) > 40) & x.rlike(f"(?U){_YEAR}")))
    return F.when(block == "", 0).when(numbered >= 3, numbered).otherwise(dated)


def title_of(first_page: Column) -> Column:
    """The first of 15 lines that has 25 to 200 characters and is no address; else null."""
    lines = F.transform(F.slice(F.split(first_page, "\n", -1), 1, 15), T.strip)
    return F.get(F.filter(lines, lambda x: F.length(x).between(25, 200) & ~F.lower(x).rlike("^(?:doi|http|www)")), F.lit(0))


def authors_of(first_page: Column) -> Column:
    """The first run of name lines among 25, without footnote marks, joined by "; "; blank lines before it don't count."""
    lines = F.transform(F.slice(F.split(first_page, "\n", -1), 1, 25), T.strip)
    start = F.struct(F.lit(False).alias("over"), F.array().cast("array<string>").alias("names"))

    def step(state: Column, line: Column) -> Column:
        fits = F.length(line).between(4, 70) & line.rlike(f"(?U){_AUTHORS}")
        name = F.regexp_replace(line, r"(?U)[\s\d,\*†‡]+$", "")
        add = ~state["over"] & fits & (name != "")
        over = state["over"] | (~fits & (F.size(state["names"]) > 0))
        return F.struct(over.alias("over"), F.when(add, F.concat(state["names"], F.array(name))).otherwise(state["names"]).alias("names"))

    return F.array_join(F.aggregate(lines, start, step, lambda s: s["names"]), "; ")


def paged(pages: DataFrame, strip_shift: bool = False) -> DataFrame:
    """(doc_id, text, pages) from (doc_id, page, text): each page occupies its text and two line ends.

    The text is stripped at its ends. With ``strip_shift`` page offsets stay as they were before that.
    """
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    rows = pages.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int"))
    rows = rows.withColumn("end", (F.col("start") + F.length("text") + 2).cast("int"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page").cast("int").alias("number"), "text", "start", "end"))).alias("pages"))
    whole = F.concat(F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n"), F.lit("\n\n"))
    lead = F.length(whole) - F.length(T.lstrip(whole))
    shift = F.lit(0) if strip_shift else F.when(T.strip(whole) == "", 0).otherwise(lead)
    moved = F.transform("pages", lambda p: F.struct(p["number"].alias("number"), p["text"].alias("text"), F.greatest(F.lit(0), p["start"] - shift).alias("start"), F.greatest(F.lit(0), p["end"] - shift).alias("end")))
    return docs.select("doc_id", T.strip(whole).alias("text"), moved.cast(f"array<{_PAGE}>").alias("pages"))


def assemble(pages: DataFrame, metadata: DataFrame | None = None, strip_shift: bool = False) -> DataFrame:
    """Documents of the raw view from (doc_id, page, text) and optional (doc_id, metadata map)."""
    docs = paged(clean_pages(pages.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))), strip_shift)
    docs = docs.join(metadata.select("doc_id", "metadata"), "doc_id", "left") if metadata is not None else docs.withColumn("metadata", F.create_map().cast("map<string,string>"))
    docs = docs.withColumn("sections", sections_of(F.col("text")))
    first = F.get("pages", F.lit(0))["text"]
    given = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: T.strip(v) != "")
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    refs = reference_count(F.col("text"), F.col("sections"))
    extra = F.map_from_entries(
        F.filter(
            F.array(entry("titulo", F.coalesce(given["titulo"], title_of(first))), entry("autores", F.coalesce(F.nullif(authors_of(first), F.lit("")), given["autores"])), entry("doi", F.nullif(doi_of(F.col("text")), F.lit(""))), entry("referencias_estimadas", F.when(refs > 0, refs.cast("string")))),
            lambda e: e["v"].isNotNull(),
        )
    )
    others = F.map_filter(given, lambda k, v: ~k.isin("titulo", "autores", "doi", "referencias_estimadas"))
    docs = docs.withColumn("metadata", F.map_concat(others, extra))
    warning = F.when(F.length("text") < 200, F.array(F.lit(OCR_WARNING))).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", F.lit("raw").alias("view"), "text", "pages", "sections", "metadata", warning.alias("warnings"))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_chars, minutes)."""
    words = T.word_count(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", words.alias("n_words"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars")).withColumn("minutes", T.reading_minutes(F.col("n_words")))
