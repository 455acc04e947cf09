"""The reading operators applied to the driver's tables.

``documents`` are one-page documents, ``conversations`` documents whose turns are pages. Neither has section titles,
lists or references, so the operators on structure run on articles made of every document's text by the same plain
expressions that the SQL uses.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import progress
from ..functions import text as T
from ..operators import answers, batch, chunk, deep, items, keywords, locate, markdown, model, report, scan, skim
from ..session import new_path, ship, written
from ..sources import pdf_files

KEYWORDS = ["license", "the of", "und", "ément", "token"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text"))


#: An article of every document, with its whole text: title, author, sections, a list, numbers, a conclusion, references and a DOI.
ARTICLE = (
    "concat('A study of texts from ', source, ' written in ', lang, '\nMaria da Silva 1\n\nAbstract\n', substr(flat, 1, 240), '\n\n1. Introduction\n', substr(flat, 241, 200), ' In 2024, 18% of ', lang, ' texts grew. See p. 3 for more.\n"
    "• first entry of ', source, '\nthat goes on\n\n2.1 Data of the study\n', substr(flat, 441, 160), '\nand one more line. Another sentence with 12,5 units.\n\nConclusion:\n', substr(flat, 601), ' Nothing else. Therefore we stop.\n\n"
    "References\n[1] Silva, M. First paper, 2019.\n[2] Souza, P. Second paper, 2020.\n[3] Lima, R. DOI 10.1234/', source, '.', doc_id, '.')"
)
_FLAT = "regexp_replace(coalesce(text, ''), '[\n\r]+', ' ')"


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumns({c: F.coalesce(c, F.lit("none")) for c in ("source", "lang")}).withColumn("flat", F.regexp_replace(F.coalesce("text", F.lit("")), "[\n\r]+", " "))
    return rows.select("doc_id", F.lit(1).alias("page"), F.expr(ARTICLE.replace("\n", "\\n")).alias("text"))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.statistics(documents(spark, sf_dir))


def scan_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.totals(documents(spark, sf_dir), KEYWORDS)


def scan_exact_vs_flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, words = documents(spark, sf_dir), ["licens", "an"]
    exact = scan.totals(docs, words, False).select("doc_id", "keyword", F.col("total").alias("exact"))
    flexible = scan.totals(docs, words, True).select("doc_id", "keyword", F.col("total").alias("flexible"))
    return exact.join(flexible, ["doc_id", "keyword"])


def scan_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the benchmark's texts is a keyword, sought in all documents."""
    words = F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 2))
    wanted = _table(spark, sf_dir, "benchmark").select(words.alias("keyword")).distinct()
    return keywords.totals(documents(spark, sf_dir), wanted)


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences per document, keyword and page."""
    docs = model.paged(turns(spark, sf_dir))
    hits = scan.search(docs, KEYWORDS, False).select("doc_id", "keyword", F.explode(F.transform("spans", lambda s: T.page_at(F.col("pages"), s["start"]))).alias("page"))
    return hits.groupBy("doc_id", "keyword", "page").agg(F.count("*").alias("n"))


def scan_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = model.assemble(turns(spark, sf_dir))
    rows = scan.scan(docs, KEYWORDS).select("doc_id", "keyword", "total", "density", F.posexplode("occurrences").alias("n", "o"))
    return rows.select("doc_id", "keyword", "total", "density", "n", "o.page", "o.section", "o.start", "o.end", "o.term", "o.snippet")


def listed_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = model.paged(turns(spark, sf_dir)).withColumn("sections", model.sections_of(F.col("text")))
    return scan.listed_by_page(scan.scan(docs, KEYWORDS, False))


def keyword_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = documents(spark, sf_dir).select(F.concat("source", F.lit(", "), F.upper("source"), F.lit(";\""), "lang", F.lit("\"\n'Été', ete,,"), "lang").alias("raw")).distinct()
    return scan.parsed_keywords(lists)


def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.paged(turns(spark, sf_dir)).select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.number").alias("page"), "p.start", "p.end")


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.repeated_lines(_with_headers(turns(spark, sf_dir)))


def _with_headers(pages: DataFrame) -> DataFrame:
    """Turns with a running title and a page number, as printed pages have them."""
    return pages.withColumn("text", F.concat(F.lit("Journal no. "), F.col("doc_id") % 7, F.lit("\n"), "text", F.lit("\n"), F.col("page")))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.clean_pages(_with_headers(turns(spark, sf_dir)))


def title_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", model.title_of(F.coalesce("text", F.lit(""))).alias("title"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select("doc_id", F.explode(model.sections_of(F.col("text"))).alias("s"))
    return rows.select("doc_id", "s.name", "s.title", "s.start", "s.end")


def article_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, authors, DOI and references of the articles."""
    docs = model.assemble(articles(spark, sf_dir))
    meta = lambda k: F.col("metadata")[k]
    return docs.select("doc_id", meta("titulo").alias("title"), meta("autores").alias("authors"), meta("doi").alias("doi"), meta("referencias_estimadas").cast("int").alias("n_references"), F.size("warnings").alias("n_warnings"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.blocks(articles(spark, sf_dir)).select("doc_id", "block", "kind", "text")


def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = markdown.view(model.assemble(articles(spark, sf_dir)))
    return docs.select("doc_id", F.explode("sections").alias("s"), "text").select("doc_id", "s.name", "s.title", F.substr("text", F.col("s.start") + 1, F.lit(8)).alias("begins"), "s.start", "s.end")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(skim.sentences(F.coalesce("text", F.lit("")))).alias("n", "sentence"))
    return rows.select("doc_id", "n", "sentence", skim.has_number(F.col("sentence")).alias("numbered"))


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.view(model.assemble(articles(spark, sf_dir)))


def skim_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skim.listed(skim.skim(_view(spark, sf_dir)), "sections").withColumn("skeleton", F.array_join("skeleton", " | "))


def skim_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skim.listed(skim.skim(_view(spark, sf_dir)), "numbers")


def skim_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skim.listed(skim.skim(_view(spark, sf_dir)), "conclusions")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = model.paged(documents(spark, sf_dir).select("doc_id", F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text")))
    return chunk.chunks(docs, 1500, 200)


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("source").alias("session_id"), F.col("doc_id").alias("arrival"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"))


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.triage(_uploads(spark, sf_dir), limit=25)


def free_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.free_seats(documents(spark, sf_dir).select(F.col("source").alias("session_id")), 40)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as items of a batch: totals of keywords over a source's documents."""
    docs = documents(spark, sf_dir).withColumn("file", F.coalesce("source", F.lit(NO_SOURCE)))
    rows = scan.totals(docs, KEYWORDS, False, ("file",))
    position = F.array_position(F.array(*map(F.lit, KEYWORDS)), F.col("keyword"))
    return rows.groupBy("file", "keyword").agg(F.sum("total").cast("int").alias("total")).select(F.col("file").alias("item"), "file", position.alias("position"), "keyword", "total")


#: The name of the item of documents without a source; and columns of a tile, so few that the tables have several.
NO_SOURCE, TILE = "(none)", 8


def comparison_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of all sources, in tiles of their columns."""
    # Written: the texts are read once, and the few totals several times.
    tiles = batch.tiled(written(_results(spark, sf_dir), "results"), TILE)
    return tiles.select("keyword", "tile", F.array_join("files", "|").alias("files"), F.array_join("totals", "|").alias("totals"))


def absent_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.absent(_results(spark, sf_dir)).select("keyword", F.array_join("files", ",").alias("files"))


def batch_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("item"), F.concat(F.lit("doc"), F.col("doc_id")).alias("file"), F.when(F.col("doc_id") % 2 == 0, F.left("text", F.lit(90))).alias("title"), "text", F.array(F.lit(1)).alias("pages"))
    labelled = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item")).distinct().withColumn("analysed", F.lit(True))
    docs = docs.join(labelled, "item", "left").withColumn("analysed", F.coalesce("analysed", F.lit(False)))
    results = scan.totals(documents(spark, sf_dir), KEYWORDS, False).select(F.col("doc_id").alias("item"), "keyword", "total")
    return batch.overview(docs, results)


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("item"))
    done = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item"))
    return batch.pending(docs, done)


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.concat(F.lit("[p. "), F.col("turn") + 1, F.lit("-"), F.col("turn") + 3, F.lit("]")), F.concat(F.lit("p. "), F.col("turn")), F.lit("5-5"), F.lit("4–2"), F.lit("nao informado")), (F.col("conv_id") % 5 + 1).cast("int"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return rows.select("conv_id", "turn", T.page_label(F.col("raw")).alias("label"), F.array_join(T.label_pages(F.col("raw")), ",").alias("pages"))


def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"achados": [{"afirmacao": "from '), "source", F.lit('", "pagina": "p. '), F.col("doc_id") % 9 + 1, F.lit('"}, "bare", {"evidencia": "none"}]}'))
    raw = F.element_at(F.array(body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Here it is: "), body, F.lit(" done.")), F.lit("no json")), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = documents(spark, sf_dir).select("doc_id", deep.parsed_findings(deep.lenient_json(raw)).alias("f"))
    return rows.select("doc_id", F.size("f").alias("n"), F.get("f", F.lit(0))["claim"].alias("claim"), F.get("f", F.lit(0))["page"].alias("page"))


#: Folded words that a passage and a document must share in a row to be compared.
SHINGLE = 4


def _shingles(text: Column) -> Column:
    """Distinct runs of folded words; a shorter text is one run."""
    words = F.filter(F.split(T.fold(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - SHINGLE)), lambda i: F.array_join(F.slice(w, i + 1, SHINGLE), " "))
    return F.array_distinct(T.let(words, runs))


def fuzzy_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage sought in all documents that share any four folded words in a row with it."""
    passages = _table(spark, sf_dir, "benchmark").filter("text is not null").select("item_id", F.col("text").alias("target"))
    docs = documents(spark, sf_dir).filter("text is not null").select("doc_id", F.col("text").alias("page_text"))
    keys = passages.select("item_id", F.explode(_shingles(F.col("target"))).alias("key"))
    pairs = docs.select("doc_id", F.explode(_shingles(F.col("page_text"))).alias("key")).join(keys, "key").select("doc_id", "item_id").distinct()
    pairs = docs.join(pairs, "doc_id").join(passages, "item_id")
    return locate.fuzzy(pairs).select("doc_id", "item_id", "sentence", F.round("ratio", 6).alias("ratio"))


def _word_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Words of the turns set in lines of eight, 50 points a word, 14 points a line."""
    rows = turns(spark, sf_dir).select("doc_id", "page", F.posexplode(F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")).alias("idx", "text"))
    line, place = F.floor(F.col("idx") / 8), F.col("idx") % 8
    words = rows.withColumns({"x0": (40 + 50 * place).cast("double"), "x1": (88 + 50 * place).cast("double"), "top": (30 + 14 * line).cast("double"), "bottom": (42 + 14 * line).cast("double")})
    boxes = words.select("doc_id", "page").distinct().withColumns({"height": F.lit(5000.0), "left": F.lit(3.0), "bottom": F.lit(7.0)})
    return words, boxes


def term_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, boxes = _word_boxes(spark, sf_dir)
    marks = locate.mark_terms(words, boxes, ["the", "und", "de"], False)
    rect = F.get("rects", F.lit(0))
    return marks.select("doc_id", "page", "target", "n", F.size("rects").alias("n_rects"), rect["x0"].alias("x0"), rect["y0"].alias("y0"), rect["x1"].alias("x1"), rect["y1"].alias("y1"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a PDF file, a page for each turn."""
    docs = model.paged(turns(spark, sf_dir)).select("doc_id", F.col("pages.text").alias("pages"), F.create_map(F.lit("Title"), F.concat(F.lit("Conversa "), "doc_id")).alias("info"))
    return pdf_files.rendered(docs)


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of all files, read from their bytes."""
    pages = pdf_files.pages_of(_files(spark, sf_dir), "doc_id", "doc_id")
    title = F.col("info")["/Title"]
    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), "page", T.clean_space(F.col("text")).alias("text"), F.size("words").alias("n_words"), title.alias("title"), (F.col("warning").isNotNull() | F.col("error").isNotNull()).alias("faulty"))


def pdf_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms found by the words of all files, written into these as highlights, and read again."""
    files = written(_files(spark, sf_dir), "files")
    words, boxes = pdf_files.words(pdf_files.pages_of(files, "doc_id", "doc_id"))
    made = pdf_files.annotated(files, locate.mark_terms(words, boxes, ["the", "und", "de"], False))
    notes = pdf_files.annotations(made)
    return notes.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "page", "comment", "colour").agg(F.count("*").alias("n"), F.max("boxes").alias("boxes"))


def marks_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, boxes = _word_boxes(spark, sf_dir)
    return locate.by_category(locate.mark_terms(words, boxes, ["the", "und", "de"], False))


def remaining_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5000).cast("double").alias("elapsed"), ((F.col("event_id") % 97) / 97).alias("done"))
    return rows.select("event_id", F.round(progress.remaining(F.col("elapsed"), F.col("done")), 6).alias("left"), progress.duration(progress.remaining(F.col("elapsed"), F.col("done"))).alias("label"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch tables and the absences as Markdown lines."""
    results = written(_results(spark, sf_dir), "results")
    tables = report.tile_lines(batch.tiled(results, TILE)).select("line")
    return tables.unionByName(report.absence_lines(batch.absent(results)))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items of sessions: those of a session have ids with the same remainder by 7."""
    return model.paged(turns(spark, sf_dir)).withColumn("session_id", F.col("doc_id") % 7)


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event: some name a page, an item or a session that is not there."""
    return _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7 + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)).alias("session_id"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 10).cast("int").alias("number"))


def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.page(_requests(spark, sf_dir), _items(spark, sf_dir)).select("event_id", "status", "error", "page_text")


def item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = items.item(_requests(spark, sf_dir), _items(spark, sf_dir))
    return found.select("event_id", "status", "error", F.length("text").alias("n_chars"), F.when(F.col("pages").isNotNull(), F.size("pages")).alias("n_pages"))


def item_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.listing(_items(spark, sf_dir).select("session_id", "doc_id"), 20)


def item_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to remove what events of one kind name, and the seats that this leaves."""
    kind = _table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id")
    return items.removals(_items(spark, sf_dir), _requests(spark, sf_dir).join(kind, "event_id"), 20).select("event_id", "status", "seats")


def items_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left once the sessions that have a request of the latest kind are cleared."""
    sessions = _table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("session_id")).agg(F.max_by("event_type", "event_id").alias("kind")).filter("kind <> 'click'")
    return items.cleared(_items(spark, sf_dir).select("session_id", "doc_id"), sessions)


def keyword_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = documents(spark, sf_dir).select("doc_id", F.concat_ws(",", "source", F.lit(" "), F.upper("lang"), "source", "text").alias("raw"), "source")
    return lists.select("doc_id", F.size(T.keyword_chips(F.col("raw"))).alias("n"), F.sha2(T.without_chip(F.col("raw"), F.col("source")), 256).alias("others"))


def analysis_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is told of reading all documents, by source: labelled ones are read, or fail if of low quality."""
    docs = documents(spark, sf_dir)
    named = docs.select(F.coalesce("source", F.lit(NO_SOURCE)).alias("session_id"), (F.col("doc_id") + 1).cast("int").alias("position"), "doc_id", F.concat(F.lit("doc"), "doc_id").alias("name"))
    labels = _table(spark, sf_dir, "labels").join(named.select("session_id", "doc_id"), "doc_id")
    outcomes = labels.select("session_id", "doc_id", F.when(F.col("quality") == 0, "no answer").alias("error"))
    return deep.events(named, outcomes, ("summary", "findings", "syntheses"), 2)


class Mirror:
    """A client that answers by rule: notes tell how long a part is, all else repeats a digest of its context."""

    def chat(self, prompt: str, system: str, as_json: bool) -> str:
        context, _, request = prompt.rpartition("\n\n")
        if not as_json:
            return f"- {len(context.partition(':\n\n')[2])} characters" if request.startswith("List") else "synthesis"
        digest = hashlib.sha256(context.encode()).hexdigest()
        return json.dumps({"objetivo": digest, "achados": [{"afirmacao": digest, "evidencia": "e", "pagina": "p. 2-3"}, digest], "limitacoes": [digest, " "], "keywords": [digest[:8], "k"]})


def deep_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents read by a client that answers by rule; its answers are kept in a store."""
    docs = documents(spark, sf_dir)
    docs = model.paged(docs.select("doc_id", F.lit(1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))).withColumn("sections", model.sections_of(F.col("text")))
    client = answers.Stored(Mirror(), "mirror", new_path(spark, "answers"))
    rows = deep.analyse(docs, scan.scan(docs, KEYWORDS[:2]), client, size=1500, overlap=200, most=5)
    synthesised = F.filter("keywords", lambda k: k["synthesis"] == "synthesis")
    first = F.get("findings", F.lit(0))
    return rows.select("doc_id", F.col("summary.objetivo").alias("digest"), F.col("summary.conclusao").alias("conclusion"), first["claim"].alias("claim"), first["page"].alias("page"), F.size("findings").alias("n_findings"), F.array_join("limitations", ",").alias("limitations"), F.array_join("terms", ",").alias("terms"), F.size(synthesised).alias("n_syntheses"), F.size("errors").alias("n_errors"))


def batch_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time left of a batch: the latest events of a user are the finished articles, each event the present one."""
    rows = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 400).cast("double").alias("elapsed"), ((F.col("event_id") % 53) / 53).alias("done"), "value", (F.col("event_id") % 4).alias("left"), (F.col("event_id") % 3).alias("n"))
    finished = F.slice(F.array("value", F.col("value") * 2), 1, F.col("n").cast("int"))
    return rows.select("event_id", F.round(progress.batch_remaining(F.col("elapsed"), F.col("done"), finished, F.col("left")), 6).alias("seconds"))


_NAMES = (
    "doc_stats scan_total scan_many scan_exact_vs_flexible scan_pages scan_occurrences listed_by_page keyword_parse page_offsets repeated_lines clean_text title_inference sections article_metadata "
    "markdown_blocks markdown_sections sentences skim_sections skim_numbers skim_conclusions chunks triage free_seats comparison_pivot absent_keywords batch_overview pending page_labels lenient_json fuzzy_locate term_marks pdf_pages pdf_annotations "
    "marks_by_category remaining_time report_lines page_lookup item_lookup item_listing item_removal items_cleared keyword_chips analysis_events deep_reading batch_time"
).split()


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipped(globals()[name]) for name in _NAMES}
