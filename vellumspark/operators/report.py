"""Reports as Markdown and JSON text, for documents and for batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Headings of the summary's keys.
HEADINGS = {"objetivo": "Objetivo", "metodologia": "Metodologia", "resultados": "Resultados", "conclusao": "Conclusao", "relevancia": "Relevancia"}
SNIPPETS = 10


def _lines(*parts: Column) -> Column:
    """Lines that are not null."""
    return F.concat_ws("\n", *parts)


def _given(value: Column, *line: Column | str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(*(F.lit(x) if isinstance(x, str) else x for x in line)))


def header(now: Column) -> Column:
    """Title, authors, DOI, counts, references and sections of a document row with its statistics."""
    meta = lambda k: F.col("metadata")[k]
    return _lines(
        F.concat(F.lit("# Analise — "), F.coalesce(meta("titulo"), F.lit("Artigo sem titulo identificado"))), F.lit(""),
        _given(meta("autores"), "**Autores:** ", meta("autores")), _given(meta("doi"), "**DOI:** ", meta("doi")),
        F.concat(F.lit("**Paginas:** "), F.size("pages"), F.lit(" · **Palavras:** "), F.format_number("n_words", 0), F.lit(" · **Leitura estimada:** "), "minutes", F.lit(" min")),
        _given(meta("referencias_estimadas"), "**Referencias identificadas:** ", meta("referencias_estimadas")),
        F.when(F.size("sections") > 0, F.concat(F.lit("**Secoes detectadas:** "), F.array_join("sections.title", ", "))),
        F.concat(F.lit("\n_Gerado em "), F.date_format(now, "dd/MM/yyyy HH:mm"), F.lit("_\n")),
    )


def _numbers(docs: DataFrame) -> DataFrame:
    words = T.word_count(F.coalesce("text", F.lit("")))
    return docs.withColumn("n_words", words).withColumn("minutes", T.reading_minutes(F.col("n_words")))


def _block(size: Column, title: str, body: Column, end: str | None = "") -> Column:
    parts = [F.lit(f"## {title}\n"), body] + ([F.lit(end)] if end is not None else [])
    return F.when(size > 0, _lines(*parts))


def markdown(docs: DataFrame, analysis: DataFrame, now: Column | None = None, model: str = "") -> DataFrame:
    """(doc_id, report) from documents and their analyses (see ``deep.analyse``; keywords with occurrences)."""
    now = F.current_timestamp() if now is None else now
    rows = _numbers(docs).join(analysis, "doc_id")
    summary = _lines(*(_given(F.col("summary")[k], f"**{name}:** ", F.col("summary")[k], "\n") for k, name in HEADINGS.items()))
    finding = lambda f, i: _lines(F.concat((i + 1).cast("string"), F.lit(". **"), f["claim"], F.lit("**"), F.when(f["page"] != "", F.concat(F.lit(" _(p. "), f["page"], F.lit(")_"))).otherwise("")), _given(f["evidence"], "   - Evidencia: ", f["evidence"]))
    pages = lambda k: F.coalesce(F.nullif(F.array_join(k["pages"], ", "), F.lit("")), F.lit("—"))

    def keyword(k: Column) -> Column:
        shown = F.transform(F.slice(k["occurrences"], 1, SNIPPETS), lambda o: F.concat(F.lit("- (p. "), o["page"], F.lit(") "), o["snippet"]))
        count = F.concat(F.lit("- Ocorrencias: **"), k["total"], F.lit("** · Paginas: "), pages(k), F.lit(" · Densidade: "), k["density"], F.lit(" por mil palavras"))
        details = F.when(F.size(k["occurrences"]) > 0, _lines(F.lit("<details><summary>Trechos</summary>\n"), F.array_join(shown, "\n"), F.lit("\n</details>\n")))
        return _lines(F.concat(F.lit("### "), k["keyword"], F.lit("\n")), count, F.concat(F.lit("\n"), k["synthesis"], F.lit("\n")), details)

    bullets = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")
    report = _lines(
        header(now), F.when(F.col("summary").isNotNull(), _lines(F.lit("## Resumo estruturado\n"), summary)),
        _block(F.size("findings"), "Principais achados", F.array_join(F.transform("findings", finding), "\n")),
        _block(F.size("limitations"), "Limitacoes e lacunas", bullets("limitations")),
        _block(F.size("keywords"), "Keywords solicitadas", F.array_join(F.transform("keywords", keyword), "\n"), None),
        _block(F.size("terms"), "Termos-chave sugeridos pelo modelo", F.concat(F.array_join(F.transform("terms", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", "), F.lit("\n")), None),
        _block(F.size("warnings"), "Avisos da extracao", bullets("warnings")),
        F.lit(f"\n---\n_Analise gerada localmente com `{model}`._") if model else F.lit(None),
    )
    return rows.select("doc_id", report.alias("report"))


def as_json(docs: DataFrame, analysis: DataFrame, now: Column | None = None, model: str = "") -> DataFrame:
    """(doc_id, report): the analysis with all listed occurrences as a JSON text."""
    now = F.current_timestamp() if now is None else now
    rows = _numbers(docs).join(analysis, "doc_id")
    document = F.struct(F.col("metadata").alias("metadados"), F.size("pages").alias("paginas"), F.col("n_words").alias("palavras"), F.col("minutes").alias("minutos_de_leitura"), F.col("sections.title").alias("secoes"), F.col("warnings").alias("avisos"))
    keywords = F.transform("keywords", lambda k: F.struct(k["keyword"].alias("keyword"), k["synthesis"].alias("sintese"), k["total"].alias("total_ocorrencias"), k["pages"].alias("paginas"), k["density"].alias("densidade_por_mil"), F.transform(k["occurrences"], lambda o: F.struct(o["page"].alias("pagina"), o["section"].alias("secao"), o["snippet"].alias("trecho"))).alias("ocorrencias")))
    found = F.transform("findings", lambda f: F.struct(f["claim"].alias("afirmacao"), f["evidence"].alias("evidencia"), f["page"].alias("pagina")))
    whole = F.struct(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("gerado_em"), F.lit(model).alias("modelo"), document.alias("documento"), F.col("summary").alias("resumo"), found.alias("achados"), F.col("limitations").alias("limitacoes"), F.col("terms").alias("keywords_sugeridas"), keywords.alias("keywords"), F.col("errors").alias("erros"))
    return rows.select("doc_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))


def demoted(c: Column) -> Column:
    """Headings one level lower."""
    return F.regexp_replace(c, "(?md)^#", "##")


def table_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): the rows of a table as Markdown."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(T.named(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("line"))


def table_head(columns: list[str]) -> str:
    return "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)


def tile_lines(tiles: DataFrame) -> DataFrame:
    """(tile, place, line): the tables of a tiled comparison as Markdown, a head and a row per keyword for each tile.

    The order of lines is that of tile and place; heads have no place.
    """
    bars = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rows = tiles.select("tile", "place", bars(F.concat(F.array("keyword"), F.transform("totals", lambda t: t.cast("string")))).alias("line"))
    head = F.concat(bars(F.concat(F.array(F.lit("keyword")), "files")), F.lit("\n|"), F.repeat(F.lit("---|"), F.size("files") + 1))
    heads = tiles.select("tile", "files").distinct().select("tile", F.lit(None).cast(tiles.schema["place"].dataType).alias("place"), head.alias("line"))
    return rows.unionByName(heads)


def absence_lines(absent: DataFrame) -> DataFrame:
    return absent.select(F.concat(F.lit("- **"), "keyword", F.lit("**: nao aparece em "), F.array_join("files", ", ")).alias("line"))


def batch_json(reports: DataFrame, items: DataFrame) -> DataFrame:
    """(session_id, report): JSON reports of a session's analysed items in order; a session holds a few items."""
    rows = reports.join(items.select("doc_id", "session_id", "item", "file"), "doc_id")
    named = F.concat(F.expr("left(report, length(report) - 1)"), F.lit(',"arquivo":'), F.to_json(F.array("file")).substr(F.lit(2), F.length(F.to_json(F.array("file"))) - 2), F.lit("}"))
    listed = rows.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("item", named.alias("json")))).alias("list"))
    return listed.select("session_id", F.concat(F.lit('{"artigos":['), F.array_join("list.json", ","), F.lit("]}")).alias("report"))


def batch_markdown(reports: DataFrame, overview: DataFrame, comparison: DataFrame, absent: DataFrame, now: Column | None = None) -> DataFrame:
    """(place, line): the consolidated report in parts: counts, overview, comparison, absences, and each document's report.

    ``reports`` has (item, file, report). The parts come from bounded tables: a batch has a few items.
    """
    spark = reports.sparkSession
    now = F.current_timestamp() if now is None else now
    order = ["item"]
    columns = [c for c in overview.columns if c != "item"]
    one = lambda place, text: spark.range(1).select(F.lit(place).alias("place"), F.lit(0).cast("long").alias("sub"), text.alias("line"))
    sub = lambda df, place, *by: df.withColumn("sub", F.monotonically_increasing_id()).select(F.lit(place).alias("place"), "sub", "line")
    counts = overview.agg(F.count("*").alias("n"), F.count_if(F.col("analysed") == "sim").alias("a"))
    head = counts.select(F.lit(0).alias("place"), F.lit(0).cast("long").alias("sub"), F.concat(F.lit("# Relatorio consolidado do lote\n\n**Artigos no lote:** "), "n", F.lit(" · **Analisados:** "), "a", F.lit("\n\n_Gerado em "), F.date_format(now, "dd/MM/yyyy HH:mm"), F.lit("_\n")).alias("line"))
    parts = [head, one(1, F.lit("## Artigos\n\n" + table_head(columns))), sub(table_lines(overview.orderBy(*order), columns), 2)]
    parts += [one(3, F.lit("\n## Keywords por artigo (ocorrencias)\n\n" + table_head(comparison.columns))), sub(table_lines(comparison, comparison.columns), 4)]
    parts += [one(5, F.lit("\n### Keywords ausentes\n")), sub(absence_lines(absent), 6)]
    each = reports.select(F.lit(7).alias("place"), F.col("item").cast("long").alias("sub"), F.concat(F.lit("\n---\n\n# Arquivo: "), "file", F.lit("\n\n"), demoted(F.col("report"))).alias("line"))
    out = parts[0]
    for p in [*parts[1:], each]:
        out = out.unionByName(p)
    return out.orderBy("place", "sub")
