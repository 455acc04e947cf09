"""Cases of the reading operators: structure, scan, Markdown, skim, chunks, batches, location, deep reading, reports."""

import json
import sys
import time
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vellumspark.functions import progress
from vellumspark.functions import text as T
from vellumspark.operators import batch, chunk, deep, locate, markdown, model, report, scan, skim
from vellumspark.plans import oracles, queries


def pages(spark, *docs):
    rows = [(str(d), i + 1, p) for d, texts in enumerate(docs) for i, p in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id string, page int, text string")


def scanned(spark, texts, keyword, flexible=True, **options):
    return scan.scan(model.assemble(pages(spark, texts)), [keyword], flexible, **options).first()


@pytest.mark.parametrize(
    ("text", "keyword", "flexible", "total"),
    [
        ("O estudo trata de viés amostral em pesquisas.", "vies amostral", True, 1), ("As partes do experimento foram descritas.", "arte", False, 0),
        ("Foram avaliados varios algoritmos supervisionados.", "algoritmo", True, 1), ("Foram avaliados varios algoritmos supervisionados.", "algoritmo", False, 0),
        ("Aplicamos aprendizado-de-maquina no conjunto.", "aprendizado de maquina", True, 1), ("éarte e arte", "arte", False, 1), ("A ﬁnal ½ … final test", "final", False, 2),
    ],
)
def test_scan_totals(spark, text, keyword, flexible, total):
    assert scanned(spark, [text], keyword, flexible)["total"] == total


def test_scan_details(spark):
    row = scanned(spark, ["Antes do termo, machine learning aparece aqui, depois segue."], "machine learning")
    assert "**machine learning**" in row["occurrences"][0]["snippet"]
    assert scanned(spark, ["nada", "Uma regressao aqui.", "Outra regressão."], "regressao")["pages"] == [2, 3]
    row = scanned(spark, [" ".join(["dado"] * 500)], "dado", False)
    assert (row["total"], row["density"]) == (500, 1000.0)
    row = scanned(spark, [" ".join(["termo"] * 60)], "termo", False, listed=5)
    assert (row["total"], len(row["occurrences"])) == (60, 5)
    row = scanned(spark, ["O ﬁm do viés"], "vies", False)
    assert row["occurrences"][0]["term"] == "viés"


def test_keyword_lists(spark):
    lists = spark.createDataFrame([("Viés, vies, VIÉS",), ('a, "b"; c\nd',)], "raw string")
    got = {}
    for r in scan.parsed_keywords(lists).orderBy("raw", "position").collect():
        got.setdefault(r["raw"], []).append(r["keyword"])
    assert got == {"Viés, vies, VIÉS": ["Viés"], 'a, "b"; c\nd': ["a", "b", "c", "d"]}
    assert T.keyword_pattern(" - ") is None


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAéÉçß½ﬁ…— ´́İΣς中"), max_size=12), min_size=1, max_size=20))
def test_fold_agrees_with_its_rule(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in scan.folded(df).collect():
        want = "".join(c for x in r["text"] for c in unicodedata.normalize("NFKD", x.lower()) if not unicodedata.combining(c))
        assert r["norm"] == want


def test_structure(spark):
    shared = [f"Revista X\nconteudo numero {i} da pagina\n{i}" for i in range(1, 7)]
    doc = model.assemble(pages(spark, shared)).first()
    assert "Revista X" not in doc["text"] and "conteudo numero 3" in doc["text"] and "\n3" not in doc["text"]
    article = ["Um titulo bastante longo para o artigo\nMaria da Silva 1\nJoão Souza 2\n\nAbstract\nIt says so.\nIntroduction\nDOI: 10.1234/abcd.2020.567\nMore.", "3. Methods\nWe did.\nResults\nGood.\nReferences\n[1] A one.\n[2] B two.\n[3] C three."]
    doc = model.assemble(pages(spark, article)).first()
    assert [s["name"] for s in doc["sections"]] == ["resumo", "introducao", "metodo", "resultados", "referencias"]
    meta = doc["metadata"]
    assert meta["autores"] == "Maria da Silva; João Souza" and meta["doi"] == "10.1234/abcd.2020.567" and meta["referencias_estimadas"] == "3"
    for s in doc["sections"]:
        assert s["title"] in doc["text"][s["start"] : s["end"]]
    empty = model.assemble(pages(spark, [""])).first()
    assert empty["warnings"] == [model.OCR_WARNING] and empty["text"] == ""
    assert model.statistics(spark.createDataFrame([("a", "w " * 400)], "doc_id string, text string")).first()["minutes"] == 2


def test_offsets_after_leading_empty_pages(spark):
    doc = model.assemble(pages(spark, ["", "erste seite", "zweite"])).first()
    for p in doc["pages"][1:]:
        assert doc["text"][p["start"] : p["start"] + len(p["text"])] == p["text"]


ARTICLE = ["1. Introduction\nFirst line of text\nwrapped here.\n\n• one item\ncontinued\n• two\n\n3.1 Data used\nMore text with 12,5 units. Nothing here. It ended at 18%.", "Second page.\n\nConclusion\nThe results show growth. Bye.\nReferences\n[1] Ref one"]


def test_markdown(spark):
    raw = model.assemble(pages(spark, ARTICLE), pages(spark, ARTICLE).select("doc_id", F.create_map(F.lit("titulo"), F.lit("T")).alias("metadata")).dropDuplicates(["doc_id"]))
    doc = markdown.view(raw).first()
    text = doc["text"]
    assert text.startswith("# T\n\n<!-- p. 1 -->\n\n## Introduction\n\nFirst line of text wrapped here.\n\n- one item continued\n\n- two\n\n### 3.1 Data used\n\nMore text")
    assert "<!-- p. 2 -->\n\nSecond page.\n\n## Conclusion\n\nThe results show growth. Bye.\n\n## References\n\n- [1] Ref one" in text
    for s in doc["sections"]:
        assert text[s["start"] :].startswith(f"## {s['title']}")
    for p in doc["pages"]:
        assert text[p["start"] :].startswith(p["text"])


def test_skim(spark):
    doc = markdown.view(model.assemble(pages(spark, ARTICLE)))
    row = skim.skim(doc).first()
    assert [s["title"] for s in row["sections"]] == ["Introduction", "3.1 Data used", "Conclusion", "References"]
    assert row["sections"][0]["opening"] == "First line of text wrapped here." and row["sections"][0]["skeleton"] == ["- one item continued", "- two"]
    assert [n["sentence"] for n in row["numbers"]] == ["More text with 12,5 units.", "It ended at 18%."]
    assert [c["sentence"] for c in row["conclusions"]] == ["The results show growth.", "Bye."] and row["conclusions"][0]["page"] == 2
    assert skim.skim(doc, 1, 1).first()["numbers"][1:] == []
    assert skim.skim(markdown.view(model.assemble(pages(spark, [""])), False)).first()["empty"]


@pytest.mark.parametrize(
    ("title", "yes"),
    [("Conclusion", True), ("4. Conclusion", True), ("1.2 Conclusion", True), ("Conclusions and Future Work", True), ("Discussion and Conclusion", False), ("Methods", False), ("Vies amostral", False)],
)
def test_concluding_titles(spark, title, yes):
    assert spark.range(1).select(skim.concluding_title(F.lit(title))).first()[0] is yes


def test_sentences(spark):
    cut = lambda t: spark.range(1).select(skim.sentences(F.lit(t))).first()[0]
    assert len(cut("A diferenca foi significativa (p < 0.001) no grupo tratado.")) == 1
    assert len(cut("Foi assim. “Outra” veio depois.")) == 2
    number = lambda t: spark.range(1).select(skim.has_number(F.lit(t))).first()[0]
    assert not number("Ver p. 3 para o fluxograma.") and number("subiu 18% no ano") and number("valor de 0,001 aqui")


def test_chunks(spark):
    one = chunk.chunks(model.paged(pages(spark, ["texto pequeno"])), 6000).collect()
    assert [r["text"] for r in one] == ["texto pequeno"]
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 20 for i in range(200)).strip()
    spans = chunk.places(text, 1500, 100)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b[0] <= a[1] for a, b in zip(spans, spans[1:], strict=False))
    assert chunk.chunks(model.paged(pages(spark, ["a" * 100, "b" * 100, "c" * 100])), 6000).first()["label"] == "p. 1-3"
    with pytest.raises(ValueError, match="positive"):
        chunk.chunks(model.paged(pages(spark, ["x"])), 0)


def test_triage(spark):
    def run(candidates, existing=()):
        ups = spark.createDataFrame([("s", i, h) for i, h in enumerate(candidates)], "session_id string, arrival int, content_sha256 string")
        held = spark.createDataFrame([("s", h) for h in existing], "session_id string, content_sha256 string")
        return [(r["status"], r["reason"]) for r in batch.triage(ups, held).orderBy("arrival").collect()]

    assert [s for s, _ in run("abcdefg")] == ["accepted"] * 5 + ["refused"] * 2
    assert [s for s, _ in run("def", "abc")] == ["accepted", "accepted", "refused"]
    assert run("ab", "a") == [("refused", batch.DUPLICATE), ("accepted", None)]
    full = run("abcdefaf")
    assert full[5][1] == full[7][1] == batch.FULL.format(5) and full[6][1] == batch.DUPLICATE


def test_triage_with_seats_taken(spark):
    """Against the batch without them, on many contents of one session, with null sessions and repeats."""
    ups = spark.range(600).select(F.when(F.col("id") % 50 > 0, "s").alias("session_id"), F.col("id").alias("arrival"), (F.col("id") % 200).cast("string").alias("content_sha256"))
    held = spark.createDataFrame([("s", "3"), ("s", "3"), ("s", "7"), ("t", "1")], "session_id string, content_sha256 string")
    got = {(r["session_id"], r["arrival"]): (r["status"], r["reason"]) for r in batch.triage(ups, held, 5).collect()}
    taken, want = {"s": ["3", "7"], None: []}, {}
    for i in range(600):
        s, c = ("s" if i % 50 else None), str(i % 200)
        reason = batch.DUPLICATE if c in taken[s] else batch.FULL.format(5) if len(taken[s]) >= 5 else None
        taken[s] += [] if reason else [c]
        want[s, i] = ("refused" if reason else "accepted", reason)
    assert got == want and len(got) == 600
    plan = batch.triage(ups, held, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pages_without_an_id_are_cleaned_too(spark):
    texts = [f"Journal\ntext number {i} of it\n{i}" for i in range(5)]
    pages = spark.createDataFrame([(d, i + 1, t) for d in ("a", None) for i, t in enumerate(texts)], "doc_id string, page int, text string")
    assert model.repeated_lines(pages).count() == 2 and {r["text"] for r in model.clean_pages(pages).collect()} == {f"text number {i} of it" for i in range(5)}
    assert model.clean_pages(pages).count() == 10


def test_batch_tables(spark):
    results = spark.createDataFrame([(0, "a.pdf", 0, "telemedicina", 2), (0, "a.pdf", 1, "adesao", 0), (1, "b.pdf", 0, "telemedicina", 0), (1, "b.pdf", 1, "adesao", 2)], "item int, file string, position int, keyword string, total int")
    assert [tuple(r) for r in batch.comparison(results, ["a.pdf", "b.pdf", "c.pdf"]).collect()] == [("telemedicina", 2, 0, 0), ("adesao", 0, 2, 0)]
    assert {r["keyword"]: r["files"] for r in batch.absent(results).collect()} == {"telemedicina": ["b.pdf"], "adesao": ["a.pdf"]}
    items = spark.createDataFrame([(0, "a.pdf", None, "w w", [1], True), (2, "c.pdf", "T", "w", [1], False)], "item int, file string, title string, text string, pages array<int>, analysed boolean")
    rows = {r["item"]: r for r in batch.overview(items, results).collect()}
    assert rows[0]["keywords_found"] == "1/2" and rows[0]["title"] == "a.pdf" and rows[0]["analysed"] == "sim" and rows[2]["keywords_found"] == "—"


@pytest.mark.parametrize(("raw", "label"), [("[p. 1-3]", "1-3"), ("p. 2", "2"), ("5-5", "5"), ("3–4", "3-4"), ("", ""), ("nao informado", "")])
def test_page_labels(spark, raw, label):
    assert spark.range(1).select(T.page_label(F.lit(raw))).first()[0] == label


def test_location(spark):
    words = spark.createDataFrame([("d", 1, i, w, 10.0 * i, 10.0 * i + 8, 20.0 + 14 * (i // 3), 30.0 + 14 * (i // 3)) for i, w in enumerate("O viés amostral foi grande aqui".split())], "doc_id string, page int, idx int, text string, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([("d", 1, 100.0, 0.0, 0.0)], "doc_id string, page int, height double, left double, bottom double")
    mark = locate.mark_terms(words, boxes, ["vies amostral", "amostral foi"]).orderBy("target").collect()
    assert [len(m["rects"]) for m in mark] == [2, 1] and tuple(mark[1]["rects"][0]) == (10.0, 70.0, 28.0, 80.0)
    note = locate.annotations(locate.mark_terms(words, boxes, ["vies"])).first()
    assert list(note["quads"]) == [10.0, 80.0, 18.0, 80.0, 10.0, 70.0, 18.0, 70.0] and note["colour"] == "ffe066"
    page = "A primeira frase fala de outra coisa. A adesao ao tratamento aumentou muito no grupo."
    assert locate.best_sentence(page, "a adesao ao tratamento aumentou no grupo")[0].startswith("A adesao")
    assert locate.best_sentence(page, "galaxias distantes emitem radiacao infravermelha")[0] is None
    assert locate.best_sentence(page, "curto")[0] is None
    pages_ = spark.range(1).select(T.label_pages(F.lit("4-2"))).first()[0]
    assert pages_ == [2, 3, 4]


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Fake:
    """A client whose answers depend on words of the prompt."""

    def chat(self, prompt, system, as_json):
        if "keys " in prompt:
            return 'Sure: {"objetivo": "X", "metodologia": "Y"}'
        if "achados" in prompt:
            return '```json\n{"achados": [{"afirmacao": "A", "evidencia": "E", "pagina": "[p. 2-2]"}, "B", {"evidencia": "no"}]}\n```'
        if "limitacoes" in prompt:
            return '["L1", "Lacuna: q", ""]'
        if "keywords" in prompt:
            raise RuntimeError("down")
        return "- [p. 1] note"


def test_deep_reading_and_reports(spark):
    docs = model.assemble(pages(spark, ["Abstract\nUm estudo de teste com 12 dados. " * 10]))
    found = scan.scan(docs, ["estudo", "ausente"])
    row = deep.analyse(docs, found, Fake()).first()
    assert row["summary"]["objetivo"] == "X" and row["summary"]["conclusao"] == "nao informado"
    assert [tuple(f) for f in row["findings"]] == [("A", "E", "2"), ("B", "", "")]
    assert row["limitations"] == ["L1", "Lacuna: q"] and row["errors"] == ["terms: down"]
    texts = {k["keyword"]: k["synthesis"] for k in row["keywords"]}
    assert "nao aparece" in texts["ausente"] and texts["estudo"] == "- [p. 1] note"
    assert deep.model_installed("m", ["m:latest"]) and not deep.model_installed("m:1", ["m:latest"])
    assert deep.joined_stream([b'{"message": {"content": "a"}}', b"bad", b'{"message": {"content": "b"}, "done": true}', b'{"message": {"content": "c"}}']) == "ab"
    analysis = spark.createDataFrame([("0", ("X", "Y", "", "", ""), [("A", "E", "2")], ["L"], ["k1"], [], [("estudo", "syn", 1, [1], 2.5, [(1, None, "t **estudo**")])])], "doc_id string, summary struct<objetivo:string,metodologia:string,resultados:string,conclusao:string,relevancia:string>, findings array<struct<claim:string,evidence:string,page:string>>, limitations array<string>, terms array<string>, errors array<string>, keywords array<struct<keyword:string,synthesis:string,total:int,pages:array<int>,density:double,occurrences:array<struct<page:int,section:string,snippet:string>>>>")
    text = report.markdown(docs, analysis).first()["report"]
    for part in ("## Resumo estruturado", "1. **A** _(p. 2)_\n   - Evidencia: E", "### estudo", "- (p. 1) t **estudo**", "`k1`"):
        assert part in text
    data = json.loads(report.as_json(docs, analysis).first()["report"])
    assert data["keywords"][0]["ocorrencias"][0]["trecho"] == "t **estudo**" and data["documento"]["paginas"] == 1
    assert spark.range(1).select(report.demoted(F.lit("# a\nb\n## c"))).first()[0] == "## a\nb\n### c"


def test_lenient_json(spark):
    for raw, ok in (('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('so {"a": 1} there', True), ("[1, 2]", True), ("none", False)):
        assert (spark.range(1).select(F.to_json(deep.lenient_json(F.lit(raw)))).first()[0] is not None) is ok


def test_progress(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    assert value(progress.duration(F.lit(30.0))) == "menos de 1 min" and value(progress.duration(F.lit(190.0))) == "~3 min" and value(progress.duration(F.lit(3900.0))) == "~1 h 5 min"
    assert value(progress.remaining(F.lit(10.0), F.lit(0.5))) == 10.0
    assert abs(value(progress.smoothed(F.array(F.lit(10.0), F.lit(20.0)))) - 13.0) < 1e-9


def test_ingest_and_streaming(spark, tmp_path):
    from vellumspark.sources import ingest
    from vellumspark.streaming.ingest import arriving

    (tmp_path / "in").mkdir()
    for name, text in (("a.PDF", "page one\fpage two"), ("b.pdf", "page one\fpage two"), ("c.txt", "x")):
        (tmp_path / "in" / name).write_text(text)
    found = ingest.files(spark, str(tmp_path / "in"))
    assert {r["file_name"] for r in found.collect()} == {"a.PDF", "b.pdf"}
    read = ingest.extracted(found)
    assert ingest.pages(read).count() == 4
    failing = ingest.extracted(found, lambda content: 1 / 0)
    assert {r["error"] for r in failing.collect()} == {"division by zero"}
    query = arriving(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("arrived").count() == 2  # a.PDF and b.pdf are one content


# --- queries over tables -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    texts = [*("a token of the of und" for _ in range(7)), None, "word " * 400 + "\nthe very last words of 2031"]
    spark.createDataFrame([(i, t, "en", "src1" if i < 6 else "src2") for i, t in enumerate(texts, 1)], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2, 0), (5, 1), (2, 1), (None, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_articles_hold_whole_texts(spark, tables):
    text = queries.articles(spark, tables).filter("doc_id = 9").first()["text"]
    assert text.count("word ") == 400 and "the very last words of 2031 Nothing else." in text
    assert any("the very last words of 2031" in r["text"] for r in queries.markdown_blocks(spark, tables).filter("doc_id = 9").collect())


def test_free_seats_count_all_documents(spark, tables):
    assert {tuple(r) for r in queries.free_seats(spark, tables).collect()} == {("src1", 35), ("src2", 36)}


def test_overview_of_all_documents(spark, tables):
    got = {r["item"]: (r["keywords_found"], r["analysed"]) for r in queries.batch_overview(spark, tables).collect()}
    assert got == {i: ("3/5" if i < 8 else "0/5", "sim" if i in (2, 5) else "nao") for i in range(1, 10)}


# --- odd tables, very long texts, plans ------------------------------------------------------------------------


def odd_documents(spark):
    """Null and repeated ids, null and empty texts, a document without pages, columns with clashing and dotted names."""
    long = "a" + " " * 1_000_000 + "b"
    texts = [("1", ["Introduction\nsame text here. It rose by 12,5."]), ("1", ["Introduction\nsame text here. It rose by 12,5."]), (None, ["Conclusion\nno id here."]), (None, ["Conclusion\nno id here, either."]), ("2", [""]), ("3", []), ("4", [long]), ("5", [None])]
    rows = [(i, "raw", "\n\n".join(p or "" for p in ps).strip() if ps != [None] else None, [(n, p, 0, len(p or "") + 2) for n, p in enumerate(ps, 1)], [], {"titulo": "T"}, []) for i, ps in texts]
    docs = spark.createDataFrame(rows, "doc_id string, view string, text string, pages array<struct<number:int,text:string,start:int,end:int>>, sections array<struct<name:string,title:string,start:int,end:int>>, metadata map<string,string>, warnings array<string>")
    return docs.withColumns({c: F.lit(9) for c in ("key", "norm", "places", "hit", "at", "a.b", "section", "slow")})


def test_odd_documents_through_view_and_skim(spark):
    view = markdown.view(odd_documents(spark))
    rows = view.collect()
    assert sorted((r["doc_id"] or "") for r in rows) == ["", "", "1", "1", "2", "3", "4", "5"]
    assert {r["text"] for r in rows if r["doc_id"] is None} == {"# T\n\n<!-- p. 1 -->\n\n## Conclusion\n\nno id here.", "# T\n\n<!-- p. 1 -->\n\n## Conclusion\n\nno id here, either."}
    assert next(r for r in rows if r["doc_id"] == "3")["pages"] == []
    got = skim.skim(view).collect()
    assert len(got) == len(rows) and all(not r["empty"] for r in got if r["doc_id"] in (None, "1", "4")) and all(r["empty"] for r in got if r["doc_id"] in ("2", "3", "5"))
    assert [len(r["numbers"]) for r in got if r["doc_id"] == "1"] == [1, 1]
    assert markdown.view(odd_documents(spark).filter("false")).count() == skim.skim(view.filter("false")).count() == 0
    assert markdown.blocks(spark.createDataFrame([(None, 1, "x\ny"), (None, 1, "z"), ("a", None, None)], "doc_id string, page int, text string")).count() == 2


def test_odd_documents_through_scan(spark):
    docs = odd_documents(spark)
    got = scan.scan(docs, ["same", "id"]).collect()
    assert len(got) == 16 and sum(r["total"] for r in got) == 4
    assert scan.totals(docs, ["same"], keep=("a.b",)).filter("`a.b` = 9").count() == 8
    for none in ([], [" ", "-"]):
        assert scan.scan(docs, none).count() == scan.totals(docs, none).count() == 0
    words = spark.createDataFrame([], "doc_id string, page int, idx int, text string, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([], "doc_id string, page int, height double, left double, bottom double")
    assert locate.mark_terms(words, boxes, []).count() == locate.mark_terms(words, boxes, ["a"]).count() == 0


def test_keyword_lists_that_repeat(spark):
    lists = spark.createDataFrame([("a, b",), ("a, b",), (None,), ("",), ("Été; ete, ﬁm",)], "raw string").withColumn("terms.x", F.lit(1))
    got = sorted((r["raw"], r["position"], r["keyword"]) for r in scan.parsed_keywords(lists).collect())
    assert got == [("a, b", 0, "a"), ("a, b", 0, "a"), ("a, b", 1, "b"), ("a, b", 1, "b"), ("Été; ete, ﬁm", 0, "Été"), ("Été; ete, ﬁm", 1, "ﬁm")]


def test_long_texts_take_linear_time(spark):
    import time

    df = spark.createDataFrame([("x" + " " * 400_000 + "y",), ("dado " * 60_000,), ("é, ﬁ " * 20_000,)], "text string")
    began = time.perf_counter()
    rows = df.withColumn("norm", T.fold("text")).select(F.length(T.strip(F.col("text"))).alias("n"), T.match_spans(F.col("norm"), T.keyword_pattern("dado")).alias("s")).collect()
    assert [r["n"] for r in rows] == [400_002, 299_999, 99_999] and time.perf_counter() - began < 30
    assert [tuple(x) for x in rows[1]["s"]] == [(5 * i, 5 * i + 4) for i in range(60_000)]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab. \n"), max_size=60), st.integers(1, 12), st.integers(-1, 9))
def test_chunk_borders(text, size, overlap):
    spans, back, begin, want = chunk.places(text, size, overlap), max(0, min(overlap, size // 2)), 0, []
    while begin < len(text):
        fits = text[begin : begin + size]
        end = begin + len(fits)
        if end < len(text):
            whole = [i for i in range(begin + size // 2, end - 1) if text[i : i + 2] == "\n\n"]
            part = [i + 1 for i in range(begin + size // 2, end - 1) if text[i : i + 2] == ". "]
            end = (whole or part or [end])[-1]
        if text[begin:end].strip():
            want.append((begin, end))
        if end >= len(text):
            break
        begin = max(begin + 1, end - back)
    assert spans == want


def test_plans_read_texts_once(spark, tables):
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans(queries.scan_total(spark, tables)) == 1
    assert "text#" not in queries.comparison_pivot(spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert scans(queries.skim_sections(spark, tables)) <= 3


def test_comparison_has_all_sources(spark, tables):
    assert {r["files"] for r in queries.comparison_pivot(spark, tables).collect()} == {"src1|src2"}
    more = spark.createDataFrame([(0, "a.b", 0, "k", 1), (1, "order", 0, "k", 2)], "item int, file string, position int, keyword string, total int")
    assert [tuple(r) for r in batch.comparison(more, ["a.b", "order"]).collect()] == [("k", 1, 2)]


def test_comparison_of_thousands_of_files(spark):
    rows = spark.range(5000).select(F.col("id").cast("int").alias("item"), F.concat(F.lit("f"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("file"))
    results = rows.select("item", "file", F.lit(0).alias("position"), F.lit("k").alias("keyword"), (F.col("item") % 7).alias("total"))
    results = results.union(rows.filter("item = 77").select("item", "file", F.lit(1), F.lit("rare"), F.lit(4)))
    tiles = batch.tiled(results, 64)
    got = {(r["keyword"], r["tile"]): r for r in tiles.collect()}
    assert len(got) == 2 * 79 and sum(sum(r["totals"]) for r in got.values()) == sum(i % 7 for i in range(5000)) + 4
    names = [f for t in range(79) for f in got["k", t]["files"]]
    assert names == [f"f{i:05}" for i in range(5000)] and [x for t in range(79) for x in got["k", t]["totals"]] == [i % 7 for i in range(5000)]
    assert got["rare", 1]["totals"][13] == 4 and sum(got["rare", 1]["totals"]) == 4
    lines = report.tile_lines(tiles)
    assert lines.count() == 3 * 79 and lines.filter("place is null and tile = 78").first()["line"] == "| keyword | f04992 | f04993 | f04994 | f04995 | f04996 | f04997 | f04998 | f04999 |\n|" + "---|" * 9
    assert batch.tiled(results.filter("false")).count() == 0


def test_passages_and_batch_reports(spark):
    page = "A primeira frase fala de outra coisa. A adesao ao tratamento aumentou muito no grupo tratado."
    words = spark.createDataFrame([("d", 2, i, w, 10.0 * i, 10.0 * i + 8, 20.0, 30.0) for i, w in enumerate(page.split())], "doc_id string, page int, idx int, text string, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([("d", 2, 100.0, 0.0, 0.0)], "doc_id string, page int, height double, left double, bottom double")
    texts = spark.createDataFrame([("d", 2, page)], "doc_id string, page int, text string")
    results = spark.createDataFrame([("d", 0, "Adesao"), ("d", 1, "grupo")], "doc_id string, position int, keyword string")
    findings = spark.createDataFrame([("d", "F1", "A adesao ao tratamento aumentou no grupo tratado.", "p. 2"), ("d", "F2", "galaxias distantes emitem radiacao infravermelha", ""), ("d", "F3", "", "")], "doc_id string, claim string, evidence string, page_label string")
    limits = spark.createDataFrame([("d", "A primeira frase fala de outra coisa")], "doc_id string, text string")
    terms, passages = locate.targets(["adesao"], results, findings, limits)
    assert [r["term"] for r in terms.orderBy("position").collect()] == ["adesao", "grupo"] and passages.count() == 3
    marks = locate.mark_passages(words, boxes, texts, passages)
    assert {(r["category"], r["comment"]) for r in marks.collect()} == {("evidencia", "Achado: F1"), ("limitacao", "Limitacao apontada na analise")}
    assert [r["target"] for r in locate.not_located(passages.select("doc_id", "target"), marks).collect()] == ["galaxias distantes emitem radiacao infravermelha"]
    assert {r["category"]: r["n"] for r in locate.by_category(marks).collect()} == {"evidencia": 1, "limitacao": 1}
    table = spark.createDataFrame([("k", 2, 0)], "keyword string, `a.pdf` int, `b.pdf` int")
    items = spark.createDataFrame([(0, "a.pdf", "A", "w", [1], True), (1, "b.pdf", None, "w", [1], False)], "item int, file string, title string, text string, pages array<int>, analysed boolean")
    absent = spark.createDataFrame([("k", ["b.pdf"])], "keyword string, files array<string>")
    reports = spark.createDataFrame([(0, "a.pdf", "# R\ntext")], "item int, file string, report string")
    lines = "\n".join(r["line"] for r in report.batch_markdown(reports, batch.overview(items), table, absent).collect())
    for part in ("**Artigos no lote:** 2 · **Analisados:** 1", "| k | 2 | 0 |", "- **k**: nao aparece em b.pdf", "# Arquivo: a.pdf\n\n## R\ntext"):
        assert part in lines
    done = spark.createDataFrame([("x", '{"a":1}'), ("y", '{"a":2}')], "doc_id string, report string")
    whole = report.batch_json(done, spark.createDataFrame([("y", "s", 0, 'q"b.pdf'), ("x", "s", 1, "a.pdf")], "doc_id string, session_id string, item int, file string")).first()["report"]
    assert [(a["a"], a["arquivo"]) for a in json.loads(whole)["artigos"]] == [(2, 'q"b.pdf'), (1, "a.pdf")]


def test_sql_of_listed_by_page_has_the_listed_ones_and_those_over_a_page_end(spark, tmp_path):
    import duckdb

    rows = [(1, 0, "token " * 30 + "the"), (1, 1, "of token " * 15), (2, 0, " "), (2, 1, "und the"), (2, 2, "-"), (2, 3, "of UND"), (3, 0, "none")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, queries.listed_by_page(spark, str(tmp_path)).collect()))
    # Ten of 45 tokens on the second page are listed; "the of" starts on the first.
    assert got == [(1, 1, 31, 31), (1, 2, 10, 31), (2, 2, 2, 2), (2, 4, 1, 2)]
    base = duckdb.connect()
    base.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(base.execute(f"SELECT doc_id, page, n, most FROM ({oracles.ORACLES['listed_by_page']})").fetchall()) == got


def test_latin_texts_are_passed_quickly_to_the_native_fold(spark):
    other = T._tables()[2]
    codes = [(chr(c),) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + [("a\u00bc",), ("\U0001f600",), (None,)]
    rows = spark.createDataFrame(codes, "c string")
    assert rows.filter(~T.folds_simply(F.col("c")).eqNullSafe(~F.col("c").rlike(other))).count() == 0
    long = spark.range(8).select(F.repeat(F.lit("Une phrase \u00e9tait l\u00e0. "), 20_000).alias("c")).localCheckpoint()

    def seconds(c):
        begin = time.perf_counter()
        assert long.filter(c).count() == 8
        return time.perf_counter() - begin

    slow, quick = (min(seconds(c) for _ in range(3)) for c in (~F.col("c").rlike(other), T.folds_simply(F.col("c"))))
    assert quick * 2 < slow
