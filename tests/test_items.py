"""Items of sessions, what a deep reading tells, and the small rules around them."""

from pyspark.sql import functions as F

from vellumspark.functions import progress
from vellumspark.functions import text as T
from vellumspark.operators import batch, deep, items, scan
from vellumspark.sources import ingest
from vellumspark.streaming.ingest import write_events

PAGES = "session_id string, doc_id string, name string, pages array<struct<number:int,text:string,start:int,end:int>>"


def held(spark):
    """Two sessions, an item that repeats, one without pages, one without an id."""
    page = lambda n, t: (n, t, 0, 0)
    rows = [("s", "a", "A", [page(1, "one"), page(2, "two")]), ("s", "a", "A", [page(1, "one"), page(2, "two")]), ("s", "b", "B", []), ("t", "a", "A", [page(1, "other")]), ("t", None, "N", None)]
    return spark.createDataFrame(rows, PAGES)


def asked(spark):
    rows = [(1, "s", "a", 2), (2, "s", "a", 3), (3, "s", "a", 0), (4, "s", "b", 1), (5, "t", "a", 1), (6, "t", "b", 1), (7, None, "a", 1), (8, "s", None, 1), (9, "t", None, 1), (10, "s", "a", None), (1, "s", "a", 2)]
    return spark.createDataFrame(rows, "n int, session_id string, doc_id string, number int").withColumns({"pages": F.lit("clash"), "a.b": F.lit(1)})


def test_pages_and_items_that_requests_name(spark):
    got = items.page(asked(spark), held(spark))
    assert got.columns == ["n", "session_id", "doc_id", "number", "pages", "a.b", "status", "error", "page_text"]
    rows = sorted((r["n"], r["status"], r["page_text"]) for r in got.collect())
    assert rows == [(1, 200, "two"), (1, 200, "two"), *((n, 404, None) for n in (2, 3, 4)), (5, 200, "other"), *((n, 404, None) for n in (6, 7, 8, 9, 10))]
    assert {r["n"]: r["error"] for r in got.collect() if r["error"]} == {n: items.NO_PAGE if n in (2, 3, 4, 10) else items.NO_ITEM for n in (2, 3, 4, 6, 7, 8, 9, 10)}
    whole = items.item(asked(spark), held(spark))
    assert {(r["n"], r["status"], r["name"], r["pages"]) for r in whole.collect() if r["n"] < 7} == {(1, 200, "A", "clash"), (2, 200, "A", "clash"), (3, 200, "A", "clash"), (4, 200, "B", "clash"), (5, 200, "A", "clash"), (6, 404, None, "clash")}
    assert whole.count() == 11 and items.page(asked(spark), held(spark).filter("false")).filter("status = 404").count() == 11
    assert items.page(asked(spark).filter("false"), held(spark)).count() == 0


def test_removal_and_seats(spark):
    have = held(spark)
    assert {(r["session_id"], r["doc_id"], r["seats"], r["limit"]) for r in items.listing(have).collect()} == {("s", "a", 3, 5), ("s", "b", 3, 5), ("t", "a", 3, 5), ("t", None, 3, 5)}
    out = spark.createDataFrame([("s", "a"), ("s", "x"), ("u", "a"), (None, None)], "session_id string, doc_id string")
    assert {tuple(r) for r in items.removals(have, out).select("session_id", "doc_id", "status", "seats").collect()} == {("s", "a", 200, 4), ("s", "x", 404, 4), ("u", "a", 404, 5), (None, None, 404, 5)}
    assert {(r["session_id"], r["doc_id"]) for r in items.removed(have, out).collect()} == {("s", "b"), ("t", "a"), ("t", None)}
    assert {r["session_id"] for r in items.cleared(have, out).collect()} == {"t"}
    assert items.cleared(have, out.filter("false")).count() == 5


def test_what_was_refused(spark):
    uploads = spark.createDataFrame([("s", i, h, f"{i}.pdf") for i, h in enumerate("aabcd", 1)], "session_id string, arrival int, content_sha256 string, file_name string")
    read = spark.createDataFrame([("a", None), ("b", "broken")], "doc_id string, error string")
    got = {r["file_name"]: r["reason"] for r in items.refusals(batch.triage(uploads, limit=3), read).collect()}
    assert got == {"2.pdf": batch.DUPLICATE, "3.pdf": "nao foi possivel ler o PDF (broken)", "5.pdf": batch.FULL.format(3)}


def test_overview_by_id(spark):
    rows = spark.createDataFrame([(1, "same.pdf"), (2, "same.pdf"), (None, "x")], "item int, file string")
    table = spark.createDataFrame([(1, "same.pdf", "t", 3, 70, 1, "nao", "2/4"), (1, "same.pdf", "t", 3, 70, 1, "nao", "2/4")], "item int, file string, title string, pages int, words int, minutes int, analysed string, keywords_found string")
    assert {tuple(r) for r in items.with_overview(rows, table).select("item", "file", "keywords_found", "n_pages", "n_words").collect()} == {(1, "same.pdf", "2/4", 3, 70), (2, "same.pdf", "—", None, None), (None, "x", "—", None, None)}


def test_events_of_a_deep_reading(spark):
    assert deep.shares((), 3) == [] and deep.shares(("syntheses",), 2) == [("synthesis 1/2", 0.725), ("synthesis 2/2", 1.0)]
    assert deep.shares(n_keywords=1) == [("summary", 0.45), ("findings", 0.56), ("limitations", 0.67), ("terms", 0.78), ("synthesis 1/1", 1.0)]
    read = spark.createDataFrame([("s", 1, "a", "A"), ("s", 2, "b", "B"), ("t", 1, "a", "A")], "session_id string, position int, doc_id string, name string")
    outcomes = spark.createDataFrame([("s", "a", None), ("s", "b", "down"), ("s", "a", None)], "session_id string, doc_id string, error string")
    told = deep.events(read, outcomes, ("summary",)).orderBy("session_id", "position", "step").collect()
    assert [(r["session_id"], r["position"], r["kind"], r["message"]) for r in told] == [
        ("s", 0, "inicio", None), ("s", 1, "artigo_inicio", None), ("s", 1, "progresso", None), ("s", 1, "artigo_fim", None), ("s", 2, "artigo_inicio", None), ("s", 2, "artigo_erro", "down"), ("s", 3, "fim", "1; B"),
        ("t", 0, "inicio", None), ("t", 1, "artigo_inicio", None),
    ]
    assert deep.events(read.filter("false"), outcomes).count() == 0


def test_events_are_written_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("inicio", 2), ("fim", 1)], "tipo string, n int").write.mode("append").json(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema("tipo string, n int").json(str(tmp_path / "in"))
        write_events(stream, str(tmp_path / "out"), str(tmp_path / "done")).awaitTermination(60)
    assert {r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {'{"tipo":"inicio","n":2}', '{"tipo":"fim","n":1}'} and spark.read.text(str(tmp_path / "out")).count() == 2


def test_scan_with_syntheses(spark):
    columns = "doc_id string, position int, keyword string, total int, pages array<int>, density double"
    scanned = spark.createDataFrame([("a", 0, "k", 2, [1], 1.0), ("a", 1, "m", 0, [], 0.0)], columns)
    made = spark.createDataFrame([("a", 0, "k", 9, [9], 9.0, "says"), ("b", 0, "k", 1, [1], 1.0, "alone")], columns + ", synthesis string")
    assert {(r["doc_id"], r["keyword"], r["total"], r["synthesis"]) for r in deep.merged_keywords(scanned, made).collect()} == {("a", "k", 2, "says"), ("a", "m", 0, ""), ("b", "k", 1, "alone")}


def test_small_rules(spark):
    value = lambda c: spark.range(1).select(c).first()[0]
    raw = F.lit(' a; "b",, a \n\n c ')
    assert value(T.keyword_chips(raw)) == ["a", '"b"', "a", "c"] and value(T.without_chip(raw, F.lit("a"))) == '"b", c' and value(T.keyword_chips(F.lit(None).cast("string"))) == []
    assert value(deep.bad_options(F.lit(0.2), F.lit(8000), F.lit(24), F.lit(6144))) == []
    assert value(deep.bad_options(F.lit(1.5), F.lit(500), F.lit(None).cast("int"), F.lit(5000))) == ["temperature", "chunk_size", "context"]
    left = lambda elapsed, done, finished, n: value(progress.batch_remaining(F.lit(elapsed).cast("double"), F.lit(done).cast("double"), F.lit(finished).cast("array<double>"), F.lit(n)))
    assert left(10, 0.5, [20.0, 40.0], 2) == 70 and left(100, 0.5, [], 1) == 300 and left(5, 0.5, [], 3) == 5
    assert left(None, None, [30.0], 1) == 60 and left(None, None, [], 1) is None and left(0, 0, None, 2) is None


class Page:
    def __init__(self, text):
        self.text = text

    def extract_text(self):
        if self.text == "bad":
            raise ValueError("torn")
        return self.text


class Reader:
    """What a library for files with pages gives."""

    def __init__(self, content):
        self.pages = [Page(t) for t in content.decode().split("|")]
        self.metadata = {"/Title": " T ", "/Author": None}
        self.is_encrypted = content.startswith(b"locked")

    def decrypt(self, password):
        raise ValueError("needs another password")


def test_pages_that_fail_stay_alone(spark):
    found = spark.createDataFrame([("1", "a.pdf", bytearray(b"x|bad|y")), ("2", "b.pdf", bytearray(b"locked|")), ("3", "c.pdf", bytearray(b"\xff"))], "content_sha256 string, file_name string, content binary")
    run = ingest.by_page(Reader)
    assert run(b"x|bad|y") == (["x", "", "y"], {"/Title": " T "}, ["Page 2 can't be read: torn"])
    assert run(b"locked|") == (["locked", ""], {"/Title": " T "}, [ingest.PROTECTED])
    plain = ingest.extracted(found, lambda content: (content.decode().split("|"), {"/Title": "T"}, []))
    assert {r["doc_id"]: r["error"] is None for r in plain.collect()} == {"1": True, "2": True, "3": False}
    assert {tuple(r) for r in ingest.pages(plain).collect()} == {("1", 1, "x"), ("1", 2, "bad"), ("1", 3, "y"), ("2", 1, "locked"), ("2", 2, "")}
    assert {r["doc_id"]: r["metadata"] for r in ingest.metadata(plain).collect()} == {"1": {"titulo": "T"}, "2": {"titulo": "T"}, "3": {}}


def test_notes_are_asked_once(spark, tmp_path):
    """Notes are written, so all stages, and reruns, read what the client said the first time."""

    class Counting:
        def __init__(self, path):
            self.path = path

        def chat(self, prompt, system, as_json):
            import uuid

            with open(f"{self.path}/{'json' if as_json else 'note'}-{uuid.uuid4().hex}", "w"):
                return "{}" if as_json else "a note"

    page = (1, "Some text of an article.", 0, 26)
    docs = spark.createDataFrame([("0", "markdown", page[1], [page], [], {}, [])], "doc_id string, view string, text string, pages array<struct<number:int,text:string,start:int,end:int>>, sections array<struct<name:string,title:string,start:int,end:int>>, metadata map<string,string>, warnings array<string>")
    rows = deep.analyse(docs, scan.scan(docs, ["absent"]), Counting(str(tmp_path)))
    assert rows.count() == len(rows.collect()) == 1
    assert len(list(tmp_path.glob("note-*"))) == 1


def test_reports_in_a_few_files(spark, tmp_path):
    """A hundred thousand reports: few files, and one found without reading the others."""
    path = str(tmp_path / "reports")
    n = 100_000
    reports = spark.range(n).select(F.format_string("doc%06d", F.col("id")).alias("doc_id"), F.concat(F.lit("# Report "), F.sha2(F.col("id").cast("string"), 512), F.sha2((-F.col("id")).cast("string"), 512)).alias("report"), F.lit(1).alias("other"))
    reports = reports.unionByName(spark.createDataFrame([(None, "none", 1), ("doc000007", "second", 1)], "doc_id string, report string, other int")).repartition(7)
    ingest.write_reports(reports, path, file_bytes=8 << 20)
    assert len(list((tmp_path / "reports").glob("*.parquet"))) <= 4
    assert ingest.report(spark, path, "doc054321").collect() == reports.filter("doc_id = 'doc054321'").select("doc_id", "report").collect()
    assert ingest.report(spark, path, "doc000007").count() == 2 and ingest.report(spark, path, "nobody").count() == 0 and spark.read.parquet(path).count() == n + 2
    found = ingest.report(spark, path, "doc054321")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,doc054321)]" in found._jdf.queryExecution().executedPlan().toString()
    found.collect()
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < n / 5
    ingest.write_reports(reports.filter("false"), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 0
