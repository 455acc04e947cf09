"""PDF files: structure, pages and words, damaged and protected files, annotations, and files of a folder."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Row

from vellumspark.operators import locate, model
from vellumspark.sources import ingest, pdf, pdf_files

PAGES = [["Telemedicina e adesão (2020)", "Segunda linha \\ com – “aspas”"], ["中文 İ texto", "não é"], []]


def plain_file(pages, encoding="/WinAnsiEncoding"):
    """A minimal file of lines as literal strings, written without the library."""
    parts, kids = [b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding %s >>" % encoding.encode()], []
    for lines in pages:
        body = b"BT /F1 12 Tf 14 TL 50 780 Td\n" + b"".join(b"(" + x.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj T*\n" for x in lines) + b"ET"
        parts.append(b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body))
        kids.append(len(parts) + 1)
        parts.append(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 612 792] /Resources << /Font << /F1 1 0 R >> >> /Contents %d 0 R >>" % (2 * len(pages) + 2, len(parts)))
    parts += [b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids)), b"<< /Type /Catalog /Pages %d 0 R >>" % (2 * len(pages) + 2), b"<< /Title (Um t\\355tulo) /Author () >>"]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, p in enumerate(parts, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, p)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(parts) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(parts) + 1, len(parts) - 1, len(parts), at))


def texts(content):
    return [p.extract_text() for p in pdf.Reader(content).pages]


def test_pages_are_read():
    lines = [["First (one) \\ line", "second – “line”"], [], ["third"]]
    content = plain_file(lines)
    assert texts(content) == ["\n".join(x) for x in lines] and pdf.Reader(content).metadata == {"/Title": "Um título", "/Author": ""}
    for packed in (True, False):
        made = pdf.rendered(PAGES, {"Title": "Ação"}, packed)
        assert texts(made) == ["\n".join(x) for x in PAGES] and pdf.Reader(made).metadata == {"/Title": "Ação"}
    words = pdf.Reader(content).pages[0].words()
    assert [w[0] for w in words] == ["First", "(one)", "\\", "line", "second", "–", "“line”"]
    assert all(a < b and top < bottom for _, a, b, top, bottom in words) and words[0][1] == 50 and words[4][3] - words[0][3] == 14


def test_damaged_cross_references_are_passed_by():
    content = plain_file([["one"], ["two"]])
    for bad in (content.replace(b"startxref", b"startxxxx"), content.replace(b"0000000009", b"0000000019"), content[: content.rindex(b"xref\n0") + 20], b"junk\n" + content):
        assert texts(bad) == ["one", "two"]
    for bad in (b"", b"no pdf", b"%PDF-1.4\nnothing", content[:40]):
        with pytest.raises(pdf.PdfError):
            pdf.Reader(bad)


def with_streams(content):
    """The file's objects in a stream of objects, with a cross-reference stream of predicted rows."""
    reader = pdf.Reader(content)
    plain = {n: v for n in reader.places if not isinstance(v := reader.get(pdf.Ref(n)), pdf.Stream) and v is not None}
    out, places = bytearray(b"%PDF-1.5\n"), {}
    for n in reader.places:
        if isinstance(v := reader.get(pdf.Ref(n)), pdf.Stream):
            places[n] = (1, len(out), 0)
            out += b"%d 0 obj\n" % n + pdf.written_object(v) + b"\nendobj\n"
    free = max(reader.places) + 1
    bodies = [pdf.written_object(v) + b"\n" for v in plain.values()]
    head = b" ".join(b"%d %d" % (n, sum(map(len, bodies[:i]))) for i, n in enumerate(plain)) + b" "
    places |= {n: (2, free, i) for i, n in enumerate(plain)} | {free: (1, len(out), 0)}
    packed = pdf.Stream({"Type": pdf.Name("ObjStm"), "N": len(plain), "First": len(head), "Filter": pdf.Name("FlateDecode")}, zlib.compress(head + b"".join(bodies)))
    out += b"%d 0 obj\n" % free + pdf.written_object(packed) + b"\nendobj\n"
    at, numbers = len(out), sorted([*places, free + 1])
    places[free + 1] = (1, at, 0)
    rows = [bytes([a]) + b.to_bytes(4, "big") + c.to_bytes(2, "big") for a, b, c in (places[n] for n in numbers)]
    above, data = bytes(7), b""
    for r in rows:
        data += b"\2" + bytes((x - y) & 255 for x, y in zip(r, above, strict=True))
        above = r
    info = {"Type": pdf.Name("XRef"), "Size": free + 2, "W": [1, 4, 2], "Index": [x for n in numbers for x in (n, 1)], "Root": reader.trailer["Root"], "Info": reader.trailer["Info"], "Filter": pdf.Name("FlateDecode"), "DecodeParms": {"Predictor": 12, "Columns": 7}}
    out += b"%d 0 obj\n" % (free + 1) + pdf.written_object(pdf.Stream(info, zlib.compress(data))) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % at
    return bytes(out)


def test_streams_of_objects_and_cross_reference_streams():
    content = with_streams(pdf.rendered(PAGES, {"Title": "Ação"}))
    reader = pdf.Reader(content)
    assert reader.by_stream and texts(content) == ["\n".join(x) for x in PAGES] and reader.metadata == {"/Title": "Ação"}
    marked = pdf.annotated(content, [mark(1)])
    assert marked.startswith(content) and len(pdf.annotations_of(marked)) == 1 and pdf.Reader(marked).by_stream
    assert texts(content.replace(b"startxref", b"startxxxx")) == texts(content)


def encrypted(content, password=b"", revision=3):
    """The file with strings and streams enciphered by its user password."""
    reader, n = pdf.Reader(content), 16 if revision == 3 else 5
    owner, first, rights = bytes(range(32)), b"0123456789abcdef", -4
    key = hashlib.md5((password + pdf._PAD)[:32] + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + first).digest()
    for _ in range(50 if revision == 3 else 0):
        key = hashlib.md5(key[:n]).digest()
    key, proof = key[:n], hashlib.md5(pdf._PAD + first).digest()
    for i in range(20):
        proof = pdf.rc4(bytes(b ^ i for b in key), proof)
    user = proof + bytes(16) if revision == 3 else pdf.rc4(key, pdf._PAD)
    out = {}
    for number in reader.places:
        value = reader.get(pdf.Ref(number))
        if value is not None:
            cipher = pdf.Reader.__new__(pdf.Reader)
            cipher.key = key
            value = {k: v.encode("latin-1") if type(v) is str else v for k, v in value.items()} if isinstance(value, dict) else value
            out[number] = cipher._open(value, number, 0)
    free = max(out) + 1
    out[free] = {"Filter": pdf.Name("Standard"), "V": 2 if revision == 3 else 1, "R": revision, "Length": 8 * n, "O": owner, "U": user, "P": rights}
    return pdf._with_references(bytearray(b"%PDF-1.4\n"), out, {"Size": free + 1, "Root": reader.trailer["Root"], "Info": reader.trailer["Info"], "Encrypt": pdf.Ref(free), "ID": [first, first]}, False)


@pytest.mark.parametrize("revision", [2, 3])
def test_protected_files(revision):
    lines = [["A protected line"], ["two"]]
    rows = list(pdf_files.page_rows("a", "a.pdf", encrypted(plain_file(lines), revision=revision)))
    assert [r[3] for r in rows] == ["A protected line", "two"] and rows[0][9] is None and dict(rows[0][8])["/Title"] == "Um título"
    rows = list(pdf_files.page_rows("a", "a.pdf", encrypted(plain_file(lines), b"secret", revision)))
    assert len(rows) == 2 and ingest.PROTECTED in rows[0][9] and "A protected" not in rows[0][3]


def test_fonts_and_operators():
    body = b"BT /F1 10 Tf 1 0 0 1 20 700 Tm [(Ca) -20 (f) 3 (e)] TJ 0 -12 TD (x) ' T* <41 42> Tj 3 1 (w) \" ET q 2 0 0 2 10 10 cm /Fm Do Q BI /W 1 ID \x00(\xff EI BT /F2 9 Tf (A\\101\\n) Tj ET"
    form = b"BT /F1 5 Tf 3 100 Td (in a form) Tj ET"
    objects = {
        1: {"Type": pdf.Name("Catalog"), "Pages": pdf.Ref(2)}, 2: {"Type": pdf.Name("Pages"), "Kids": [pdf.Ref(3), pdf.Ref(2)], "Count": 1, "MediaBox": [10, 20, 300, 800]},
        3: {"Type": pdf.Name("Page"), "Resources": {"Font": {"F1": pdf.Ref(4), "F2": pdf.Ref(5)}, "XObject": {"Fm": pdf.Ref(6)}}, "Contents": [pdf.Ref(7)]},
        4: {"Type": pdf.Name("Font"), "Subtype": pdf.Name("Type1"), "Encoding": {"Differences": [65, pdf.Name("eacute"), pdf.Name("fi"), 120, pdf.Name("uni4E2D")]}, "FirstChar": 32, "Widths": [500] * 100},
        5: {"Type": pdf.Name("Font"), "Subtype": pdf.Name("TrueType"), "Encoding": pdf.Name("MacRomanEncoding")}, 6: pdf.Stream({"Subtype": pdf.Name("Form"), "Matrix": [1, 0, 0, 1, 0, 0]}, form),
        7: pdf.Stream({"Filter": [pdf.Name("ASCII85Decode"), pdf.Name("FlateDecode")]}, __import__("base64").a85encode(zlib.compress(body)) + b"~>"),
    }
    page = pdf.Reader(pdf._with_references(bytearray(b"%PDF-1.4\n"), objects, {"Size": 8, "Root": pdf.Ref(1)}, False)).pages[0]
    text = page.extract_text()
    assert text.split() == ["Cafe", "中", "éﬁ", "w", "in", "a", "form", "AA"] and page.box == (10, 20, 300, 800)
    assert [w[0] for w in page.words()][:1] == ["Cafe"] and page.words()[0][1] == 10 and pdf.glyph("nosuchname") == ""


def mark(page, comment="Keyword: é"):
    return {"page": page, "rect": (1.0, 2.0, 3.0, 4.5), "quads": [1.0, 4.5, 3.0, 4.5, 1.0, 2.0, 3.0, 2.0], "colour": "ffe066", "comment": comment}


def test_annotations_are_appended():
    content = plain_file([["one"], ["two"]])
    once = pdf.annotated(content, [mark(2), mark(1, "a (b) \\")])
    assert once.startswith(content) and texts(once) == ["one", "two"] and pdf.annotated(content, []) == content
    assert pdf.annotations_of(once) == [mark(1, "a (b) \\") | {"rect": [1.0, 2.0, 3.0, 4.5]}, mark(2) | {"rect": [1.0, 2.0, 3.0, 4.5]}]
    twice = pdf.annotated(once, [mark(1)])
    assert twice.startswith(once) and len(pdf.annotations_of(twice)) == 3
    repaired = pdf.annotated(content.replace(b"startxref", b"startxxxx"), [mark(1)])
    assert texts(repaired) == ["one", "two"] and len(pdf.annotations_of(repaired)) == 1
    with pytest.raises(pdf.PdfError):
        pdf.annotated(content, [mark(3)])
    with pytest.raises(pdf.PdfError):
        pdf.annotated(encrypted(content), [mark(1)])


def test_pages_of_odd_contents(spark):
    good = plain_file([["one two"], ["three"]])
    stream = good.index(b"BT /F1")
    damaged = good[:stream] + good[stream:].replace(b"/F1 12 Tf", b"/Fx 12 Tf", 1)
    rows = [("a", "a.pdf", good), ("a", "b.pdf", good), ("c", "c.pdf", damaged), ("d", None, b"junk"), (None, "e.pdf", None), ("f", "f.pdf", b"")]
    found = spark.createDataFrame(rows, "content_sha256 string, file_name string, content binary").withColumn("page", F.lit(1))
    got = [tuple(r) for r in pdf_files.pages_of(found).select("doc_id", "file_name", "page", "text", "warning", F.col("error").isNotNull()).collect()]
    key = lambda r: repr(r)
    assert sorted(got, key=key) == sorted(
        [("a", "a.pdf", 1, "one two", None, False), ("a", "a.pdf", 2, "three", None, False), ("a", "b.pdf", 1, "one two", None, False), ("a", "b.pdf", 2, "three", None, False), ("c", "c.pdf", 1, "", "Page 1 can't be read: text without a font", False), ("c", "c.pdf", 2, "three", None, False), ("d", None, None, None, None, True), (None, "e.pdf", None, None, None, True), ("f", "f.pdf", None, None, None, True)], key=key
    )
    assert pdf_files.pages_of(found.filter("false")).count() == 0
    meta = {r["doc_id"]: r for r in pdf_files.metadata(pdf_files.pages_of(found)).collect()}
    assert meta["a"]["info"] == {"/Title": "Um título", "/Author": ""} and meta["c"]["warnings"] == ["Page 1 can't be read: text without a font"] and meta["d"]["error"]
    assert ingest.metadata(spark.createDataFrame([Row(doc_id="a", info=meta["a"]["info"])])).first()["metadata"] == {"titulo": "Um título"}


def test_marks_written_into_files(spark, tmp_path):
    """From files of a folder to annotated files of another, and back."""
    pdf_files.register(spark)
    source, target = tmp_path / "in" / "deep", tmp_path / "out"
    source.mkdir(parents=True)
    for i in range(5):
        (source / f"file{i}.PDF").write_bytes(plain_file([[f"about telemedicine {i}", "tele-", "medicine"], ["no word", "telemedicine again"]]))
    (source / "broken.pdf").write_bytes(b"%PDF-1.4 broken")
    (source / "other.txt").write_bytes(b"x")
    pages = spark.read.format("pdf").option("partitionBytes", 1500).load(str(tmp_path / "in"))
    assert pages.rdd.getNumPartitions() >= 3 and pages.filter("error is null").count() == 10 and pages.filter("error is not null").first()["file_name"] == "broken.pdf"
    by_bytes = pdf_files.pages_of(ingest.files(spark, str(tmp_path / "in")))
    assert sorted(map(str, by_bytes.drop("info").collect())) == sorted(map(str, pages.drop("info").collect()))
    docs = model.assemble(pages.filter("error is null").select("doc_id", "page", "text"))
    assert docs.filter("text like '%telemedicine 3%'").count() == 1
    words, boxes = pdf_files.words(pages)
    marks = locate.mark_terms(words, boxes, ["telemedicine"])
    files = ingest.files(spark, str(tmp_path / "in")).select(F.col("content_sha256").alias("doc_id"), "content")
    made = pdf_files.annotated(files, marks)
    assert made.filter("error is not null").count() == 0  # an unmarked file stays, whatever it is
    made.select(F.concat("doc_id", F.lit(".pdf")).alias("name"), "content").write.format("whole_files").mode("append").save(str(target))
    assert sorted(p.suffix for p in target.iterdir()) == [".pdf"] * 6
    for p in source.glob("file*"):
        out = (target / f"{hashlib.sha256(p.read_bytes()).hexdigest()}.pdf").read_bytes()
        found = pdf.annotations_of(out)
        assert out.startswith(p.read_bytes()) and [(a["page"], a["comment"], a["colour"]) for a in found] == [(1, "Keyword: telemedicine", "ffe066"), (2, "Keyword: telemedicine", "ffe066")]
        assert found[0]["rect"][0] > 50 and found[0]["rect"][3] > found[0]["rect"][1] > 700


def test_repeated_tasks_leave_no_double_files(tmp_path):
    rows = [Row(name="a.pdf", content=b"1"), Row(name="b/c.pdf", content=b"2"), Row(name="a.pdf", content=b"3"), Row(name="n", content=None)]
    writer = pdf_files.FilesWriter(str(tmp_path), False)
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    assert lost.folder != kept.folder
    writer.commit([kept, None])
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"a.pdf": b"1", "b_c.pdf": b"2"}
    again = pdf_files.FilesWriter(str(tmp_path), False)
    message = again.write(iter(rows[:1]))
    with pytest.raises(FileExistsError):
        again.commit([message])
    again.abort([message])
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.pdf", "b_c.pdf"]
    over = pdf_files.FilesWriter(str(tmp_path), True)
    over.commit([over.write(iter([Row(name="a.pdf", content=b"new")]))])
    assert (tmp_path / "a.pdf").read_bytes() == b"new"


def test_rendered_tables_come_back(spark):
    rows = [(1, ["a b\nc", "", None], {"Title": "é"}), (1, ["second"], None), (None, ["中"], {}), (3, None, None), (4, [], None)]
    docs = spark.createDataFrame(rows, "doc_id long, pages array<string>, info map<string,string>")
    got = sorted(((r["doc_id"], r["page"], r["text"], (r["info"] or {}).get("/Title"), r["error"] is None) for r in pdf_files.pages_of(pdf_files.rendered(docs), "doc_id", "doc_id").collect()), key=repr)
    assert got == sorted([("1", 1, "a b\nc", "é", True), ("1", 2, "", None, True), ("1", 3, "", None, True), ("1", 1, "second", None, True), (None, 1, "中", None, True), ("3", None, None, None, False), ("4", None, None, None, False)], key=repr)


def test_words_of_many_matches(spark):
    """A page of 10^5 words and 10^4 matches, against a plain count, and odd words."""
    import time

    table = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").cast("int").alias("idx"), F.when(F.col("id") % 10 == 3, "the").otherwise(F.concat(F.lit("w"), F.col("id") % 7)).alias("text"))
    words = table.withColumns({"x0": F.col("idx") * 1.0, "x1": F.col("idx") + 0.5, "top": F.lit(1.0), "bottom": F.lit(2.0)})
    boxes = spark.createDataFrame([(1, 1, 10.0, 0.0, 0.0)], "doc_id int, page int, height double, left double, bottom double")
    began = time.time()
    got = sorted(r["rects"][0]["x0"] for r in locate.mark_terms(words, boxes, ["the"], False).collect())
    assert got == [float(i) for i in range(3, 100_000, 10)] and time.time() - began < 60
    odd = spark.createDataFrame([(1, 1, i, t, float(i), i + 0.5, 1.0, 2.0) for i, t in enumerate(["a", "tele", "medicine", "x\u00a0tele-medicine", "", "tele", "-", "medicine", "b"])], words.schema)
    marks = locate.mark_terms(odd, boxes, ["tele medicine"], False).collect()
    assert sorted((r["rects"][0]["x0"], r["rects"][0]["x1"]) for r in marks) == [(1.0, 2.5), (3.0, 3.5), (5.0, 7.5)]


def test_a_page_is_drawn_once_for_its_text_and_its_words(monkeypatch):
    from vellumspark.sources import pdf, pdf_files

    drawn, draw = [], pdf.Page._draw
    monkeypatch.setattr(pdf.Page, "_draw", lambda self, *rest: (drawn.append(1), draw(self, *rest))[1])
    rows = list(pdf_files.page_rows("1", "n", pdf.rendered([["one two"], ["three"]], {})))
    assert [r[3] for r in rows] == ["one two", "three"] and [len(r[4]) for r in rows] == [2, 1]
    assert len(drawn) == 2
