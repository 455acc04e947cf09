"""PDF files as tables: pages with their words from any column of bytes, a data source for folders, annotated files.

``pages_of`` reads bytes wherever Spark has them (``ingest.files`` reads any file system). The data source ``pdf`` lists a
folder on the driver, names and sizes alone, puts files together to partitions of bounded bytes, and opens them on the
executors. The data source ``whole_files`` writes rows (name, content) as files: tasks write below a folder of their
attempt, and only what the job has committed is moved to its place, so a repeated or failed task leaves nothing behind.

Defined results: a file that can't be read is one row with its error and no page; a page that can't be read has an empty
text and a warning, the others stay; a protected file is tried with an empty password. A null content has an error, too.
Files that repeat are read as often as they are there.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators import locate
from . import pdf
from .ingest import PROTECTED

#: Bytes of files in a partition, and of texts and words in a batch of rows, about.
PARTITION_BYTES, BATCH_ROWS = 64 << 20, 64

_WORDS = pa.list_(pa.struct([("idx", pa.int32()), ("text", pa.string()), *((c, pa.float64()) for c in ("x0", "x1", "top", "bottom"))]))
_SCHEMA = pa.schema([("doc_id", pa.string()), ("file_name", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("words", _WORDS), ("height", pa.float64()), ("left", pa.float64()), ("bottom", pa.float64()), ("info", pa.map_(pa.string(), pa.string())), ("warning", pa.string()), ("error", pa.string())])
DDL = "doc_id string, file_name string, page int, text string, words array<struct<idx:int,text:string,x0:double,x1:double,top:double,bottom:double>>, height double, left double, bottom double, info map<string,string>, warning string, error string"


def page_rows(doc_id: str | None, name: str | None, content: bytes | None) -> Iterator[tuple]:
    """A row for each page of a file, in order; its information stands on the first."""
    fault = lambda e: (doc_id, name, None, None, None, None, None, None, None, None, str(e) or type(e).__name__)
    try:
        if content is None:
            raise pdf.PdfError("there are no bytes")
        reader, notes = pdf.Reader(content), []
        if reader.is_encrypted:
            try:
                reader.decrypt("")
            except Exception:  # noqa: BLE001  the pages may be readable all the same
                notes.append(PROTECTED)
        pages = reader.pages
        try:
            info = list(reader.metadata.items())
        except Exception as e:  # noqa: BLE001  pages don't need it
            info = []
            notes.append(f"The information can't be read: {e}")
    except Exception as e:  # noqa: BLE001  a file that can't be read is a result
        yield fault(e)
        return
    for number, page in enumerate(pages, 1):
        own, text, words, box = notes if number == 1 else [], "", [], (0.0, 0.0, 612.0, 792.0)
        try:
            box = page.box
            text = page.extract_text()
            words = [dict(zip(("idx", "text", "x0", "x1", "top", "bottom"), (i, *w), strict=True)) for i, w in enumerate(page.words())]
        except Exception as e:  # noqa: BLE001  a page that can't be read is a result
            text, words = "", []
            own = [*own, f"Page {number} can't be read: {e}"]
        yield doc_id, name, number, text, words, box[3] - box[1], box[0], box[1], info if number == 1 else None, "; ".join(own) or None, None


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH_ROWS:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    clean = lambda v: v.encode("utf-8", "replace").decode() if isinstance(v, str) else v  # noqa: E731  no lone surrogates
    return pa.RecordBatch.from_arrays([pa.array([clean(v) for v in c], f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for i in range(batch.num_rows):
            yield from _batches(page_rows(*(batch.column(c)[i].as_py() for c in range(3))))


def pages_of(found: DataFrame, id_col: str = "content_sha256", name_col: str = "file_name", content_col: str = "content") -> DataFrame:
    """Rows of ``DDL``, one per page, from files as ``ingest.files`` gives them or from any column of bytes."""
    return found.select(F.col(id_col).cast("string").alias("id"), F.col(name_col).cast("string").alias("name"), F.col(content_col).alias("content")).mapInArrow(_read, DDL)


def words(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, page, idx, text, x0, x1, top, bottom) and (doc_id, page, height, left, bottom), as ``locate`` takes them."""
    return pages.select("doc_id", "page", F.inline("words")), pages.filter("page is not null").select("doc_id", "page", "height", "left", "bottom")


def metadata(pages: DataFrame) -> DataFrame:
    """(doc_id, info, warnings, error) of each file; files that repeat are one."""
    warnings = F.array_sort(F.collect_set("warning"))
    return pages.groupBy("doc_id").agg(F.min(F.struct("page", F.map_entries("info").alias("info")))["info"].alias("entries"), warnings.alias("warnings"), F.min("error").alias("error")).select("doc_id", F.map_from_entries("entries").alias("info"), "warnings", "error")


def _render(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        made = [None if pages is None else pdf.rendered([(p or "").split("\n") for p in pages], {x["key"]: x["value"] or "" for x in info or []}) for pages, info in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["doc_id", "content"])


def rendered(docs: DataFrame) -> DataFrame:
    """(doc_id, content): a file for each row of (doc_id, pages: array<string>, info: map<string,string>)."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "pages", F.map_entries("info").alias("info")).mapInArrow(_render, "doc_id string, content binary")


def _annotate(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for i in range(batch.num_rows):
            doc_id, content, marks = (batch.column(c)[i].as_py() for c in range(3))
            made, error = None, None
            try:
                made = pdf.annotated(content, [m | {"rect": tuple(m["rect"].values())} for m in marks or []])
            except Exception as e:  # noqa: BLE001  a file that can't be annotated is a result
                error = str(e) or type(e).__name__
            yield pa.RecordBatch.from_arrays([pa.array([doc_id]), pa.array([made], pa.binary()), pa.array([error], pa.string())], names=["doc_id", "content", "error"])


def annotated(files: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, content, error): files (doc_id, content) with the marks of ``locate`` appended, unmarked ones as they are.

    A file's marks come together in one row, as its bytes do. Of files that repeat an id each gets all marks.
    """
    notes = locate.annotations(marks).withColumn("doc_id", F.col("doc_id").cast("string"))
    order = F.struct("page", "category", "comment", "rect", "quads", "colour")
    listed = notes.groupBy("doc_id").agg(F.array_sort(F.collect_list(order)).alias("marks"))
    rows = files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").join(listed, "doc_id", "left")
    return rows.select("doc_id", "content", "marks").mapInArrow(_annotate, "doc_id string, content binary, error string")


def _annotations(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for i in range(batch.num_rows):
            doc_id, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            found = pdf.annotations_of(content) if content is not None else []
            for at in range(0, len(found), BATCH_ROWS):
                part = found[at : at + BATCH_ROWS]
                columns = [[doc_id] * len(part), [a["page"] for a in part], [a["comment"] for a in part], [a["colour"] for a in part], [len(a["quads"]) // 8 for a in part], [a["rect"] for a in part]]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "page", "comment", "colour", "boxes", "rect"])


def annotations(files: DataFrame) -> DataFrame:
    """(doc_id, page, comment, colour, boxes, rect): the highlights of files (doc_id, content)."""
    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(_annotations, "doc_id string, page int, comment string, colour string, boxes int, rect array<double>")


# --- data sources --------------------------------------------------------------------------------------------


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]) -> None:
        super().__init__(0)
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, path: str, most_bytes: int) -> None:
        self.path, self.most_bytes = path, most_bytes

    def partitions(self) -> list[Files]:
        """Files by name, together while they are small: names and sizes alone come to the driver."""
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        found = sorted((f.path, f.size or 0) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and f.base_name.lower().endswith(".pdf"))
        out, held, size = [], [], 0
        for path, n in found:
            if held and size + n > self.most_bytes:
                out.append(Files(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(tuple(held))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                content = f.read()
            yield from _batches(page_rows(hashlib.sha256(content).hexdigest(), path.rsplit("/", 1)[-1], content))


class PdfSource(DataSource):
    """``spark.read.format("pdf").load(folder)``; option ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return DDL

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options["path"], int(self.options.get("partitionbytes", self.options.get("partitionBytes", PARTITION_BYTES))))


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: tuple[str, ...]


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _root(self):
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        return system, root.rstrip("/")

    def write(self, rows: Iterator) -> Written:
        """A task's files, in a folder of this attempt."""
        system, root = self._root()
        folder, names = f"{root}/_temporary/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(folder)
        for row in rows:
            name = row["name"].replace("/", "_")
            if row["content"] is None or name in names:
                continue  # a null is no file; of rows with one name in a task the first counts
            with system.open_output_stream(f"{folder}/{name}") as out:
                out.write(bytes(row["content"]))
            names.append(name)
        return Written(folder, tuple(names))

    def commit(self, messages: list) -> None:
        """What the job's tasks have written moves to its place; of one name from several tasks the last by name stays."""
        system, root = self._root()
        system.create_dir(root)
        for m in filter(None, messages):
            for name in m.names:
                if not self.overwrite and system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                    raise FileExistsError(f"{root}/{name}")
                system.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """Delete what attempts of this job left, those that were never committed included."""
        system, root = self._root()
        if system.get_file_info(f"{root}/_temporary/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_temporary/{self.job}")
        left = fs.FileSelector(f"{root}/_temporary", allow_not_found=True)
        if system.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory and not system.get_file_info(left):
            system.delete_dir(f"{root}/_temporary")


class FilesSink(DataSource):
    """``df.write.format("whole_files").mode("append").save(folder)`` for rows (name, content); mode overwrite replaces files of the same name."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make both data sources known to a session."""
    spark.dataSource.register(PdfSource)
    spark.dataSource.register(FilesSink)
