"""Sources and sinks: files with their content hash, text pages through a pluggable extractor, and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Keys of a file's information dictionary and the names that they get.
INFO = {"/Title": "titulo", "/Author": "autores", "/Subject": "assunto", "/Keywords": "keywords_pdf", "/Producer": "produtor", "/CreationDate": "criado_em"}

#: Of a file's bytes: its pages' texts, its information dictionary, and warnings.
Extractor = Callable[[bytes], tuple[list[str], dict[str, str], list[str]]]


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(content_sha256, file_name, modified, content) of files below a folder whose name fits, whatever its case."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return hashed(read).filter(F.lower("file_name").rlike(_glob(pattern)))


def _glob(pattern: str) -> str:
    return "^" + pattern.lower().replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$"


def hashed(read: DataFrame) -> DataFrame:
    return read.select(F.sha2("content", 256).alias("content_sha256"), F.substring_index("path", "/", -1).alias("file_name"), F.col("modificationTime").alias("modified"), "content")


def is_upload(name: Column, mime: Column) -> Column:
    return (F.coalesce(mime, F.lit("")) == "application/pdf") | F.coalesce(F.lower(name).endswith(".pdf"), F.lit(False))


def plain_text(content: bytes) -> tuple[list[str], dict[str, str], list[str]]:
    """Extractor of UTF-8 text whose pages are parted by form feeds."""
    return content.decode("utf-8", "replace").split("\f"), {}, []


PROTECTED = "The file is protected by a password: its text may be incomplete."


def by_page(open_reader: Callable[[bytes], object]) -> Extractor:
    """An extractor from what opens a file: a reader with ``pages`` (each with ``extract_text()``), ``metadata``,
    ``is_encrypted`` and ``decrypt(password)``, as PDF libraries have.

    A protected file is tried with an empty password. A page that fails is empty and has a warning; the others stay.
    """

    def run(content: bytes) -> tuple[list[str], dict[str, str], list[str]]:
        reader, texts, warnings = open_reader(content), [], []
        if getattr(reader, "is_encrypted", False):
            try:
                reader.decrypt("")
            except Exception:  # noqa: BLE001  the pages may be readable all the same
                warnings.append(PROTECTED)
        for number, page in enumerate(reader.pages, 1):
            try:
                texts.append(page.extract_text() or "")
            except Exception as e:  # noqa: BLE001  a page that can't be read is a result
                texts.append("")
                warnings.append(f"Page {number} can't be read: {e}")
        return texts, {str(k): str(v) for k, v in (reader.metadata or {}).items() if v is not None}, warnings

    return run


def extracted(found: DataFrame, extractor: Extractor = plain_text) -> DataFrame:
    """(doc_id, file_name, pages, info, warnings, error): a file that fails has its error and no pages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, name, content in zip(part["content_sha256"], part["file_name"], part["content"], strict=True):
                try:
                    pages, info, warnings = extractor(bytes(content))
                    rows.append((doc, name, pages, list(info.items()), warnings, None))
                except Exception as e:  # noqa: BLE001  a file that can't be read is a result
                    rows.append((doc, name, None, [], [], str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "file_name", "pages", "info", "warnings", "error"])

    schema = "doc_id string, file_name string, pages array<string>, info array<struct<_1:string,_2:string>>, warnings array<string>, error string"
    rows = found.select("content_sha256", "file_name", "content").mapInPandas(run, schema)
    return rows.withColumn("info", F.map_from_entries("info"))


def pages(files_read: DataFrame) -> DataFrame:
    """(doc_id, page, text), pages from 1."""
    return files_read.select("doc_id", F.posexplode("pages").alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), F.coalesce("text", F.lit("")).alias("text"))


def metadata(files_read: DataFrame, column: str = "info") -> DataFrame:
    """(doc_id, metadata): known keys under their names, without blank values."""
    names = F.create_map(*(F.lit(x) for kv in INFO.items() for x in kv))
    known = F.map_filter(column, lambda k, v: names[k].isNotNull() & (T.strip(v) != ""))
    return files_read.select("doc_id", F.transform_values(F.transform_keys(known, lambda k, v: names[k]), lambda k, v: T.strip(v)).alias("metadata"))


#: Bytes of reports in a file, and in a group of rows that is read at once, about.
FILE_BYTES, GROUP_BYTES = 128 << 20, 1 << 20


def write_reports(reports: DataFrame, path: str, mode: str = "error", file_bytes: int = FILE_BYTES) -> None:
    """Reports (doc_id, report) in a few large files, sorted by id, in small groups of rows with bounds of their ids.

    A report is found by its id through these bounds. Of reports with one id, or none, all are kept. For a file for each
    report, write (name, content) to the sink ``whole_files``.
    """
    size = reports.agg(F.coalesce(F.sum(F.octet_length("report")), F.lit(0))).first()[0]
    order = [F.col("doc_id"), F.xxhash64("report")]
    rows = reports.select("doc_id", "report").repartitionByRange(max(1, -(-size // file_bytes)), *order).sortWithinPartitions(*order)
    rows.write.mode(mode).option("parquet.block.size", GROUP_BYTES).option("parquet.block.size.row.check.min", 100).option("parquet.page.size.row.check.min", 100).parquet(path)


def report(spark: SparkSession, path: str, doc_id) -> DataFrame:
    """(doc_id, report) of one document: only the groups of rows whose bounds hold its id are read."""
    return spark.read.parquet(path).filter(F.col("doc_id") == F.lit(doc_id))
