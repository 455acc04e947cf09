"""Token ids as binary files: Arrow IPC files whose batches hold fixed-size lists, read again without copying.

Documents are put in ascending order of their id (ties by a hash of the text), cut into shards of about equal text size, encoded and
packed one after another into sequences of equal length. A shard is two Arrow files in the shared folder:

* ``<name>.arrow``: ``ids``, fixed-size lists of ``length`` token ids, and ``mask``, fixed-size lists of ``length``
  booleans (true: a token), which Arrow keeps as bits. Both are read as views of the file. Only a shard's last sequence
  is padded.
* ``<name>-index.arrow``: ``doc_id``, ``position`` of its first id in the shard, and ``n_tokens`` with the end id.

A task writes under a name of its own and reports it only at its end, so a repeated or lost task leaves at most unused
files. The manifest (a row per shard) is a table in the same folder.

Defined results: a null or empty text is the end id alone; a null id comes first; repeated rows are written as often as
they occur; an empty table gives no shards. Other columns are not looked at.
"""

from __future__ import annotations

import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import named, new_path, qualified, table, written

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
LENGTH = 2048
#: Sequences in an Arrow batch.
GROUP = 64
#: Bytes of text that a shard holds on average.
SHARD_BYTES = 16 << 20
#: Texts that are encoded together.
TOGETHER = 256


class Encoder:
    """Encodes texts piece by piece and remembers the ids of pieces.

    Lower-cased Latin text is cut into runs of letters, single digits and runs of other signs, and blanks go. The
    tokenizer gives each piece the ids that it has in the whole text: its normalizer composes nothing across these
    borders in composed text, and its splitting pattern has a border at each of them. Where that may not hold
    (apostrophes, underlines, special tokens, other scripts, decomposed characters), what stands between ASCII blanks
    stays whole; across a blank it always holds.
    """

    #: Pieces that are remembered, the first that come; and the characters of the longest of them.
    MOST, LONGEST = 250_000, 48
    _PIECES = re.compile(r"[^\W\d_]+|\d|[^\w\s]+")
    _WHOLE = re.compile("['_\u0130\x1c-\x1f\x80-\x9f]|[^\0-\u024f\u2010-\u2027\u20ac]|<\\|")

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Runs of lower-case letters need no normalizer and no splitting: the model takes them with their bytes as letters.
        self.model = self.tokenizer.model
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.letters = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(kept)))}
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.end = array(self.code, [end_id]).tobytes()
        self.known: dict[str, bytes] = {}

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if not self._WHOLE.search(text) and unicodedata.is_normalized("NFC", text):
            return self._PIECES.findall(text.lower())
        out: list[str] = []
        for unit in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "):
            if self._WHOLE.search(unit) or not unicodedata.is_normalized("NFC", unit):
                out.append(unit)
            else:
                out += self._PIECES.findall(unit.lower())
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text with the end id, as little-endian numbers."""
        cut = list(map(self._cut, texts))
        new = set().union(*cut).difference(self.known)
        room = self.MOST - len(self.known)
        plain = [p for p in new if p.isalpha() and not self._WHOLE.search(p)]
        other = list(new.difference(plain))
        tokenize, code = self.model.tokenize, self.code
        as_letters = [p if p.isascii() else p.encode().decode("latin-1").translate(self.letters) for p in plain]
        self.known.update(zip(plain, [array(code, [t.id for t in tokenize(p)]).tobytes() for p in as_letters], strict=True))
        self.known.update(zip(other, [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)], strict=True))
        for pieces in cut:
            yield b"".join(map(self.known.__getitem__, pieces)) + self.end
        for i, p in enumerate(new):
            if i >= room or len(p) > self.LONGEST:
                del self.known[p]


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


class _Packer:
    """Writes ids as batches of GROUP sequences; the last batch may have fewer, the last sequence padding."""

    def __init__(self, sink, kind: np.dtype, length: int) -> None:
        self.kind, self.length = kind, length
        self.full = GROUP * length * kind.itemsize
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held, self.size = [], 0

    def add(self, data: bytes) -> None:
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.full:
            joined = b"".join(self.held)
            for at in range(0, whole := self.size // self.full * self.full, self.full):
                self._write(joined[at : at + self.full])
            self.held, self.size = [joined[whole:]], self.size - whole

    def _write(self, data: bytes) -> None:
        n = len(data) // self.kind.itemsize
        padded = -(-n // self.length) * self.length
        ids = np.frombuffer(data.ljust(padded * self.kind.itemsize, b"\0"), self.kind)
        mask = np.arange(padded) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._write(b"".join(self.held))
        self.writer.close()


class TokenFile:
    """Random access to a shard's sequences and masks; local files are mapped, not read."""

    def __init__(self, path: str) -> None:
        system, name = _file_system(path)
        local = isinstance(system, pa.fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(name) if local else system.open_input_file(name))
        self.length = self.reader.schema.field("ids").type.list_size
        self._held: tuple = (None, None, None)

    def _group(self, g: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if self._held[0] != g:
            batch = self.reader.get_batch(g)
            self._held = (g, batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten())
        return self._held[1:]

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids of sequence i and its mask (True: a token), both views of the file."""
        ids, mask = self._group(i // GROUP)
        at = i % GROUP * self.length
        return ids[at : at + self.length], mask.slice(at, self.length)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop, counted over the shard."""
        parts, step = [], GROUP * self.length
        while start < stop:
            ids = self._group(start // step)[0]
            parts.append(ids[start % step : start % step + stop - start])
            start += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


_INDEX = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("n_tokens", pa.int64())])
_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_MANIFEST_DDL = "shard int, path string, n_docs long, n_ids long"
_encoders: dict[tuple, Encoder] = {}


def _write(folder: str, tokenizer: str, end_id: int, length: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoders.setdefault((tokenizer, end_id), None) or Encoder(tokenizer, end_id)
        _encoders[tokenizer, end_id] = encoder
        first = next((b for b in source if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        name = f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}"
        position = n_docs = 0
        with system.open_output_stream(f"{name}.arrow") as sink, system.open_output_stream(f"{name}-index.arrow") as index_sink:
            packer, index = _Packer(sink, encoder.kind, length), pa.ipc.new_file(index_sink, _INDEX)
            while first is not None:
                sizes = []
                for i in range(0, first.num_rows, TOGETHER):
                    for data in encoder.encode_all(first.column(1).slice(i, TOGETHER).to_pylist()):
                        packer.add(data)
                        sizes.append(len(data) // encoder.kind.itemsize)
                ends = position + np.cumsum(sizes)
                index.write_batch(pa.RecordBatch.from_arrays([first.column(0), pa.array(ends - sizes), pa.array(sizes, pa.int64())], schema=_INDEX))
                position, n_docs = int(ends[-1]), n_docs + len(sizes)
                first = next((b for b in source if b.num_rows), None)
            packer.close()
            index.close()
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((shard, f"{folder}/{name.rsplit('/', 1)[1]}", n_docs, position), _MANIFEST, strict=True)], schema=_MANIFEST)

    return run


def write_token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and return their manifest: shard, path (without ending), n_docs, n_ids, start (ids before the shard).

    Shards are numbered in the order of the documents. An id that stands on many rows is split among shards.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), named(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(shards, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row").select("doc_id", "text")
    manifest = written(ordered.mapInArrow(_write(qualified(spark, folder or new_path(spark, "tokens")), tokenizer, end_id, length), _MANIFEST_DDL), "token-manifest")
    # A row per shard: the running sum is over a small table.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_OUT_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = TokenFile(f"{path}.arrow")
            system, name = _file_system(f"{path}-index.arrow")
            with system.open_input_file(name) as f:
                index = pa.ipc.open_file(f)
                for i in range(index.num_record_batches):
                    part = index.get_batch(i)
                    sums = [zlib.crc32(tokens.ids(a, a + n).astype("<u4").tobytes()) for a, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                    starts = part.column(1).to_numpy() + base
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts), part.column(2), pa.array(sums, pa.int64())], schema=_OUT)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row per document as the files have it: doc_id, start, n_tokens, ids_crc32."""
    shards = manifest.select("path", "start")
    return shards.repartition(max(1, manifest.count())).mapInArrow(_read, _OUT_DDL)


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))
