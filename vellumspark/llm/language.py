"""Language identification with string kernels.

The kernel is the blended spectrum of presence: for each text the set of its character n-grams of length 1 to 3, of
which the n-grams of the landmark texts count; the kernel of two texts is what their sets share over the geometric mean
of the sets' sizes. Landmarks give the Nyström map, on which one ridge regression per language (against the rest) is
fitted. A batch of texts is scored by two matrix products: n-gram presence with the landmarks' n-grams, and the kernel
rows with the dual coefficients.

Characters are lower-cased and mapped to an alphabet of letters from the landmarks; other letters share one symbol and
everything else is a blank. Whole texts are read, in blocks of about equal length: since presence knows no frequency, a
passage in another language would weigh too much in a long text. A text's margins are the mean of its blocks'.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text where there is nothing
to learn from. Repeated documents give repeated rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Rows to learn from, over all languages, and landmarks among them; of a text to learn from, so many characters count.
SAMPLE_ROWS, LANDMARKS, SAMPLE_CHARS = 2400, 160, 20_000
#: Bits of a symbol, so letters of the alphabet: all but two symbols.
BITS = 7
RIDGE = 1e-2
#: Characters of the longest block, and blocks in one matrix product.
BLOCK, TILE = 2000, 256
UNKNOWN = "und"


class _Symbols(dict):
    """Code point to symbol, as a character: 0 no letter, 1 a letter outside the alphabet, then the alphabet's letters."""

    def __init__(self, letters: str) -> None:
        super().__init__({ord(c): chr(i) for i, c in enumerate(letters, 2)})

    def __missing__(self, code: int) -> str:
        self[code] = out = chr(int(chr(code).isalpha()))
        return out


@dataclass
class Model:
    languages: list[str]
    letters: str
    #: Column of each n-gram in the landmarks' presence matrix, by n; the last column is of no use.
    columns: list[np.ndarray]
    #: Presence of n-grams in landmarks (columns by landmarks), scaled by the roots of the landmarks' set sizes.
    landmarks: np.ndarray
    #: Dual coefficients, landmarks by languages.
    duals: np.ndarray

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        sizes = presence.sum(axis=1)
        return (presence @ self.landmarks) / np.sqrt(np.maximum(sizes, 1))[:, None]

    def margins(self, presence: np.ndarray) -> np.ndarray:
        return self.kernel(presence) @ self.duals


def symbols_of(text: str, symbols: _Symbols) -> np.ndarray:
    return np.frombuffer(text.lower().translate(symbols).encode("latin-1"), np.uint8)


def grams(codes: np.ndarray) -> list[np.ndarray]:
    """Numbers of the n-grams at every place, by n."""
    out, now = [], codes.astype(np.int32)
    base = now
    for n in range(1, 4):
        out.append(now)
        if len(base) <= n:
            break
        now = (now[:-1] << BITS) | base[n:]
    return out


def presence_row(codes: np.ndarray, columns: list[np.ndarray], row: np.ndarray) -> None:
    for column, found in zip(columns, grams(codes), strict=False):
        row[column[found]] = 1
    row[-1] = 0


def train(texts: list[tuple[str, str]], landmarks: int = LANDMARKS) -> Model | None:
    """Learn from (text, language) pairs, in an order that should not depend on the language."""
    texts = [(t[i : i + BLOCK], lang) for t, lang in dict(texts).items() for i in range(0, len(t), BLOCK)]
    texts = [x for x in texts if any(map(str.isalpha, x[0]))]
    languages = sorted({lang for _, lang in texts})
    if not languages:
        return None
    each, chosen, seen = -(-landmarks // len(languages)), [], Counter()
    for text, lang in texts:
        seen[lang] += 1
        if seen[lang] <= each:
            chosen.append(text)
    counts = Counter(c for t in chosen for c in t.lower() if c.isalpha())
    letters = "".join(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: (1 << BITS) - 2])
    symbols = _Symbols(letters)
    found = [set() for _ in range(3)]
    for t in chosen:
        for n, g in enumerate(grams(symbols_of(t, symbols))):
            found[n].update(np.unique(g).tolist())
    width = sum(map(len, found))
    columns, at = [], 0
    for n, values in enumerate(found, 1):
        column = np.full(1 << BITS * n, width, np.int32)
        column[sorted(values)] = np.arange(at, at + len(values))
        at += len(values)
        columns.append(column)

    def presence(some: list[str]) -> np.ndarray:
        rows = np.zeros((len(some), width + 1), np.float32)
        for row, t in zip(rows, some, strict=True):
            presence_row(symbols_of(t, symbols), columns, row)
        return rows

    marks = presence(chosen)
    model = Model(languages, letters, columns, (marks / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]).T.copy(), np.zeros(0))
    kernel = model.kernel(marks).astype(np.float64)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    gram, target = np.zeros((good.sum(), good.sum())), np.zeros((good.sum(), len(languages)))
    for i in range(0, len(texts), TILE):
        part = texts[i : i + TILE]
        mapped = model.kernel(presence([t for t, _ in part])) @ root
        signs = np.array([[1.0 if lang == x else -1.0 for x in languages] for _, lang in part])
        gram += mapped.T @ mapped
        target += mapped.T @ signs
    weights = np.linalg.solve(gram + RIDGE * np.eye(len(gram)), target)
    model.duals = (root @ weights).astype(np.float32)
    return model


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_OUT_DDL = "doc_id long, held_out boolean, lang_pred string, score double"


def predict(model: Model | None, symbols: _Symbols | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    sums = np.zeros((len(texts), len(model.languages)))
    rows, owners, counts = np.zeros((TILE, len(model.landmarks)), np.float32), [], Counter()

    def flush() -> None:
        np.add.at(sums, owners, model.margins(rows[: len(owners)]))
        rows[:] = 0
        owners.clear()

    for i, text in enumerate(texts):
        codes = symbols_of(text, symbols) if text else None
        if codes is None or not codes.any():
            continue
        for block in np.array_split(codes, -(-len(codes) // BLOCK)):
            presence_row(block, model.columns, rows[len(owners)])
            owners.append(i)
            counts[i] += 1
            if len(owners) == TILE:
                flush()
    flush()
    for i, n in counts.items():
        best = int(sums[i].argmax())
        langs[i] = model.languages[best]
        scores[i] = float(np.clip((1 + sums[i, best] / n) / 2, 0, 1))
    return langs, scores


def _predict(held):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = held.value
        symbols = _Symbols(model.letters) if model else None
        for batch in source:
            langs, scores = predict(model, symbols, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=_OUT)

    return run


def held_out(col: str):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(True))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """Learn from about ``rows`` rows, as many of each language, chosen by a hash of their id and text, outside the held-out fold.

    Of these, the first ``SAMPLE_CHARS`` characters are learned from; predictions read whole texts. Rows that repeat an id
    and its text count once, so an id that holds a large part of all rows can't fill the sample; never are more than twice
    ``rows`` taken.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang").filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id") & (F.col("text") != ""))
    totals = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not totals:
        return None
    each = max(1, rows // len(totals))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20))
    limits = F.create_map(*(F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, (1 << 20) * min(1.0, each / n))))
    near = known.withColumn("place", place).filter(F.col("place") < limits[F.col("lang")])
    sample = near.select("place", "id", F.left("text", F.lit(SAMPLE_CHARS)).alias("text"), "lang").distinct().orderBy("place", "id", "text", "lang").limit(2 * rows).collect()
    return train([(r["text"], r["lang"]) for r in sorted(sample, key=lambda r: (hash_key(r["id"]), r["text"]))])


def hash_key(doc: int) -> int:
    """An order that has nothing to do with the language."""
    return (doc * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Only text is looked at."""
    # The model has a bounded size: landmarks by their n-grams.
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id").alias("held_out")).mapInArrow(_predict(held), _OUT_DDL)


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
