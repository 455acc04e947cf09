"""Toxicity: a weighted lexicon, matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding maps letters to one case, look-alike letters of other scripts and accented letters to plain ones, digits and
signs inside words to the letters they stand for, and everything else to blanks. As ``1`` may stand for ``i`` or ``l``,
both become ``i``; lexicon and text are folded alike.

The lexicon holds whole words and word beginnings with their log-odds of being in a toxic text. It is learned, like the
exception phrases (a term with its left or right neighbour that labelled clean texts use), from a bounded sample of
labelled rows, without near copies. The sample's texts stay on the executors: the driver gets counts of terms and
phrases, and two numbers for each text. These two features make a score by logistic regression: the summed weights of
the distinct terms found (30 at most), and the weights of all matches for a hundred words of the text (100 at most).

Defined results: a null or empty text has no match and gets the score of such texts. Without both labels to learn from,
every score is 0. Labels other than 0 and 1 are ignored; an id with both labels is learned from as either. Repeated
documents give repeated rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, filtered, table, written

#: Labelled rows to learn from, of either label. The fit costs the same at every size of the corpus.
SAMPLE = {1: 3000, 0: 5000}
#: Lengths of word beginnings that may become terms.
BEGINNINGS = range(4, 11)
#: A beginning is lengthened while the longer one is in so large a share of its toxic texts.
SAME = 0.97
#: A term must be in so many toxic texts of a large sample, and have at least this weight (a log-odds).
LEAST_TEXTS, LEAST_WEIGHT = 8, 2.5
#: Where there are few toxic texts, it must be in this share of them, and in so many at least.
LEAST_SHARE, LEAST_FEW = 0.1, 3
#: A phrase with a term becomes an exception if in so many clean texts of the sample, and not more often in toxic ones.
LEAST_CLEAN = 3

#: Letters of other scripts and what they look like.
LOOKALIKES = dict(zip("абвеёзийкмнорстухѕіјһԁԛԝвгɑοαεικνρτυχωσηγℓıßøđħŧ", "abbeeeuukmhopctyxsijhdqwbraoaeikvptyxwonyiisodht", strict=True))
#: Digits and the letters they stand for.
DIGITS = dict(zip("0123456789", "oizeasgtbg", strict=True))
#: Signs that stand for a letter between two letters or digits.
SIGNS = dict(zip("@$!|€+", "asiiet", strict=True))
_SIGN = re.compile(r"(?<=[^\W_])[@$!|€+](?=[^\W_])")


class _Fold(dict):
    """Code point to folded text, worked out when first met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = "".join(self._one(c) for c in unicodedata.normalize("NFKD", chr(code).lower()))
        return out

    @staticmethod
    def _one(c: str) -> str:
        c = LOOKALIKES.get(c, DIGITS.get(c, c))
        if c == "l":
            return "i"
        return c if c.isalpha() else "" if unicodedata.category(c) in ("Mn", "Cf") else " "


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded text; words stand between blanks."""
    if not text:
        return ""
    return _SIGN.sub(lambda m: SIGNS[m[0]], text).translate(_FOLD)


def folded_words(text: str | None) -> list[str]:
    return fold(text).split()


@dataclass
class Lexicon:
    """Terms end with a blank if they are whole words; both they and word beginnings start with one."""

    weights: dict[str, float] = field(default_factory=dict)
    #: Exception phrases: folded words between blanks. A match inside of one does not count.
    exceptions: tuple[str, ...] = ()
    #: Intercept and the coefficients of both features.
    model: tuple[float, float, float] = (-math.inf, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        entries = {t: (w, 0) for t, w in self.weights.items()} | {f" {p} ": (0.0, len(p) + 2) for p in self.exceptions}
        if not entries:
            return None
        built = ahocorasick.Automaton()
        for t, (w, covers) in entries.items():
            built.add_word(t, (t, w, covers))
        built.make_automaton()
        return built

    def score(self, features: tuple[float, float]) -> float:
        z = self.model[0] + self.model[1] * features[0] + self.model[2] * features[1]
        return 0.0 if z < -500 else 1 / (1 + math.exp(-z))


def features(built: ahocorasick.Automaton | None, words: list[str]) -> tuple[float, float, list[str]]:
    """Both features and the terms found."""
    if built is None or not words:
        return 0.0, 0.0, []
    found, excepted = [], []
    for end, (term, weight, covers) in built.iter(f" {' '.join(words)} "):
        if covers:
            excepted.append((end - covers + 1, end))
        else:
            found.append((end - len(term) + 1, term, weight))
    if excepted:
        found = _outside(found, excepted)
    # Of terms that begin at the same word, the heaviest counts.
    best: dict[int, tuple[float, str]] = {}
    for at, term, weight in found:
        best[at] = max(best.get(at, (0.0, "")), (weight, term))
    distinct = {t: w for w, t in best.values()}
    return min(sum(distinct.values()), 30.0), min(100 * sum(w for w, _ in best.values()) / len(words), 100.0), sorted(distinct)


def _outside(found: list[tuple], spans: list[tuple[int, int]]) -> list[tuple]:
    """What doesn't begin in a half-open span; both are gone through once, by place."""
    spans, out, i, reach = sorted(spans), [], 0, 0
    for x in sorted(found):
        while i < len(spans) and spans[i][0] <= x[0]:
            reach = max(reach, spans[i][1])
            i += 1
        if x[0] >= reach:
            out.append(x)
    return out


def _candidates(words: set[str]) -> set[str]:
    out = {f" {w} " for w in words if len(w) > 2}
    for n in BEGINNINGS:
        out.update(f" {w[:n]}" for w in words if len(w) >= n)
    return out


def _near_key(text: str) -> list[int]:
    """Near copies share the least hashes of their words."""
    return sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in set(text.split())})[:3]


def _distinct(texts: list[str]) -> list[str]:
    """Texts without near copies of earlier ones."""
    return list({tuple(_near_key(t)): t for t in reversed(texts)}.values())


def term_counts(texts: Iterable[str]) -> Counter:
    """In how many texts each word and word beginning is."""
    counts: Counter = Counter()
    for text in texts:
        counts.update(_candidates(set(text.split())))
    return counts


def least_texts(n_toxic: int) -> int:
    return min(LEAST_TEXTS, max(LEAST_FEW, math.ceil(LEAST_SHARE * n_toxic)))


def chosen_terms(counts: dict[str, int], against: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weighted terms from the numbers of toxic and clean texts with each."""
    counts = {t: n for t, n in counts.items() if n >= least_texts(n_toxic)}
    weight = lambda t: math.log((counts[t] + 0.5) / (n_toxic + 1)) - math.log((against.get(t, 0) + 0.5) / (n_clean + 1))
    chosen: dict[str, float] = {}
    longer: dict[str, list[str]] = {}
    for term in counts:
        if term[-1] != " " and term[:-1] in counts:
            longer.setdefault(term[:-1], []).append(term)
    for term in sorted(counts, key=lambda t: (len(t), t)):
        w = weight(term)
        if w < LEAST_WEIGHT or any(chosen[s] >= w - 1 for s in (term[:n] for n in range(2, len(term))) if s in chosen):
            continue
        while best := max((t for t in longer.get(term, ()) if counts[t] >= SAME * counts[term]), key=lambda t: (counts[t], t), default=""):
            term = best
        chosen[term] = round(weight(term), 6)
    return chosen


def phrase_counts(weights: dict[str, float], texts: Iterable[str]) -> Counter:
    """In how many texts each pair of neighbours with a term is."""
    found: Counter = Counter()
    for words in map(str.split, texts):
        hit = {w for w in set(words) if f" {w} " in weights or any(f" {w[:n]}" in weights for n in BEGINNINGS)}
        if hit:
            found.update({f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in hit or b in hit})
    return found


def chosen_phrases(bad: dict[str, int], good: dict[str, int], n_toxic: int, n_clean: int) -> tuple[str, ...]:
    return tuple(sorted(p for p, n in good.items() if n >= LEAST_CLEAN and bad.get(p, 0) * n_clean <= n * n_toxic))


def with_model(lexicon: Lexicon, rows: list[tuple[float, float, int]], share: float) -> Lexicon:
    """``rows`` has both features and the label of each text of the sample."""
    totals = Counter(label for _, _, label in rows)
    prior = {1: share / totals[1], 0: (1 - share) / totals[0]}
    lexicon.model = _regression(np.array([(one, two, label, prior[label]) for one, two, label in sorted(rows)]))
    return lexicon


def learn(toxic: list[str], clean: list[str], share: float) -> Lexicon:
    """Learn from folded labelled texts in memory; ``share`` of the labelled corpus is toxic. ``fit`` does so on executors."""
    toxic, clean = _distinct(toxic), _distinct(clean)
    if not toxic or not clean:
        return Lexicon()
    lexicon = Lexicon(chosen_terms(term_counts(toxic), term_counts(clean), len(toxic), len(clean)))
    lexicon.exceptions = chosen_phrases(phrase_counts(lexicon.weights, toxic), phrase_counts(lexicon.weights, clean), len(toxic), len(clean))
    built = lexicon.automaton()
    return with_model(lexicon, [(*features(built, t.split())[:2], label) for label, texts in ((1, toxic), (0, clean)) for t in texts], share)


def _regression(rows: np.ndarray, ridge: float = 1e-4) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton's method; coefficients are kept from falling below 0."""
    x, y, w = np.c_[np.ones(len(rows)), rows[:, :2]], rows[:, 2], rows[:, 3]
    beta = np.zeros(3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (y - p)) - ridge * beta * [0, 1, 1]
        curve = (x.T * (w * p * (1 - p))) @ x + np.diag([1e-9, ridge, ridge])
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(max(0, beta[1])), float(max(0, beta[2]))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("terms", pa.list_(pa.string()))])
_OUT_DDL = "doc_id long, held_out boolean, score double, predicted int, terms array<string>"


def _score(lexicon: Lexicon):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = lexicon.automaton()
        for batch in source:
            scores, terms = [], []
            for text in batch.column(1).to_pylist():
                one, two, found = features(built, folded_words(text))
                scores.append(lexicon.score((one, two)))
                terms.append([t.strip() for t in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(terms, pa.list_(pa.string()))], schema=_OUT)

    return run


def _fold_all(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        folded = [" ".join(folded_words(t)) for t in batch.column(1).to_pylist()]
        keys = pa.array([_near_key(t) for t in folded], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array(folded)], names=["label", "near", "folded"])


def _counted(count: Callable[[Iterable[str]], Counter]):
    """Counts of the texts of a partition, by label."""
    schema = pa.schema([("label", pa.int32()), ("what", pa.string()), ("n", pa.int64())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in source:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for label in (0, 1):
                totals[label].update(count(t for k, t in rows if k == label))
        yield from batches(((label, what, n) for label in (0, 1) for what, n in totals[label].items()), schema)

    return run


def _counts(sample: DataFrame, count: Callable[[Iterable[str]], Counter], kept: Column) -> tuple[dict[str, int], dict[str, int]]:
    """Numbers of toxic and of clean texts with each term or phrase, of those that ``kept`` lets pass."""
    parts = sample.mapInArrow(_counted(count), "label int, what string, n long").groupBy("what")
    rows = parts.agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(name) for k, name in ((1, "bad"), (0, "good")))).filter(kept).collect()
    return {r["what"]: r["bad"] for r in rows if r["bad"]}, {r["what"]: r["good"] for r in rows if r["good"]}


def _measured(lexicon: Lexicon):
    schema = pa.schema([("one", pa.float64()), ("two", pa.float64()), ("label", pa.int32())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = lexicon.automaton()
        for batch in source:
            yield from batches(((*features(built, t.split())[:2], k) for k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)), schema)

    return run


def held_out(col: str):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Lexicon:
    """Learn from at most ``sample`` rows of either label, chosen by a hash of their id, outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if set(totals) != {0, 1}:
        return Lexicon()
    parts = [known.filter(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in (sample or SAMPLE).items()]
    # The sample's ids are a few thousand by the parameter, so they may be broadcast.
    chosen = F.broadcast(parts[0].unionByName(parts[1]).dropDuplicates())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(chosen, "id").select("label", "text")
    texts = texts.mapInArrow(_fold_all, "label int, near array<long>, folded string")
    texts = written(texts.groupBy("label", "near").agg(F.min("folded").alias("folded")).select("label", "folded"), "toxicity-texts")
    # An id may stand on many texts: their number is bounded, too.
    parts = [texts.filter(F.col("label") == k).orderBy(F.xxhash64("folded"), "folded").limit(n) for k, n in (sample or SAMPLE).items()]
    sample = written(parts[0].unionByName(parts[1]), "toxicity-sample")
    discard(texts)
    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        return Lexicon()
    lexicon = Lexicon(chosen_terms(*_counts(sample, term_counts, F.col("bad") >= least_texts(sizes[1])), sizes[1], sizes[0]))
    weights = lexicon.weights
    lexicon.exceptions = chosen_phrases(*_counts(sample, lambda t: phrase_counts(weights, t), F.col("good") >= LEAST_CLEAN), sizes[1], sizes[0])
    rows = [tuple(r) for r in sample.mapInArrow(_measured(lexicon), "one double, two double, label int").collect()]
    return with_model(lexicon, rows, totals[1] / (totals[0] + totals[1]))


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and the terms found."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id").alias("held_out"))
    return rows.mapInArrow(_score(lexicon), _OUT_DDL)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("terms")


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Documents that are not predicted toxic, with all their columns."""

    def decide():
        built = lexicon.automaton()
        return lambda texts: [lexicon.score(features(built, folded_words(t))[:2]) < 0.5 for t in texts]

    return filtered(docs, decide)
