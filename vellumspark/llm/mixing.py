"""Mixing sources to target weights by entropy balancing, with DataFrame functions alone.

Targets share all words among the sources by weight; none is above a multiple of its source's own words, and what is
above is shared anew by weight until nothing is.

The rates of documents minimise their relative entropy, weighted by words, under two families of constraints that cross:

* the rated words of each source equal its target (exactly);
* the mix keeps the corpus's mean and variance of the logarithm of document length, by words (as far as the first family
  and the largest rate allow: these constraints have a ridge in the dual, so there is always a solution).

In the convex dual a document's rate is ``min(most, exp(alpha[source] + beta · x))`` with x its two centred powers of
log length: tilted exponentially, each document by its own length. Every Newton step sums gradient and curvature over
all documents in a distributed aggregation (documents of equal source and size share a row). A source's multiplier only
meets its own documents, so its block of the curvature is diagonal: it is eliminated in the same table, source by source,
and what is left for the driver is a system of two unknowns. A step is shortened until the dual falls; the steps end by
the constraints' own error. Corpora whose documents are all of one length have nothing to balance by length. Sums are made in decimals, so they don't depend on the
order of rows and reruns agree.

Rates become whole copies. Documents of a source are put in cells of about equal size (12 % at most); from the largest
cell down, the number of copies in a cell follows the words wanted so far less those taken so far. In a cell the copies
fall where the running sum of rates, in the order of a hash of id and text, passes a whole number. So a source's taken words
differ from its target by a part of a small document, and no document gets more copies than its rate rounded up.

Cells are split by the first digits of the hash before anything is ordered, so a source, a size or an id that holds a
large part of all rows is spread over many tasks. Sources are ranked by ranges, not in one task.

Defined results: a null or empty text has size 0 and is taken 0 times its size; a null source is a source of its own,
the last; repeated rows count as often as they occur; documents alike in id and text are interchangeable. If there are
no words at all, targets are 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, named, table, written

#: Weights of the sources in order, repeating; most copies of a document.
WEIGHTS, MOST = (1, 2, 3), 3
#: Newton steps at most; they end when no source's words are off by more than this share of its target, and the moments
#: by no more than this share of all words. A step is divided by four until the dual falls, so often at most.
STEPS, CLOSE, HALVINGS = 40, 1e-9, 8
#: Weight of the ridge on the multipliers of length, by the words of the corpus.
RIDGE = 1e-3
#: Variance of log length below which lengths are taken to be equal: then there is nothing to balance by.
LEAST_VARIANCE = 1e-6
#: Rates are whole numbers of these parts of a copy.
UNIT = 1 << 20
#: Rows of a cell's part that one task orders, on average at most.
PART_ROWS = 1 << 20

_WORD = r"[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def size_cell(size: Column) -> Column:
    """A number that grows with size; sizes of a cell agree in their four leading bits."""
    bits = F.length(F.bin(size))
    top = F.when(bits <= 4, size).otherwise(F.expr("shiftright(__size, greatest(length(bin(__size)) - 4, 0))"))
    return (bits * 16 + top).cast("int")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds __rank, from 0, in the order of the sources' code points, null last."""
    place = F.spark_partition_id().cast("long")
    parts = sources.repartitionByRange(F.col("__source").asc_nulls_last()).sortWithinPartitions(F.col("__source").asc_nulls_last())
    # The lower 33 bits of the number count the rows of a partition.
    rows = written(parts.withColumn("__part", place).withColumn("__n", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "mixing-sources")
    # A row per partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__part").agg(F.count("*").alias("__rows")).withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    return rows.join(offsets, "__part").withColumn("__rank", F.col("__before") + F.col("__n")).drop("__part", "__n", "__rows", "__before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds __target to a table of __source and __source_size: one row per source.

    The level (words for a weight of 1) rises while sources above their cap leave words to the others; each round is one
    aggregation over the sources, and there are fewer rounds than kinds of caps.
    """
    choice = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    rows = written(ranked(sources).withColumn("__weight", choice.cast("long")).withColumn("__cap", most * F.col("__source_size")), "mixing-weights")
    level = None
    while True:
        above = F.lit(False) if level is None else F.col("__cap") < level * F.col("__weight")
        total, full, weight = rows.agg(F.sum("__source_size"), F.sum(F.when(above, F.col("__cap"))), F.sum(F.when(~above, F.col("__weight")))).first()
        now = ((total or 0) - (full or 0)) / weight if weight else level or 0.0
        if now == level:
            break
        level = now
    return rows.select("__source", "__source_size", F.least(F.col("__cap").cast("double"), F.lit(float(level)) * F.col("__weight")).alias("__target"))


def _exact(value: Column) -> Column:
    """A sum that doesn't depend on the order of its rows."""
    return F.sum(value.cast("decimal(38,14)")).cast("double")


def _moments(size: Column, mean: float, variance: float) -> tuple[Column, Column]:
    """Centred powers of log length, each of about unit scale."""
    if variance < LEAST_VARIANCE:
        return F.lit(0.0), F.lit(0.0)
    x = (F.log2(size.cast("double")) - mean) / variance**0.5
    return x, (x * x - 1) / 2


class _State:
    """Multipliers, and gradient, curvature and value of the dual there: sums over all documents, a row per source."""

    def __init__(self, rows: DataFrame, free: DataFrame, beta: tuple[float, float], x: Column, y: Column, words: float, most: float) -> None:
        self.free, self.beta, w = free, beta, F.col("__words")
        tilt = F.col("__alpha") + beta[0] * x + beta[1] * y
        raw, top = F.exp(F.least(tilt, F.lit(math.log(most)))), F.lit(math.log(most))
        rate = F.when(F.col("__full"), most).otherwise(raw)
        # Above the largest rate the dual goes on as a straight line.
        value = F.when(F.col("__full"), 0.0).otherwise(raw + F.greatest(F.lit(0.0), tilt - top) * most)
        bent = rate * (~F.col("__full") & (tilt < top)).cast("double")
        sums = {"f": value, "g": rate, "g1": rate * x, "g2": rate * y, "h": bent, "h1": bent * x, "h2": bent * y, "h11": bent * x * x, "h12": bent * x * y, "h22": bent * y * y}
        by = rows.join(free, F.col("__source").eqNullSafe(F.col("__s"))).groupBy("__s", "__target", "__full", "__alpha").agg(*(_exact(w * v).alias(f"__{k}") for k, v in sums.items()))
        self.by = written(by.withColumn("__off", F.when(F.col("__full"), 0.0).otherwise(F.col("__g") - F.col("__target"))), "mixing-sums")
        self.inverse = F.when(F.col("__h") > 0, 1 / F.col("__h")).otherwise(0.0)
        part = lambda a, b, ab: _exact(F.col(ab) - F.col(a) * F.col(b) * self.inverse)
        rest = lambda a, g: _exact(F.col(g) - F.col(a) * F.col("__off") * self.inverse)
        ours = F.when(F.col("__full"), F.col("__g1") * beta[0] + F.col("__g2") * beta[1]).otherwise(F.col("__f") - F.col("__alpha") * F.col("__target"))
        found = self.by.agg(part("__h1", "__h1", "__h11"), part("__h1", "__h2", "__h12"), part("__h2", "__h2", "__h22"), rest("__h1", "__g1"), rest("__h2", "__g2"), F.max(F.abs("__off") / F.col("__target")), _exact(F.col("__g1")), _exact(F.col("__g2")), _exact(ours), F.count("*")).first()
        a11, self.a12, a22, b1, b2, self.off, g1, g2, dual, self.n = (v or 0.0 for v in found)
        ridge = RIDGE * words
        self.a11, self.a22, self.b = a11 + ridge, a22 + ridge, (b1 + ridge * beta[0], b2 + ridge * beta[1])
        self.moments = max(abs(g1 + ridge * beta[0]), abs(g2 + ridge * beta[1])) / words if words else 0.0
        self.dual = dual + ridge * (beta[0] ** 2 + beta[1] ** 2) / 2

    def step(self) -> tuple[float, float]:
        """Newton's step of the two multipliers of length, those of the sources eliminated."""
        det = self.a11 * self.a22 - self.a12**2
        return -(self.a22 * self.b[0] - self.a12 * self.b[1]) / det, -(self.a11 * self.b[1] - self.a12 * self.b[0]) / det

    def moved(self, step: tuple[float, float], part: float) -> tuple[DataFrame, tuple[float, float]]:
        """Multipliers a part of Newton's step away. Where all of a source's documents are at the largest rate, there is
        no curvature: then the source's multiplier falls."""
        own = -(F.col("__off") + F.col("__h1") * step[0] + F.col("__h2") * step[1]) * self.inverse
        # Bounded, for the decimals' sake.
        own = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), own))
        own = F.when(F.col("__full"), 0.0).when(F.col("__h") > 0, own).otherwise(F.when(F.col("__off") > 0, -1.0).otherwise(0.0))
        later = self.by.select("__s", "__target", "__full", (F.col("__alpha") + own * part).alias("__alpha"))
        return written(later, "mixing-multipliers"), (self.beta[0] + step[0] * part, self.beta[1] + step[1] * part)


def _balanced(rows: DataFrame, start: DataFrame, x: Column, y: Column, words: float, most: float) -> tuple[DataFrame, tuple[float, float]]:
    """Multipliers of the sources and of length that solve the dual.

    Should the steps not end at the constraints, the documented way out is to leave lengths as they are: each source's
    documents get one rate, its target by its words, which meets every target.
    """
    at = lambda free, beta: _State(rows, free, beta, x, y, words, most)
    now = at(start, (0.0, 0.0))
    for _ in range(STEPS):
        if not now.n or now.off < CLOSE and now.moments < CLOSE:
            discard(now.by)
            return now.free, now.beta
        step, part = now.step(), 1.0
        for _ in range(HALVINGS):
            later = at(*now.moved(step, part))
            if later.dual <= now.dual + 1e-12 * abs(now.dual):
                break
            discard(later.by, later.free)
            part /= 4
        else:
            break
        if now.free is not start:
            discard(now.free)
        discard(now.by)
        now = later
    discard(now.by)
    return start, (0.0, 0.0)


def rates(facts: DataFrame, aims: DataFrame, most: int = MOST) -> DataFrame:
    """(__source, __size, __rows, __source_size, __target, __q): the rate of documents of a source and size, in units.

    ``facts`` has (__source, __size, __rows), ``aims`` (__source, __source_size, __target).
    """
    rows = facts.filter("__size > 0").withColumn("__words", F.col("__size") * F.col("__rows"))
    log2 = F.log2(F.col("__size").cast("double"))
    words, first, second = rows.agg(F.sum("__words"), _exact(F.col("__words") * log2), _exact(F.col("__words") * log2 * log2)).first()
    words = float(words or 0)
    mean = first / words if words else 0.0
    variance = second / words - mean**2 if words else 1.0
    x, y = _moments(F.col("__size"), mean, variance)
    # At its cap a source takes all it has; below, its multiplier starts where it would be without the other family.
    full = F.col("__target") >= most * F.col("__source_size")
    free = written(aims.filter("__target > 0").select(F.col("__source").alias("__s"), "__target", full.alias("__full"), F.log(F.col("__target") / F.col("__source_size")).alias("__alpha")), "mixing-multipliers")
    same = F.col("__source").eqNullSafe(F.col("__s"))
    free, beta = _balanced(rows, free, x, y, words, float(most))
    raw = F.least(F.exp(F.col("__alpha") + beta[0] * x + beta[1] * y), F.lit(float(most)))
    rate = F.when(F.col("__size") <= 0, 0.0).when(F.col("__full"), float(most)).otherwise(F.coalesce(raw, F.lit(0.0)))
    every = facts.join(aims.withColumnRenamed("__source", "__a"), F.col("__source").eqNullSafe(F.col("__a"))).join(free.drop("__target"), same, "left")
    return every.select("__source", "__size", "__rows", "__source_size", "__target", F.coalesce(F.round(rate * UNIT), F.lit(0)).cast("long").alias("__q"))


def _copies(cells: Column, most: int) -> Column:
    """For cells (cell, rows, units, words, largest) from the largest down: the copies of each, by carrying the difference on.

    ``units`` are the rates of a cell's documents, ``words`` the rated words, both in units; ``largest`` is the largest
    rate. Copies are shared in the proportion of rates, so their number is bounded by what takes that rate to ``most``.
    """
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<cell:int,copies:long>>").alias("out"))

    def add(state: Column, cell: Column) -> Column:
        mean = cell["words"] / F.nullif(cell["units"], F.lit(0))
        owed = state["owed"] + cell["words"].cast("double") / UNIT
        bound = F.floor(cell["units"].cast("double") * most / F.nullif(cell["largest"], F.lit(0)))
        copies = F.when(cell["units"] > 0, F.greatest(F.lit(0), F.least(F.floor(owed / F.nullif(mean, F.lit(0)) + 0.5), bound))).otherwise(0).cast("long")
        return F.struct((owed - copies * F.coalesce(mean, F.lit(0.0))).alias("owed"), F.concat(state["out"], F.array(F.struct(cell["cell"].alias("cell"), copies.alias("copies")))).alias("out"))

    return F.aggregate(cells, start, add, lambda s: s["out"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken; or with ``carry`` its row as ``doc`` and copies."""
    text, hashed = named(text_col), F.md5(F.concat_ws(":", F.coalesce(named(id_col).cast("string"), F.lit("")), F.xxhash64(named(text_col)).cast("string")))
    digits = _digits(docs)

    def measured(*more: Column) -> DataFrame:
        rows = docs.select(named(source_col).alias("__source"), word_count(text).alias("__size"), hashed.alias("__hash"), F.xxhash64(text).alias("__text"), *more)
        return rows.withColumn("__cell", size_cell(F.col("__size"))).withColumn("__part", F.substring("__hash", 1, digits))

    row = F.struct("*") if carry else F.struct(named(id_col).alias("doc_id"))
    # Without texts, rows are small: then they are written, and texts are read once. With texts, they are read twice.
    rows = measured(row.alias("__doc")) if carry else written(measured(row.alias("__doc")), "mixing-rows")
    parts = written((measured() if carry else rows).groupBy("__source", "__size", "__cell", "__part").agg(F.count("*").alias("__rows")), "mixing-parts")
    facts = written(parts.groupBy("__source", "__size").agg(F.sum("__rows").alias("__rows")), "mixing-facts")
    sources = facts.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__rows")).alias("__source_size"))
    aims = written(targets(sources, weights, most), "mixing-targets")
    rated = written(rates(facts, aims, most).withColumn("__cell", size_cell(F.col("__size"))), "mixing-rates")
    units = (F.col("__q") * F.col("__rows")).cast("decimal(38,0)")
    cells = rated.groupBy("__source", "__cell").agg(F.sum("__rows").alias("rows"), F.sum(units).alias("units"), F.sum(units * F.col("__size")).alias("words"), F.max("__q").alias("largest"))
    # A source has a few hundred cells: 16 for each doubling of the size.
    order = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("__cell").alias("cell"), "rows", "units", "words", "largest"))))
    plan = cells.groupBy("__source").agg(order.alias("cells")).select("__source", F.explode(_copies(F.col("cells"), most)).alias("of"))
    plan = plan.join(cells.select(F.col("__source").alias("__c"), F.col("__cell").alias("__k"), "units"), F.col("__source").eqNullSafe(F.col("__c")) & (F.col("of.cell") == F.col("__k")))
    plan = written(plan.select(F.col("__source").alias("__p"), F.col("__k"), "units", F.col("of.copies").alias("copies")), "mixing-plan")
    own = rated.select(F.col("__source").alias("__o"), F.col("__size").alias("__z"), "__q", "__source_size", "__target")
    same = F.col("__source").eqNullSafe(F.col("__o")) & (F.col("__size") == F.col("__z"))
    before = Window.partitionBy("__source", "__cell").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.join(own, same).groupBy("__source", "__cell", "__part").agg(F.sum((F.col("__q") * F.col("__rows")).cast("decimal(38,0)")).alias("__units"))
    offsets = offsets.withColumn("__before", F.coalesce(F.sum("__units").over(before), F.lit(0)))
    offsets = offsets.join(plan, F.col("__source").eqNullSafe(F.col("__p")) & (F.col("__cell") == F.col("__k")))
    offsets = written(offsets.select(F.col("__source").alias("__s"), F.col("__cell").alias("__c"), F.col("__part").alias("__t"), "__before", "units", F.col("copies").alias("__whole")), "mixing-offsets")
    upto = Window.partitionBy("__source", "__cell", "__part").orderBy("__hash", "__size", "__text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(own, same).withColumn("__upto", F.sum(F.col("__q").cast("decimal(38,0)")).over(upto))
    place = F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__cell") == F.col("__c")) & (F.col("__part") == F.col("__t"))
    rows = rows.join(offsets, place)
    # Decimals of 38 digits hold the products: copies of a cell by units of a cell.
    share = lambda upto: F.floor(F.col("__whole").cast("decimal(15,0)") * upto.cast("decimal(22,0)") / F.col("units").cast("decimal(22,0)"))
    end = F.col("__before") + F.col("__upto")
    copies = F.when(F.col("units") > 0, share(end) - share(end - F.col("__q"))).otherwise(0).cast("long")
    if carry:
        return rows.select(F.col("__doc").alias("doc"), copies.alias("copies"))
    return rows.select("__doc.doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken"))


def _digits(docs: DataFrame) -> int:
    """Hexadecimal digits that split a cell: more for more rows; results don't depend on them."""
    rows, digits = docs.count(), 1
    while rows > PART_ROWS * 16**digits and digits < 5:
        digits += 1
    return digits


def mixed(docs: DataFrame) -> DataFrame:
    """Documents as often as the mix takes them, with all their columns."""
    return mix(docs, carry=True).select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")
