"""Batches: triage by content, comparison of documents by keyword, absences and an overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import in_order

LIMIT = 5
DUPLICATE, FULL = "already in the batch (same content)", "limit of {} files per session reached"


def triage(uploads: DataFrame, existing: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
    """Adds status (accepted, refused) and reason to (session_id, arrival, content_sha256, …).

    ``existing`` has (session_id, content_sha256). First occurrences of new contents take the free seats of their session
    in order of arrival; a repeat is a duplicate only if what it repeats has a seat.

    Contents are pre-aggregated, and no more contents of a session are ranked than there can be seats: where some are
    taken, the first ``limit`` new ones are ranked all the same. A null session is one of its own, a null hash one content.
    """
    uploads = uploads.withColumn("__s", F.struct("session_id", "content_sha256"))
    first = uploads.groupBy("__s").agg(F.min("arrival").alias("first"))
    if existing is not None:
        held = existing.select(F.struct("session_id", "content_sha256").alias("__s")).distinct()
        seats = held.groupBy(F.struct("__s.session_id").alias("__in")).agg(F.greatest(F.lit(0), F.lit(limit) - F.count("*")).alias("seats"))
        first = first.join(held.withColumn("held", F.lit(True)), "__s", "left")
    else:
        first, seats = first.withColumn("held", F.lit(None).cast("boolean")), None
    fresh = first.filter("held is null").withColumn("__in", F.struct("__s.session_id"))
    place = F.row_number().over(Window.partitionBy("__in").orderBy("first"))
    # A group limit: each task passes on the few earliest of a session alone.
    seated = fresh.withColumn("place", place).filter(F.col("place") <= limit)
    seated = seated.join(seats, "__in", "left").filter(F.col("place") <= F.coalesce("seats", F.lit(limit))) if seats is not None else seated
    rows = uploads.join(first.select("__s", "held"), "__s", "left").join(seated.select("__s", F.col("first").alias("seat")), "__s", "left")
    taken = F.coalesce("held", F.lit(False)) | F.coalesce(F.col("arrival") > F.col("seat"), F.lit(False))
    accepted = ~taken & F.col("seat").isNotNull()
    return rows.withColumn("status", F.when(accepted, "accepted").otherwise("refused")).withColumn("reason", F.when(taken, DUPLICATE).when(~accepted, FULL.format(limit))).drop("__s", "held", "seat")


def free_seats(items: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(session_id, seats) for sessions with items."""
    return items.groupBy("session_id").agg(F.greatest(F.lit(0), F.lit(limit) - F.count("*")).cast("int").alias("seats"))


def comparison(results: DataFrame, files: list[str]) -> DataFrame:
    """A row per keyword in order of first appearance, a column per file with its total; 0 where there is no result.

    ``results`` has (item, file, position, keyword, total) of analysed items, ``item`` being their order. Files are given,
    as the columns are; they should be unique (ids if names are not).
    """
    each = [F.coalesce(F.last(F.when(F.col("file") == f, F.col("total")), ignorenulls=True), F.lit(0)).alias(f) for f in files]
    rows = results.groupBy("keyword").agg(F.min(F.struct("item", "position")).alias("order"), F.struct(*each, F.lit(0).alias("_")).alias("totals"))
    return rows.orderBy("order").select("keyword", *(F.col("totals").getField(f).alias(f) for f in files))


#: Columns of a tile of a comparison.
WIDTH = 50


def tiled(results: DataFrame, width: int = WIDTH) -> DataFrame:
    """The comparison of any number of files in tiles of their columns: (keyword, place, tile, files, totals).

    Files are columns in order of their names, ``width`` to a tile; ``files`` and ``totals`` are arrays of a tile's columns,
    0 where there is no result; of repeated results the largest counts. ``place`` is the keyword's order of appearance.
    Files are numbered by a sort in ranges: their names don't come to the driver. Keywords are few, files may be many.
    """
    files = in_order(results.select("file").distinct(), [F.col("file")], "files")
    files = files.select("file", F.floor(F.col("nth") / width).cast("int").alias("tile"), (F.col("nth") % width).cast("int").alias("column"))
    listed = F.array_sort(F.collect_list(F.struct("column", "file")))
    heads = files.groupBy("tile").agg(listed.alias("files"))
    n = -(-files.count() // width)
    words = results.groupBy("keyword").agg(F.min(F.struct("item", "position")).alias("place"))
    # Each keyword has a row in each tile, whether it has results there or not.
    rows = words.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1)))))
    cells = results.join(files, "file").groupBy("keyword", "tile", "column").agg(F.max("total").alias("total"))
    found = cells.groupBy("keyword", "tile").agg(F.map_from_entries(F.collect_list(F.struct("column", "total"))).alias("found"))
    out = rows.join(heads, "tile").join(found, ["keyword", "tile"], "left")
    totals = F.transform("files", lambda f: F.coalesce(F.col("found")[f["column"]], F.lit(0)))
    return out.select("keyword", "place", "tile", F.col("files.file").alias("files"), totals.alias("totals"))


def absent(results: DataFrame) -> DataFrame:
    """(keyword, files): files without the keyword, in the items' order."""
    rows = results.filter("total = 0").groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("item", "file"))).alias("files"))
    return rows.select("keyword", F.col("files.file").alias("files"))


def overview(items: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """(item, file, title, pages, words, minutes, keywords_found, analysed): a row per item.

    ``items`` has (item, file, title, text, pages, analysed).
    """
    rows = items.withColumn("n_words", T.word_count(F.coalesce("text", F.lit(""))))
    shown = F.left(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("file")), F.lit(70))
    rows = rows.select("item", "file", shown.alias("title"), F.size("pages").alias("pages"), F.col("n_words").alias("words"), T.reading_minutes(F.col("n_words")).alias("minutes"), F.when(F.col("analysed"), "sim").otherwise("nao").alias("analysed"))
    if results is None:
        return rows.withColumn("keywords_found", F.lit("—"))
    counts = results.groupBy("item").agg(F.count("*").alias("n"), F.count_if(F.col("total") > 0).alias("found"))
    return rows.join(counts, "item", "left").withColumn("keywords_found", F.when(F.col("n") > 0, F.concat_ws("/", F.col("found"), F.col("n"))).otherwise("—")).drop("n", "found")


def pending(items: DataFrame, analysed: DataFrame, ids: list[str] | None = None, again: bool = False) -> DataFrame:
    """Items still to analyse: those named (or all), without analysed ones unless asked for."""
    rows = items.filter(F.col("item").isin(ids)) if ids else items
    return rows if again else rows.join(analysed.select("item").distinct(), "item", "left_anti")
