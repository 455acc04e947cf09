"""The items of sessions: what is held, one item, one page, removal, and what was refused.

Items are rows with ``session_id`` and ``doc_id``; requests are rows, too, so any number of lookups is one join. Defined
results: a request whose session or id is null, or not among the items, finds nothing (404); items that repeat are one;
all other columns of requests stay. No session's items meet in one task: all counts are aggregates that begin before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import batch

FOUND, NOT_FOUND = 200, 404
NO_ITEM, NO_PAGE, UNREADABLE = "artigo nao encontrado nesta sessao", "pagina fora do intervalo", "nao foi possivel ler o PDF ({})"
_KEYS = ["session_id", "doc_id"]


def _renamed(rows: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    """Columns of these names alone, with a prefix, so that they can't meet those of requests."""
    return rows.select(*(T.named(c).alias(prefix + c) for c in names))


def _joined(requests: DataFrame, items: DataFrame, values: list[str]) -> DataFrame:
    """Requests with ``_held`` and the values of the item they name, prefixed; each request once."""
    held = _renamed(items.dropDuplicates(_KEYS), "_item_", [*_KEYS, *values])
    same = (F.col("session_id") == F.col("_item_session_id")) & (F.col("doc_id") == F.col("_item_doc_id"))
    return requests.join(held, same, "left").withColumn("_held", F.col("_item_doc_id").isNotNull()).drop("_item_session_id", "_item_doc_id")


def listing(items: DataFrame, limit: int = batch.LIMIT) -> DataFrame:
    """Items with the seats that their session has left, and its limit."""
    seats = batch.free_seats(items.select(*_KEYS).distinct(), limit)
    return items.join(seats, "session_id", "left").withColumn("limit", F.lit(limit))


def item(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Adds status, error and the other columns of the item that a request (session_id, doc_id, …) names."""
    values = [c for c in items.columns if c not in _KEYS and c not in requests.columns]
    rows = _joined(requests, items, values)
    status = F.when(F.col("_held"), FOUND).otherwise(NOT_FOUND)
    return rows.select(*map(T.named, requests.columns), status.alias("status"), F.when(~F.col("_held"), NO_ITEM).alias("error"), *(F.col(f"`_item_{c}`").alias(c) for c in values))


def page(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Adds status, error and page_text to requests (session_id, doc_id, number, …); items have ``pages``, from number 1."""
    rows = _joined(requests, items, ["pages"])
    within = F.coalesce(F.col("number").between(1, F.size("_item_pages")), F.lit(False))
    fits = F.col("_held") & within
    error = F.when(~F.col("_held"), NO_ITEM).when(~within, NO_PAGE)
    text = F.when(fits, F.get("_item_pages", F.col("number").cast("int") - 1)["text"])
    return rows.select(*map(T.named, requests.columns), F.when(fits, FOUND).otherwise(NOT_FOUND).alias("status"), error.alias("error"), text.alias("page_text"))


def removed(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Items without those that requests (session_id, doc_id) name."""
    return items.join(requests.select(*_KEYS).distinct(), _KEYS, "left_anti")


def removals(items: DataFrame, requests: DataFrame, limit: int = batch.LIMIT) -> DataFrame:
    """Adds status and the seats left in the session, once all requests are done. A session without items has all seats."""
    rows = _joined(requests, items, []).withColumn("status", F.when(F.col("_held"), FOUND).otherwise(NOT_FOUND)).drop("_held")
    seats = batch.free_seats(removed(items, requests).select(*_KEYS).distinct(), limit).select(F.col("session_id").alias("_session"), F.col("seats").alias("_seats"))
    return rows.join(seats, F.col("session_id") == F.col("_session"), "left").withColumn("seats", F.coalesce("_seats", F.lit(limit))).drop("_session", "_seats")


def cleared(items: DataFrame, sessions: DataFrame) -> DataFrame:
    """Items of all sessions but the given ones."""
    return items.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def refusals(triaged: DataFrame, read: DataFrame) -> DataFrame:
    """(session_id, arrival, file_name, reason): uploads that triage refused, and accepted ones that can't be read.

    ``triaged`` has file_name and content_sha256 besides what ``batch.triage`` gives, ``read`` is ``ingest.extracted``.
    """
    failed = read.filter("error is not null").groupBy(F.col("doc_id").alias("content_sha256")).agg(F.min("error").alias("_error"))
    before, after = UNREADABLE.split("{}")
    rows = triaged.join(failed, "content_sha256", "left")
    reason = F.when(F.col("status") == "refused", F.col("reason")).otherwise(F.concat(F.lit(before), "_error", F.lit(after)))
    return rows.select("session_id", "arrival", "file_name", reason.alias("reason")).filter("reason is not null")


def with_overview(items: DataFrame, overview: DataFrame) -> DataFrame:
    """Items (item, …) with keywords_found and the numbers of pages and words of their row of an overview, by id.

    An item without a row has null numbers and a dash for its keywords.
    """
    rows = overview.dropDuplicates(["item"]).select("item", F.col("keywords_found").alias("_found"), F.col("pages").alias("n_pages"), F.col("words").alias("n_words"))
    found: Column = F.coalesce(F.nullif("_found", F.lit("")), F.lit("—"))
    return items.join(rows, "item", "left").withColumn("keywords_found", found).drop("_found")
