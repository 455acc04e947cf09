"""Vectors packed into rows of bounded bytes, and rows of whole numbers whose inner products are exact.

A tile is one row: the length of its vectors, their number, and ids, weights and matrix as little-endian bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Range of a score: what lies beyond counts as the nearest end.
LEAST_SCORE, MOST_SCORE = -(1 << 63), (1 << 63) - 1
MOST_NUMBER = float(np.finfo(np.float64).max)


def finite(vector: Column) -> Column:
    """Whether a vector is there and holds neither null nor NaN nor infinity."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a column of lists of numbers: the lengths, and all numbers as doubles."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    return sizes, column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def by_length(column: pa.Array):
    """For each length in a column of lists: the length, the places of its rows, and these as a matrix."""
    sizes, flat = lists(column)
    ends = np.cumsum(sizes)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield int(dim), at, flat[(ends[at] - dim)[:, None] + np.arange(dim)] if dim else np.zeros((len(at), 0))


def scaled(rows: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly; what leaves their range counts as the largest double."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * rows), -MOST_NUMBER, MOST_NUMBER)


def whole(rows: np.ndarray) -> np.ndarray:
    """Doubles without fractions as Python's integers."""
    return np.array([int(v) for v in rows.ravel().tolist()], dtype=object).reshape(rows.shape)


def best(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, score, id): the k highest scores of each row, ties to the smaller id, in that order."""
    # The complement of a 64-bit number reverses the order without leaving the range.
    order = np.lexsort((ids, ~scores, rows))
    rows, scores, ids = rows[order], scores[order], ids[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    return rows[place < k], scores[place < k], ids[place < k]


def candidates(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a matrix of scores that are allowed and reach the k-th best allowed score of their row."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(np.where(allowed, scores, LEAST_SCORE), n - k, axis=1)[:, n - k]
        allowed = allowed & (scores >= least[:, None])
    return np.nonzero(allowed)


def held(scores: np.ndarray) -> np.ndarray:
    """Python's integers as 64-bit ones, the nearest where they don't fit."""
    return np.array([min(max(int(x), LEAST_SCORE), MOST_SCORE) for x in scores.ravel()], dtype=np.int64).reshape(scores.shape)


def products(left: np.ndarray, right: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of rows of whole numbers, exact, as int64; beyond that the nearest.

    ``largest`` bounds every component. Single precision if every partial sum fits 24 bits, double precision if it fits
    53, else Python's integers.
    """
    bound = min(float(largest), 1e100) ** 2 * max(1, left.shape[1])
    if bound < 1 << 24:
        return (left.astype(np.float32) @ right.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (left @ right.T).astype(np.int64)
    return held(whole(left) @ whole(right).T)
