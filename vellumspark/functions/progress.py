"""Remaining time of running analyses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weight of a new value, and what must have passed before a time is shown.
WEIGHT, SHOWN_AFTER, SHOWN_FROM = 0.3, 10, 0.08


def remaining(elapsed: Column, done: Column) -> Column:
    """Seconds left at the present pace; null before anything is done."""
    return F.when((done > 0) & (elapsed > 0), elapsed * (1 - done) / done)


def shown(elapsed: Column, done: Column) -> Column:
    return F.when((elapsed >= SHOWN_AFTER) & (done >= SHOWN_FROM), remaining(elapsed, done))


def smoothed(values: Column, weight: float = WEIGHT) -> Column:
    """Exponential mean of an array in order."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, v: F.coalesce(weight * v + (1 - weight) * a, v.cast("double")))


def duration(seconds: Column) -> Column:
    """"menos de 1 min", "~n min" or "~h h m min"."""
    minutes = F.round(seconds / 60).cast("long")
    long = F.concat(F.lit("~"), F.floor(minutes / 60), F.lit(" h "), minutes % 60, F.lit(" min"))
    return F.when(seconds < 0, None).when(seconds < 60, "menos de 1 min").when(minutes < 60, F.concat(F.lit("~"), minutes, F.lit(" min"))).otherwise(long)


def batch_remaining(elapsed: Column, done: Column, finished: Column, left: Column) -> Column:
    """What the present article still takes, and a mean article's time for each of those left.

    The mean is that of the finished articles; before there is one, the present article's whole time, as soon as it may
    be shown. Without either, and without a present article, there is nothing to tell (null).
    """
    total = F.aggregate(F.coalesce(finished, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    mean = F.when(F.size(finished) > 0, total / F.size(finished)).when((elapsed >= SHOWN_AFTER) & (done >= SHOWN_FROM), elapsed / done)
    return F.coalesce(remaining(elapsed, done), mean) + F.coalesce(mean, F.lit(0.0)) * left
