"""Pages of stored samples by a cursor, newest or oldest first, day folder by day folder."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, timedelta
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.time import EPOCH, instant_literal
from rackpulse.operators.filters import in_time_range
from rackpulse.operators.paging import MOST_ROWS
from rackpulse.operators.sizes import written


class Cursor(NamedTuple):
    """The last sample of a page; the next page begins behind it."""

    sample_at: datetime
    id: int


def _order(newest: bool) -> list[Column]:
    return [(F.desc if newest else F.asc)(name) for name in ("sample_at", "id")]


def behind(samples: DataFrame, cursor: Cursor, newest: bool) -> DataFrame:
    """The samples that follow ``cursor``; the bound on time alone skips folders and row groups."""
    at = instant_literal(cursor.sample_at, samples.schema["sample_at"].dataType)
    bounds = (None, cursor.sample_at) if newest else (cursor.sample_at, None)
    time, number = F.col("sample_at"), F.col("id")
    later = (time < at) | ((time == at) & (number < cursor.id)) if newest else (time > at) | ((time == at) & (number > cursor.id))
    return in_time_range(samples, *bounds).where(later)


def seek(samples: DataFrame, days: list[date], limit: int, cursor: Cursor | None = None, newest: bool = True) -> DataFrame:
    """``limit`` samples by (``sample_at``, ``id``), from the newest or oldest or behind a cursor.

    ``samples`` is partitioned by ``sample_date`` and may be filtered; ``days`` are its
    folders. They are opened from the near end, twice as many in each step, until the
    page is full, so a page of recent samples opens the last folder only, and a filter
    that few samples pass takes as many steps as the number of days has digits in
    base two. Each step is a top-k pass whose rows, at most ``limit``, are written once.
    """
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be from 1 to {MOST_ROWS}")
    if cursor is not None:
        samples = behind(samples, cursor, newest)
    pages: list[DataFrame] = []
    left, at, step = limit, 0, 1
    near = sorted(days, reverse=newest)
    while left > 0 and at < len(near):
        span = near[at:at + step]
        inside = samples.where(F.col("sample_date").between(F.lit(min(span)), F.lit(max(span))))
        part = written(inside.orderBy(*_order(newest)).limit(left), "page")
        found = part.count()
        if found:
            pages.append(part)
        left, at, step = left - found, at + step, step * 2
    if not pages:
        return samples.limit(0)
    return reduce(DataFrame.unionByName, pages).orderBy(*_order(newest))


def pages(samples: DataFrame, days: list[date], limit: int, newest: bool = True) -> Iterator[DataFrame]:
    """All samples page by page; the driver keeps one cursor."""
    cursor = None
    while True:
        page = seek(samples, days, limit, cursor, newest)
        micros = F.unix_micros(F.col("sample_at").cast("timestamp"))
        last = page.orderBy(*_order(not newest)).select(micros.alias("micros"), "id").first()
        if last is None:
            return
        yield page
        cursor = Cursor(EPOCH + timedelta(microseconds=last["micros"]), last["id"])
