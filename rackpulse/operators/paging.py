"""Sorted pages."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.operators.numbering import number_rows

# Spark's limit and offset take 32 bits.
MOST_ROWS = (1 << 31) - 1
# Rows a task may keep for a page; deeper pages first look up where they start.
SHALLOW_ROWS = 100_000
# Each step splits a 64-bit key range into counted buckets, at most MOST_BUCKETS of them. The
# first step is left out where the second one does not exceed that by itself.
_SHIFTS = [48, 36, 24, 12, 0]
MOST_BUCKETS = 1 << 16


def _checked(limit: int, offset: int) -> None:
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be from 1 to {MOST_ROWS}")
    if not 0 <= offset <= MOST_ROWS:
        raise ValueError(f"offset must be from 0 to {MOST_ROWS}")


def _top(df: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    ordered = df.orderBy(*(F.asc_nulls_last(name) for name in order))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0, shallow: int | None = None) -> DataFrame:
    """``limit`` rows after the first ``offset`` by the given columns, NULLs last.

    A shallow page is one top-k pass. For a deep one the rows are numbered in ranges
    of the order, so that no task holds the skipped rows.
    """
    _checked(limit, offset)
    if offset + limit <= (SHALLOW_ROWS if shallow is None else shallow):
        return _top(df, order, limit, offset)
    nulls = {f"_null_{place}": F.col(name).isNull() for place, name in enumerate(order)}
    by = [name for pair in zip(nulls, order, strict=True) for name in pair]
    number = F.col("_number")
    found = number_rows(df.withColumns(nulls), [], by, "_number").where((number >= offset) & (number < offset + limit))
    return found.orderBy("_number").select(*df.columns)


def _count_buckets(rows: DataFrame, key: Column, shift: int) -> list:
    buckets = rows.groupBy(F.shiftright(key, shift).alias("bucket")).agg(F.count("*").alias("rows"))
    return sorted(buckets.limit(MOST_BUCKETS + 1).collect())


def _find(rows: DataFrame, key: Column, within, rank: int, room: int) -> tuple[int, int, int] | None:
    """A key at or before the row of 0-based ``rank`` in key order, the rows before that key,
    and a key at or after that row.

    Counts rows per bucket of the key, steps into the bucket that holds the rank and
    counts finer ones there, until a bucket has no more than ``room`` rows or is one
    key. Only bucket counts reach the driver.
    """
    coarse, first, *finer = _SHIFTS
    counts, shift = _count_buckets(rows, key, first), first
    if len(counts) > MOST_BUCKETS:
        counts, shift, finer = _count_buckets(rows, key, coarse), coarse, [first, *finer]
    before = 0
    while True:
        for bucket, count in counts:
            if before + count > rank:
                break
            before += count
        else:
            return None
        low, high = bucket << shift, (bucket + 1 << shift) - 1
        if count <= room or not finer:
            return low, before, high
        shift = finer.pop(0)
        counts = _count_buckets(rows.where(within(low, high)), key, shift)


def sample_page(samples: DataFrame, limit: int, offset: int = 0,
                shallow: int = SHALLOW_ROWS) -> DataFrame:
    """A page of samples by time, then ``id``; samples without a time come last.

    A shallow page is one top-k pass. For a deep one the start is looked up from
    counts per time bucket (and per id bucket where one instant holds very many
    rows), so no task ever holds the skipped rows. In a table that is partitioned by
    ``sample_date`` every step after the first opens the days of its span only.
    """
    order = ["sample_at", "id"]
    _checked(limit, offset)
    if offset + limit <= shallow:
        return _top(samples, order, limit, offset)

    # From micros to the column's type the same way as back, so that both agree at every instant.
    stamp_type = samples.schema["sample_at"].dataType
    by_date = "sample_date" in samples.columns

    def instant(micros: int) -> Column:
        return F.timestamp_micros(F.lit(micros)).cast(stamp_type)

    def in_span(low: int, high: int | None) -> Column:
        span = F.col("sample_at") >= instant(low)
        if by_date:
            span &= F.col("sample_date") >= F.lit(_day(low))
        if high is not None:
            span &= F.col("sample_at") <= instant(high)
            if by_date:
                span &= F.col("sample_date") <= F.lit(_day(high))
        return span

    room = max(shallow - limit, 0)
    timed = samples.where(F.col("sample_at").isNotNull())
    key = F.unix_micros(F.col("sample_at").cast("timestamp"))
    found = _find(timed, key, in_span, offset, room)
    if found is None:
        untimed = samples.where(F.col("sample_at").isNull())
        return page(untimed, ["id"], limit, offset - timed.count(), shallow)
    start, before, _ = found
    # The page ends where the rank of its last row is; beyond, nothing is read.
    last = _find(timed, key, in_span, offset + limit - 1, room)
    rest, skip = (samples if last is None else timed), offset - before
    rest = rest.where(in_span(start, None) | F.col("sample_at").isNull() if last is None else in_span(start, last[2]))
    if skip > room:
        tied = timed.where(in_span(start, start))
        first_id, before, _ = _find(tied, F.col("id"), lambda low, high: F.col("id").between(low, high), skip, room)
        rest = rest.where((F.col("sample_at") > instant(start)) | (F.col("id") >= first_id) | F.col("sample_at").isNull())
        skip -= before
    return _top(rest, order, limit, skip)


def _day(micros: int) -> date:
    """The day of an instant; the first or last day that dates can name beyond those."""
    try:
        return (datetime(1970, 1, 1) + timedelta(microseconds=micros)).date()
    except OverflowError:
        return date.min if micros < 0 else date.max
