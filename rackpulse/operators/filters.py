"""Optional filters: an unset one adds nothing to the plan."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.text import contains_ignoring_case
from rackpulse.functions.time import instant_literal, micros_of


def equals(df: DataFrame, **values: str | None) -> DataFrame:
    """Exact, case-sensitive match on every column that has a value."""
    for name, value in values.items():
        if value:
            df = df.where(F.col(name) == F.lit(value))
    return df


def contains(df: DataFrame, **texts: str | None) -> DataFrame:
    """Case-insensitive substring match on every column that has a text."""
    for name, text in texts.items():
        if text:
            df = df.where(contains_ignoring_case(F.col(name), text))
    return df


def _date_of(instant: datetime):
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros_of(instant))).date()


def in_time_range(samples: DataFrame, start: datetime | None, end: datetime | None,
                  column: str = "sample_at") -> DataFrame:
    """Rows from ``start`` to ``end``, both included, either may be None.

    Where the table is partitioned by ``sample_date`` the same bounds on the date
    let the scan skip whole folders.
    """
    stamp_type = samples.schema[column].dataType
    by_date = column == "sample_at" and "sample_date" in samples.columns
    if start is not None:
        samples = samples.where(F.col(column) >= instant_literal(start, stamp_type))
        if by_date:
            samples = samples.where(F.col("sample_date") >= F.lit(_date_of(start)))
    if end is not None:
        samples = samples.where(F.col(column) <= instant_literal(end, stamp_type))
        if by_date:
            samples = samples.where(F.col("sample_date") <= F.lit(_date_of(end)))
    return samples
