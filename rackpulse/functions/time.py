"""Instants: nanosecond integers, timestamps, RFC 3339 text."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def ns_to_timestamp(ns: Column) -> Column:
    """Timestamp of a Unix-nanosecond integer, rounded down to the microsecond."""
    whole = ns - F.pmod(ns, F.lit(1000))
    return F.timestamp_micros(F.call_function("div", whole, F.lit(1000)))


def now_ns() -> Column:
    """The batch's wall clock as Unix nanoseconds; one value per batch."""
    return F.unix_micros(F.current_timestamp()) * F.lit(1000)


def micros_of(instant: datetime) -> int:
    """Unix microseconds; a datetime without a zone counts as UTC."""
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=timezone.utc)
    return (instant - EPOCH) // timedelta(microseconds=1)


def instant_literal(instant: datetime, like: DataType) -> Column:
    """Literal of the column's own timestamp type, so that a bound reaches the scan."""
    if isinstance(like, TimestampNTZType):
        utc = EPOCH.replace(tzinfo=None) + timedelta(microseconds=micros_of(instant))
        return F.lit(utc.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(micros_of(instant)))


def rfc3339_text(stamp: Column) -> Column:
    """RFC 3339 text in UTC, without trailing zeros in the fraction."""
    text = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")), F.lit("Z"))
