"""Query parameters as users write them, checked before any plan is built."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from rackpulse.operators.paging import MOST_ROWS
from rackpulse.schemas import DEFAULT_LIMIT, MAX_LIMIT

_INTEGER = re.compile(r"[+-]?[0-9]+")
_RFC3339 = re.compile(
    r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:[.,]([0-9]+))?"
    r"(?:Z|([+-])([0-9]{2}):([0-9]{2}))"
)


def _integer(raw: str | int, name: str, least: int) -> int:
    text = str(raw)
    if not _INTEGER.fullmatch(text) or not least <= int(text) <= MOST_ROWS:
        raise ValueError(f"{name} must be an integer from {least} to {MOST_ROWS}")
    return int(text)


def parse_limit(raw: str | int | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    """Rows per page: the default if not given, an error below 1.

    ``most`` is the page size that a request gets at most, however many rows it asks for.
    """
    if raw is None or raw == "":
        return default
    return min(_integer(raw, "limit", 1), most)


def parse_offset(raw: str | int | None) -> int:
    """Rows to skip: 0 if not given, an error below 0."""
    if raw is None or raw == "":
        return 0
    return _integer(raw, "offset", 0)


def parse_time(raw: str | datetime | None, name: str) -> datetime | None:
    """Instant of an RFC 3339 text; the error names the field."""
    if raw is None or raw == "":
        return None
    if isinstance(raw, datetime):
        return raw if raw.tzinfo else raw.replace(tzinfo=timezone.utc)
    match = _RFC3339.fullmatch(raw)
    problem = ValueError(f"{name} must be an RFC 3339 time such as 2026-05-01T12:00:00Z")
    if not match:
        raise problem
    *fields, fraction, sign, hours, minutes = match.groups()
    try:
        micros = int((fraction or "0")[:6].ljust(6, "0"))
        local = datetime(*map(int, fields), micros, tzinfo=timezone.utc)
        if not sign:
            return local
        if int(hours) > 24 or int(minutes) > 59:
            raise problem
        shift = timedelta(hours=int(hours), minutes=int(minutes))
        return local - shift if sign == "+" else local + shift
    except (ValueError, OverflowError):
        raise problem from None


@dataclass(frozen=True)
class GpuFilter:
    """Optional filters of the device list; an empty text filters nothing."""

    model_name: str = ""
    hostname: str = ""
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    @classmethod
    def parse(cls, model_name="", hostname="", limit=None, offset=None) -> GpuFilter:
        return cls(model_name or "", hostname or "", parse_limit(limit), parse_offset(offset))


@dataclass(frozen=True)
class TelemetryFilter:
    """Optional filters of a sample search; empty or None filters nothing."""

    uuid: str = ""
    metric_name: str = ""
    model_name: str = ""
    start: datetime | None = None
    end: datetime | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0

    @classmethod
    def parse(cls, uuid="", metric_name="", model_name="", start_time=None, end_time=None,
              limit=None, offset=None) -> TelemetryFilter:
        start, end = parse_time(start_time, "start_time"), parse_time(end_time, "end_time")
        return cls(uuid or "", metric_name or "", model_name or "", start, end,
                   parse_limit(limit), parse_offset(offset))
