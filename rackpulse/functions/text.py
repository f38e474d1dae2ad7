"""Null, length and LIKE helpers for strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def null_if_empty(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def like_pattern(text: str | None) -> str | None:
    """``%text%`` for ILIKE; None (no filter) for an empty text.

    The user's ``%`` and ``_`` stay wildcards. A backslash makes the next character
    literal; Spark only takes it before ``%``, ``_`` and another backslash, so it
    is dropped before any other character.
    """
    if not text:
        return None
    return re.sub(
        r"\\(.)",
        lambda m: m.group(0) if m.group(1) in "%_\\" else m.group(1),
        f"%{text}%",
        flags=re.DOTALL,
    )


def contains_ignoring_case(column: Column, text: str) -> Column:
    return column.ilike(like_pattern(text))


def too_long(column: Column, most: int) -> Column:
    """True if more than ``most`` characters; blanks past the end do not count."""
    return F.char_length(F.rtrim(column)) > most


def clipped(column: Column, most: int) -> Column:
    """The column without the blanks that ``too_long`` lets pass."""
    return F.substring(column, 1, most)
