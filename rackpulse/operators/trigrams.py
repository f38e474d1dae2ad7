"""Substring search in a large dimension by posting lists of trigrams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.text import contains_ignoring_case, like_pattern

WIDTH = 3


def trigrams(text: Column) -> Column:
    """The distinct three-character pieces of a lower-cased text; none for a shorter or missing one."""
    low = F.lower(text)
    last = F.greatest(F.char_length(low) - (WIDTH - 1), F.lit(0))
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda at: F.substring(low, at, F.lit(WIDTH)))
    return F.when(last > 0, F.array_distinct(pieces))


def wanted_trigrams(text: str) -> list[str]:
    """The trigrams that every match of a search text must hold.

    ``%`` and ``_`` are wildcards, so only what stands between them counts; a backslash
    makes the next character a letter. Characters whose case forms differ in length or by place are
    left out with their neighbours.
    """
    parts, now = [], ""
    for piece in re.findall(r"\\.|.", like_pattern(text) or "", flags=re.DOTALL):
        literal = piece[1:] if len(piece) > 1 else piece if piece not in "%_" else None
        if literal is None or literal.lower().upper() != literal.upper() or len(literal.lower()) != 1 or not literal.isascii():
            parts.append(now)
            now = ""
        else:
            now += literal.lower()
    runs = [*parts, now]
    return sorted({run[at:at + WIDTH] for run in runs for at in range(len(run) - WIDTH + 1)})


def posting_lists(rows: DataFrame, key: str, column: str) -> DataFrame:
    """``trigram`` and ``key``: one row per distinct trigram of ``column`` and row, to be written by ``write_postings``."""
    return rows.select(F.explode(trigrams(F.col(column))).alias("trigram"), key).distinct()


def write_postings(postings: DataFrame, path: str) -> None:
    """Posting lists laid out by trigram, so a lookup opens the row groups of its own ones."""
    postings.repartitionByRange("trigram").sortWithinPartitions("trigram").write.mode("overwrite").option(
        "parquet.bloom.filter.enabled#trigram", "true"
    ).parquet(path)


def candidates(postings: DataFrame, key: str, text: str) -> DataFrame | None:
    """The keys that stand in the lists of all trigrams of ``text``; None if it has none.

    The lists are intersected by counting: one pass over the wanted lists, combined
    before the shuffle, whatever their lengths.
    """
    wanted = wanted_trigrams(text)
    if not wanted:
        return None
    found = postings.where(F.col("trigram").isin(wanted)).groupBy(key).agg(F.count("*").alias("held"))
    return found.where(F.col("held") == len(wanted)).select(key)


def search(rows: DataFrame, postings: DataFrame, key: str, column: str, text: str) -> DataFrame:
    """The rows whose ``column`` contains ``text`` in any case: those of ``contains``, without reading the others.

    Candidates come from the posting lists and are verified on the text itself. A
    search text without three letters in a row looks through all rows.
    """
    keys = candidates(postings, key, text)
    some = rows if keys is None else rows.join(keys, key, "left_semi")
    return some.where(contains_ignoring_case(F.col(column), text))
