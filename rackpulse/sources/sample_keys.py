"""A filter of stored sample keys per day: a key that it does not hold is new.

The filter is a table of bitmaps, a Bloom filter cut into blocks. A key belongs to one
block and sets some bits of it, so it is looked up by one equi-join. A day begins with one
block; when its keys outgrow a level, further keys go to one with at least four times the
blocks. Rows of the same block are combined by OR, so an insert only ever adds rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DateType, IntegerType, LongType, StructField, StructType

from rackpulse.operators.sizes import written
from rackpulse.schemas import SAMPLE_KEY

KEY_FILTER = StructType([
    StructField("level", IntegerType()), StructField("block", LongType()), StructField("bits", BinaryType()),
    StructField("keys", LongType()), StructField("sample_date", DateType()),
])
# Bits of one of Spark's bitmaps, keys that fill one (16 bits a key), bits set per key:
# about one absent key in 1700 is taken for a stored one, and then looked up.
BLOCK_BITS, KEYS_PER_BLOCK, PROBES = 1 << 15, 1 << 11, 8
_BLOCK = ["sample_date", "level", "block"]


def _positions() -> list[Column]:
    """The bits of a key in its block, from slices of two hashes."""
    hashes = F.xxhash64(*SAMPLE_KEY), F.xxhash64(F.lit(1), *SAMPLE_KEY)
    low = F.lit(BLOCK_BITS - 1).cast("bigint")
    return [F.shiftrightunsigned(value, 16 * place).bitwiseAND(low) for value in hashes for place in range(PROBES // 2)]


def _block() -> Column:
    """The block of a key among the 4 ^ ``level`` of its level."""
    blocks = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("level") * 2)
    return F.pmod(F.xxhash64(F.lit(2), *SAMPLE_KEY), blocks)


def held_keys(filters: DataFrame) -> DataFrame:
    """Keys per day and level: a few rows per day, computed once."""
    return written(filters.groupBy("sample_date", "level").agg(F.sum("keys").alias("keys")), "levels")


def filter_rows(fresh: DataFrame, held: DataFrame) -> DataFrame:
    """The rows that put the keys of ``fresh`` into the filter.

    ``held`` are the keys per level of its days. A day's last level takes the keys if
    they fit. What is put in twice only counts twice.
    """
    arriving = fresh.groupBy("sample_date").agg(F.count("*").alias("arriving"))
    last = held.groupBy("sample_date").agg(
        F.max("level").alias("last"), F.max_by("keys", "level").alias("filled"), F.sum("keys").alias("total")
    )
    wanted = F.col("arriving") + F.coalesce("total", F.lit(0))
    needed = F.greatest(F.ceil(F.log(4.0, wanted / KEYS_PER_BLOCK)).cast("int"), F.coalesce(F.col("last") + 1, F.lit(0)))
    room = F.call_function("shiftleft", F.lit(KEYS_PER_BLOCK).cast("bigint"), F.col("last") * 2)
    level = F.when(F.col("filled") + F.col("arriving") <= room, F.col("last")).otherwise(needed)
    levels = written(arriving.join(last, "sample_date", "left").select("sample_date", level.alias("level")), "levels")
    placed = fresh.join(levels, "sample_date").withColumn("block", _block())
    return placed.select(*_BLOCK, F.explode(F.array(*_positions())).alias("_at")).groupBy(*_BLOCK).agg(
        F.bitmap_construct_agg("_at").alias("bits"), (F.count("*") / PROBES).cast("bigint").alias("keys")
    ).select(*KEY_FILTER.names)


def possibly_held(rows: DataFrame, filters: DataFrame, held: DataFrame) -> DataFrame:
    """The keys of ``rows``, with ``sample_date``, that the filter may hold: all stored ones, and a few more."""
    def is_set(position: Column) -> Column:
        place = F.call_function("div", position, F.lit(8)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col("bits"), place + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (position % 8).cast("int")) % 2 == 1

    blocks = filters.groupBy(*_BLOCK).agg(F.bitmap_or_agg("bits").alias("bits"))
    asked = rows.select("sample_date", *SAMPLE_KEY).join(held.select("sample_date", "level"), "sample_date")
    found = asked.withColumn("block", _block()).join(blocks, _BLOCK).where(
        reduce(Column.__and__, [is_set(position) for position in _positions()])
    )
    return found.select("sample_date", *SAMPLE_KEY).distinct()
