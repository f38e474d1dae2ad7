"""Dense row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.operators.sizes import written

_PART = 33  # monotonically_increasing_id: the task above these bits, the place in it below


def number_rows(df: DataFrame, keys: list[str], order: str | list[str], out: str) -> DataFrame:
    """0-based numbers per ``keys`` group, in the order of a column or several.

    Rows are laid out by range of (keys, order) and written once to the shared scratch
    folder with their place; ranges hold about equally many rows, whatever the values,
    so neither sparse order values nor one key with a third of all rows fill a task.
    Rows of a key in earlier ranges are then added. The sum over ranges sees one row
    per key and range.

    Every row is numbered: a NULL key is a key, and NULL order values come first.
    Rows that are equal in keys and order are numbered in some order.
    """
    order = [order] if isinstance(order, str) else order
    by = [*keys, *order]
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by) if by else df
    placed = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", _PART).alias("_part")
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*keys, part).agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
        .withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first"))
        .select(*(F.col(f"`{key}`").alias(f"_key_{place}") for place, key in enumerate(keys)), "_part", "_shift")
    )
    same = F.shiftright(placed["_id"], _PART) == F.col("_part")
    for place, key in enumerate(keys):
        same &= placed[key].eqNullSafe(F.col(f"_key_{place}"))
    return placed.join(written(shifts, "shifts"), same).select(
        *(placed[name] for name in df.columns), (F.col("_id") + F.col("_shift")).cast("bigint").alias(out)
    )
