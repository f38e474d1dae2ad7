"""Endless or counted replay of numbered CSV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.schemas import DEFAULT_INTERVAL_MS


def _stamp_ns(tick: Column, interval_ms: int, start_us: int) -> Column:
    # At least a microsecond apart, so that no two rows share a sample key.
    return F.lit(start_us * 1000) + tick * F.lit(max(interval_ms * 1_000_000, 1000))


def replay(rows: DataFrame, passes: int, total: int, interval_ms: int = DEFAULT_INTERVAL_MS,
           start_us: int = 0) -> DataFrame:
    """``passes`` passes over ``total`` numbered rows, each pass with fresh stamps.

    Row numbers start again at 0 in every pass. ``stamp_ns`` is the time at which a
    producer with a fixed gap per row sends the row.
    """
    if passes < 1:
        return rows.withColumns({"pass": F.lit(0), "stamp_ns": F.lit(0).cast("bigint")}).limit(0)
    again = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    tick = F.col("pass") * F.lit(total) + F.col("row_num")
    return again.withColumn("stamp_ns", _stamp_ns(tick, interval_ms, start_us))


def replay_stream(spark: SparkSession, rows: DataFrame, total: int, rows_per_batch: int,
                  interval_ms: int = DEFAULT_INTERVAL_MS, start_us: int = 0) -> DataFrame:
    """The same replay without end, ``rows_per_batch`` rows in each micro-batch.

    With a trigger of ``rows_per_batch * interval_ms`` this is the paced feed. The
    stored rows are read again in every micro-batch; keep them as Parquet.
    """
    ticks = (
        spark.readStream.format("rate-micro-batch")
        .option("rowsPerBatch", rows_per_batch)
        .option("advanceMillisPerBatch", max(rows_per_batch * interval_ms, 1))
        .load()
        .select(
            (F.col("value") % F.lit(total)).alias("row_num"),
            F.call_function("div", F.col("value"), F.lit(total)).alias("pass"),
            _stamp_ns(F.col("value"), interval_ms, start_us).alias("stamp_ns"),
        )
    )
    return rows.join(ticks, "row_num").select(*rows.columns, "pass", "stamp_ns")
