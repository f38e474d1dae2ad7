"""Facts and dimension bucketed by device, so that joining them shuffles neither."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY = "uuid"


def save_bucketed(rows: DataFrame, table: str, path: str, buckets: int, order: list[str] | None = None) -> DataFrame:
    """Write ``rows`` as a catalog table of ``buckets`` buckets by device and return it.

    Rows are shuffled by device once, here, so every bucket is one sorted file. A device
    with very many samples makes its bucket, and the task that joins it, large: with
    such devices join the plain tables, where Spark splits skewed partitions.
    """
    sort = order or [KEY]
    (
        rows.repartition(buckets, KEY).write.mode("overwrite").option("path", path)
        .bucketBy(buckets, KEY).sortBy(*sort).saveAsTable(table)
    )
    return rows.sparkSession.table(table)


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """A table of ``save_bucketed``; joins and groupings by device need no exchange of it."""
    return spark.table(table)
