"""Sides that are computed once and whose size Spark then knows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rackpulse.session import scratch_dir


def written(side: DataFrame, name: str = "side") -> DataFrame:
    """``side``, computed once, written to the shared scratch folder and read back.

    Its plan is not repeated by those who use it, and joins see its true size: Spark
    broadcasts it up to ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond.
    Only for batch DataFrames.
    """
    path = scratch_dir(side.sparkSession, name)
    side.write.parquet(path)
    return side.sparkSession.read.schema(side.schema).parquet(path)
