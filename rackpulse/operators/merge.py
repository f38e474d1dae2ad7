"""First-wins facts, last-wins dimension, and the reference between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.schemas import GPU_ATTRIBUTES, SAMPLE_KEY


def first_wins(rows: DataFrame, order: list[str], key: list[str] = SAMPLE_KEY) -> DataFrame:
    """One row per key, the lowest by ``order``.

    ``order`` must tell the rows of a key apart. Spark keeps the first row per key in
    each task before the shuffle (a window group limit), so a key with very many
    copies stays cheap. A hash of the key comes first, as rows sort far faster by one
    number than by texts that begin alike.
    """
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(F.xxhash64(*key), *key).orderBy(*order)))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def insert_if_absent(new: DataFrame, existing: DataFrame, key: list[str] = SAMPLE_KEY) -> DataFrame:
    """The rows of ``new`` whose key is not in ``existing``."""
    return new.join(existing.select(*key), key, "left_anti")


def latest_state(records: DataFrame, order: list[str], first_seen: str = "ingested_at",
                 last_seen: str = "ingested_at") -> DataFrame:
    """One row per device: attributes of the last record, first and last time seen.

    The order columns of the winning record are kept, so that states of several
    batches can be merged by the same rule. Rows are sorted for this, by a hash of the
    device first, as device names begin alike.
    """
    winner = F.max_by(F.struct(*GPU_ATTRIBUTES, *order), F.struct(*order))
    return (
        records.groupBy(F.xxhash64("uuid").alias("_hash"), "uuid")
        .agg(winner.alias("_last"), F.min(first_seen).alias("created_at"), F.max(last_seen).alias("updated_at"))
        .select("uuid", *(F.col("_last")[name].alias(name) for name in GPU_ATTRIBUTES),
                "created_at", "updated_at", *(F.col("_last")[name].alias(name) for name in order))
    )


def merge_states(states: DataFrame, order: list[str]) -> DataFrame:
    """Current device rows from the states of many batches."""
    return latest_state(states, order, "created_at", "updated_at")


def merge_devices(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or update one row per ``uuid``; ``created_at`` of a known device stays.

    All other columns come from ``incoming``, also where they are NULL there.
    """
    old, new = current.alias("old"), incoming.withColumn("_new", F.lit(True)).alias("new")
    arrived = F.col("new._new").isNotNull()

    def newest(name: str) -> Column:
        return F.when(arrived, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return old.join(new, F.col("old.uuid") == F.col("new.uuid"), "full_outer").select(
        F.coalesce("old.uuid", "new.uuid").alias("uuid"),
        *(newest(name) for name in GPU_ATTRIBUTES),
        F.coalesce("old.created_at", "new.created_at").alias("created_at"),
        newest("updated_at"),
    )


def with_device(samples: DataFrame, devices: DataFrame) -> DataFrame:
    """Samples whose device exists."""
    return samples.join(devices.select("uuid"), "uuid", "left_semi")


def without_device(samples: DataFrame, devices: DataFrame) -> DataFrame:
    """Samples that break the reference to the dimension."""
    return samples.join(devices.select("uuid"), "uuid", "left_anti")


def table_counts(devices: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of both tables, one row per table."""
    return (
        devices.agg(F.count("*").alias("row_count")).select(F.lit("gpus").alias("table_name"), "row_count")
        .unionByName(samples.agg(F.count("*").alias("row_count"))
                     .select(F.lit("telemetry_samples").alias("table_name"), "row_count"))
    )
