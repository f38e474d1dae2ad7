"""Tables that running queries keep as state: devices, models, log heads, commits.

A query's state store is the table: it holds one row per key, a micro-batch touches the
keys it brings only, and batch jobs read it through Spark's own state reader. The driver
sees no rows and no lists of batches. All need the RocksDB provider (``STATE_CONF``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from rackpulse.schemas import DEFAULT_CAPACITY, GPU_ATTRIBUTES, GPUS, LOG_KEY, PROGRESS_KEY

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
_ORDER = ["stamp", *LOG_KEY, "offset"]
_LOWEST, _HIGHEST = -(1 << 63), (1 << 63) - 1
_SEEN = StructType([
    *(StructField(name, StringType()) for name in GPU_ATTRIBUTES),
    StructField("first_us", LongType()), StructField("last_us", LongType()), StructField("stamp", LongType()),
    StructField("topic", StringType()), StructField("partition", LongType()), StructField("offset", LongType()),
])
_RECORD = StructType([StructField("uuid", StringType()), *_SEEN.fields])
_CHANGE = StructType([*_RECORD.fields, StructField("known", BooleanType()), StructField("old_model", StringType())])


def _seen(devices: DataFrame) -> DataFrame:
    """Device records as the state compares them; a missing time sorts first and counts for no bound."""
    micros = F.unix_micros("ingested_at")
    return devices.select(
        "uuid", *GPU_ATTRIBUTES, F.coalesce(micros, F.lit(_HIGHEST)).alias("first_us"),
        F.coalesce(micros, F.lit(_LOWEST)).alias("last_us"), F.coalesce("ingested_unix_ns", F.lit(_LOWEST)).alias("stamp"),
        "topic", F.col("partition").cast("bigint").alias("partition"), "offset",
    )


def _combined(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per device and Arrow batch, before the shuffle: a busy device sends few rows."""
    for rows in batches:
        rows = rows.sort_values(_ORDER)
        by_device = rows.groupby("uuid", sort=False)
        last = by_device.tail(1).set_index("uuid")
        last["first_us"], last["last_us"] = by_device["first_us"].min(), by_device["last_us"].max()
        yield last.reset_index()[_RECORD.names]


class DeviceState(StatefulProcessor):
    """Last record of a device by (time, topic, partition, offset), first and last time seen.

    Works on rows: a device brings one or a few, for which a pandas frame costs more than the rest.
    """

    def init(self, handle) -> None:
        self.state = handle.getValueState("device", _SEEN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        old = now = None if held is None else tuple(held)
        for row in rows:
            row = tuple(row[name] for name in _SEEN.names)
            now = row if now is None else self._later(now, row)
        if now != old:
            self.state.update(now)
            model = None if old is None else old[_SEEN.names.index("model_name")]
            yield Row(**dict(zip(_CHANGE.names, (key[0], *now, old is not None, model), strict=True)))

    @staticmethod
    def _later(one: tuple, other: tuple) -> tuple:
        """The state of both: the later record, the earliest first and the latest last time."""
        at = len(GPU_ATTRIBUTES)
        last = max(one, other, key=lambda row: row[at + 2:])
        return (*last[:at], min(one[at], other[at]), max(one[at + 1], other[at + 1]), *last[at + 2:])

    def close(self) -> None:
        pass


def _times() -> list[Column]:
    return [
        F.when(F.col(name) != missing, F.timestamp_micros(F.col(name))).alias(out)
        for name, missing, out in (("first_us", _HIGHEST, "created_at"), ("last_us", _LOWEST, "updated_at"))
    ]


def device_changes(devices: DataFrame) -> DataFrame:
    """The devices that a micro-batch changes: the new row, whether it was known, and its model before.

    ``devices`` are checked device records of a stream, with ``ingested_at``.
    """
    combined = _seen(devices).mapInPandas(_combined, _RECORD)
    changed = combined.groupBy("uuid").transformWithState(DeviceState(), _CHANGE, "Update", "None")
    return changed.select("uuid", *GPU_ATTRIBUTES, *_times(), "known", "old_model")


def model_deltas(changes: DataFrame) -> DataFrame:
    """What device changes add to the counts per model: +1 for the new model, -1 for the one before."""
    moved = ~F.col("known") | ~F.col("model_name").eqNullSafe(F.col("old_model"))
    gained = F.struct(F.col("model_name"), F.lit(1).alias("delta"))
    lost = F.when(F.col("known"), F.struct(F.col("old_model").alias("model_name"), F.lit(-1).alias("delta")))
    rows = changes.where(moved).select(F.explode(F.array_compact(F.array(gained, lost))).alias("change"))
    return rows.groupBy("change.model_name").agg(F.sum("change.delta").alias("delta")).where("delta != 0")


def start_devices(devices: DataFrame, checkpoint: str, deltas: str | None = None, every: str | None = None) -> StreamingQuery:
    """Keep device states in the query at ``checkpoint``; with ``deltas`` also the counts per model.

    Each micro-batch writes its few count changes to its own folder below ``deltas``,
    where a repeated batch writes the same again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if deltas:
            model_deltas(batch).write.mode("overwrite").parquet(f"{deltas}/batch_id={batch_id}")
        else:
            batch.write.format("noop").mode("append").save()

    return _started(device_changes(devices).writeStream.foreachBatch(write), checkpoint, every)


def _started(writer, checkpoint: str, every: str | None) -> StreamingQuery:
    writer = writer.outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def kept_devices(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The device table as of the last finished micro-batch."""
    state = spark.read.format("statestore").option("stateVarName", "device").load(checkpoint)
    rows = state.select("key.uuid", "value.*")
    return rows.select("uuid", *GPU_ATTRIBUTES, *_times()).select(*GPUS.names)


def kept_model_counts(spark: SparkSession, deltas: str) -> DataFrame:
    """Devices per model from the count changes of all micro-batches, most first, then by name."""
    rows = spark.read.schema("model_name string, delta bigint").parquet(deltas)
    return (
        rows.groupBy("model_name").agg(F.sum("delta").cast("int").alias("gpu_count")).where("gpu_count != 0")
        .orderBy(F.desc("gpu_count"), F.asc("model_name"))
    )


def _start_highest(rows: DataFrame, keys: list[str], checkpoint: str, every: str | None) -> StreamingQuery:
    """Keep the highest offset per key; tasks combine their rows before the shuffle."""
    return _started(rows.groupBy(*keys).agg(F.max("offset").alias("highest")).writeStream.format("noop"), checkpoint, every)


def _kept_highest(spark: SparkSession, keys: list[str], checkpoint: str) -> DataFrame:
    state = spark.read.format("statestore").load(checkpoint)
    # The state of an aggregate names its buffers, not its result.
    highest = F.col("value")[state.schema["value"].dataType[0].name]
    return state.select(*(F.col(f"key.{name}").alias(name) for name in keys), highest.alias("highest"))


def start_heads(messages: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep the heads of a log up to date from its stream of messages."""
    return _start_highest(messages, LOG_KEY, checkpoint, every)


def kept_heads(spark: SparkSession, checkpoint: str, capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """Next and oldest readable offset of each partition, without opening the log."""
    return _kept_highest(spark, LOG_KEY, checkpoint).select(
        *LOG_KEY, (F.col("highest") + 1).alias("head"),
        F.greatest(F.lit(0).cast("bigint"), F.col("highest") + 1 - capacity).alias("tail"),
    )


def start_commits(acks: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep the committed offsets of all groups up to date from a stream of acknowledgements."""
    return _start_highest(acks, PROGRESS_KEY, checkpoint, every)


def kept_commits(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Highest acknowledged offset per topic, group and partition."""
    return _kept_highest(spark, PROGRESS_KEY, checkpoint).select(*PROGRESS_KEY, F.col("highest").alias("committed"))
