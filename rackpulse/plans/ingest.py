"""CSV files to log messages, and log messages to tables, as batch jobs."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.operators.merge import latest_state
from rackpulse.operators.records import check_records, split_rows, with_times
from rackpulse.operators.routing import in_partitions, tag_partition
from rackpulse.operators.sizes import written
from rackpulse.schemas import CSV_COLUMNS, DEFAULT_PARTITIONS, LOG_KEY, TELEMETRY_RECORD
from rackpulse.sources.log_files import message_records
from rackpulse.sources.tables import RECORD_ORDER, Tables


class Produced(NamedTuple):
    """Records ready for the log, and the CSV rows that will not get there."""

    records: DataFrame
    dead_letter: DataFrame


def produce(numbered: DataFrame, topic: str, producers: int, partitions: int = DEFAULT_PARTITIONS,
            stamp_ns: Column | None = None, arrival: str = "row_num") -> Produced:
    """What a fleet of ``producers`` sends: every row by its owner, to the owner's partition.

    Rows of a producer whose partition does not exist are set aside, like rows that
    do not parse. ``arrival`` numbers the rows uniquely, also over replay passes.
    """
    placed = tag_partition(numbered.withColumn("topic", F.lit(topic)), producers)
    keep = tuple(dict.fromkeys(["row_num", arrival, *LOG_KEY]))
    rows = split_rows(placed, stamp_ns, keep)
    routed = in_partitions(rows.good, partitions)
    raw_names = {"gpu_id": "gpu_index", "modelName": "model_name", "Hostname": "hostname"}
    raw = F.struct(*(
        (F.lit(None) if name == "timestamp" else F.col(raw_names.get(name, name))).cast("string").alias(name)
        for name in CSV_COLUMNS
    ))
    refused = routed.dead_letter.select("row_num", "reason", raw.alias("raw"))
    return Produced(routed.good, rows.dead_letter.select("row_num", "reason", "raw").unionByName(refused))


def batch_key(messages: DataFrame, group: str) -> str:
    """A name for a batch that only its content fixes: group, ranges of offsets, and a checksum.

    The same messages give the same name, whatever stream, checkpoint or number they come
    with; other messages give another one.
    """
    ranges = messages.groupBy(*LOG_KEY).agg(
        F.min("offset").alias("low"), F.max("offset").alias("high"), F.count("*").alias("rows"),
        F.sum(F.xxhash64("offset").cast("decimal(38,0)")).alias("check"),
    )
    whole = ranges.agg(
        F.sum("rows"), F.sum(F.xxhash64(*LOG_KEY, "low", "high", "rows", "check").cast("decimal(38,0)")),
        F.bit_xor(F.xxhash64("check", *LOG_KEY)),
    ).first()
    return hashlib.sha256(repr((group, *whole)).encode()).hexdigest()[:32]


def apply_batch(tables: Tables, messages: DataFrame, group: str, batch_id: int = 0,
                partitions: int = DEFAULT_PARTITIONS, cache: bool = False, stored: bool = False) -> None:
    """Write one batch of messages: devices, then samples, then what was refused and done.

    Every step can run again with the same batch and changes nothing then, so a
    crash between two steps heals when the batch is repeated. What is written is named
    by the messages themselves; ``batch_id`` is not, as numbers start again with a new
    checkpoint. With ``cache``, for a micro-batch, the messages are held for the steps;
    without it they are written once to the scratch folder, and each step reads the columns
    it needs from there instead of running the source again. Partitions of a log that
    ``read_log`` gave are ``stored`` as they are, so each step reads them there.
    """
    if cache:
        messages = messages.persist()
    elif not stored:
        messages = written(messages, "batch")
    try:
        batch = batch_key(messages, group)
        # A message without a place in the log has no id.
        placed = F.col("topic").isNotNull() & F.col("offset").isNotNull() & F.col("partition").between(0, partitions - 1)
        problem = F.when(F.col("payload").isNull(), "payload").when(~F.coalesce(placed, F.lit(False)), "place")
        broken = messages.withColumn("reason", problem).where(F.col("reason").isNotNull())
        timed = with_times(message_records(messages.where(problem.isNull())))
        checked = check_records(timed)
        tables.put_devices(latest_state(checked.devices, RECORD_ORDER), batch)
        tables.add_samples(checked.samples, partitions)
        payload = F.struct(*TELEMETRY_RECORD.names).alias("payload")
        refused = checked.dead_letter.select(*LOG_KEY, "offset", "reason", payload)
        empty = broken.select(*LOG_KEY, "offset", "reason", "payload")
        tables.put_dead_letters(refused.unionByName(empty), batch)
        done = checked.samples.groupBy(*LOG_KEY).agg(F.max("offset").alias("offset"))
        tables.put_acks(done.withColumn("consumer_group", F.lit(group)), batch)
    finally:
        if cache:
            messages.unpersist()
