"""The partitioned message log as Parquet: append, batch read, stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from rackpulse.functions.time import now_ns
from rackpulse.operators.progress import assign_offsets
from rackpulse.operators.sizes import written
from rackpulse.schemas import LOG_KEY, SEGMENT, STORED_LOG, TELEMETRY_RECORD
from rackpulse.sources.tables import read_or_empty


_HEADS = StructType([
    StructField("topic", StringType()), StructField("partition", IntegerType()), StructField("head", LongType()),
])


def to_messages(records: DataFrame, timestamp_ns=None) -> DataFrame:
    """Envelope around records that carry ``topic``, ``partition`` and ``offset``."""
    stamp = now_ns() if timestamp_ns is None else timestamp_ns
    return records.select(
        "topic", "partition", "offset",
        F.struct(*TELEMETRY_RECORD.names).alias("payload"),
        F.create_map().cast("map<string,string>").alias("headers"),
        stamp.cast("bigint").alias("timestamp_ns"),
    )


def message_records(messages: DataFrame) -> DataFrame:
    """Payload fields with the message's place in the log."""
    return messages.select(*LOG_KEY, "offset", "payload.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All messages of the log, with their ``segment``; none if it is not written yet."""
    return read_or_empty(spark, path, STORED_LOG)


def stream_log(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New messages; the query's checkpoint remembers what has been read."""
    return spark.readStream.schema(STORED_LOG).option("maxFilesPerTrigger", max_files).parquet(path)


def stored_heads(log: DataFrame) -> DataFrame:
    """Next offset of each partition of a stored log, read from its last segments only.

    The last segments come from folder names and file footers; joining on them
    prunes the scan of the offsets to those folders.
    """
    last = log.groupBy(*LOG_KEY).agg(F.max("segment").alias("segment")).where(F.col("segment") >= 0)
    newest = log.join(written(last, "segments"), [*LOG_KEY, "segment"], "left_semi")
    return newest.groupBy(*LOG_KEY).agg((F.max("offset") + 1).alias("head"))


def write_log(messages: DataFrame, path: str, ranged: bool = False) -> None:
    """Append rows that have their offsets, in folders by topic, partition and segment.

    Rows are laid out by range first, so a file holds one range of offsets of one
    partition and a reader opens few of them. With ``ranged`` they lie so already, as
    ``number_rows`` stored them, and each task sorts what it reads.
    """
    folders = [*LOG_KEY, "segment"]
    placed = messages.withColumn("segment", F.call_function("div", F.col("offset"), F.lit(SEGMENT)))
    ranges = placed if ranged else placed.repartitionByRange(*folders, "offset")
    ranges.sortWithinPartitions(*folders, "offset").write.mode("append").partitionBy(*folders).parquet(path)


def manifest_heads(spark: SparkSession, path: str) -> DataFrame:
    """Next offset of each partition, from the manifest beside the log.

    Every append adds the heads it has reached, a row per topic and partition, so this
    does not open the log. A log that was written without appends is looked through.
    """
    known = read_or_empty(spark, _manifest(path), _HEADS)
    if known.head(1):
        return known.groupBy(*LOG_KEY).agg(F.max("head").alias("head"))
    return stored_heads(read_log(spark, path))


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}_heads"


def append_log(records: DataFrame, path: str, arrival: str | list[str]) -> None:
    """Append records with a ``topic`` and ``partition``; offsets go on from the log.

    One writer per log at a time, as offsets are read before they are given out. The
    heads are written before the messages: after a crash in between, offsets are left
    out but never given twice.
    """
    spark = records.sparkSession
    known = written(manifest_heads(spark, path), "heads")
    # The numbered rows are stored by range; what is added to them here is two small joins.
    placed = assign_offsets(records, arrival, known)
    reached = placed.groupBy(*LOG_KEY).agg((F.max("offset") + 1).alias("head"))
    reached.select(*_HEADS.names).coalesce(1).write.mode("append").parquet(_manifest(path))
    write_log(to_messages(placed), path, ranged=True)
