"""The continuous consumer: log messages into the tables, micro-batch by micro-batch."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rackpulse.operators.numbering import number_rows
from rackpulse.plans.ingest import apply_batch, produce
from rackpulse.schemas import DEFAULT_PARTITIONS, SAMPLE_KEY
from rackpulse.sources.log_files import append_log
from rackpulse.sources.tables import Tables, read_or_empty


def start_ingest(messages: DataFrame, tables: Tables, checkpoint: str, group: str = "collector",
                 partitions: int = DEFAULT_PARTITIONS, every: str | None = None) -> StreamingQuery:
    """Start the query; the checkpoint keeps the place in the source.

    Without ``every`` it reads all there is and stops, with it (``"2 seconds"``) it
    keeps waiting for more. A micro-batch that is delivered again writes nothing
    twice. There is no watermark: a sample of any age is taken.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch has the streaming session's settings, so its tables are read there too.
        apply_batch(Tables(batch.sparkSession, tables.root), batch, group, batch_id, partitions, cache=True)

    writer = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def start_produce(rows: DataFrame, log: str, checkpoint: str, topic: str, producers: int,
                  partitions: int = DEFAULT_PARTITIONS, dead_letter: str | None = None,
                  every: str | None = None) -> StreamingQuery:
    """Append the rows of ``stream_csv`` to a log as files arrive; refused rows go to ``dead_letter``.

    Rows are numbered from 0 in each file, in file order, and offsets follow file name and
    row. A micro-batch that is delivered again after it was appended is left out: the
    batches that are done are listed beside the log, under the checkpoint's own id. After a
    crash between the append and its note the messages are appended again. If the stream
    was read with times they carry the same stamps then, so the tables take each sample
    once: a row is stamped with the time its file was modified and a microsecond per row
    before it. Else the wall clock of the batch is taken.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = f"{log.rstrip('/')}_done/{md5(checkpoint.encode()).hexdigest()}"
        listed = read_or_empty(spark, done, "batch_id bigint")
        if listed.where(F.col("batch_id") == batch_id).head(1):
            return
        # A file is parsed by one task, so the ids grow along its rows.
        rows_of_files = batch.withColumn("_id", F.monotonically_increasing_id())
        numbered = number_rows(rows_of_files, ["_file"], "_id", "row_num")
        stamp = (F.unix_micros("_modified") + F.col("row_num")) * 1000 if "_modified" in batch.columns else None
        made = produce(numbered, topic, producers, partitions, stamp, arrival="_file")
        append_log(made.records, log, ["_file", "row_num"])
        if dead_letter:
            made.dead_letter.write.mode("overwrite").parquet(f"{dead_letter}/batch_id={batch_id}")
        spark.createDataFrame([(batch_id,)], "batch_id bigint").coalesce(1).write.mode("append").parquet(done)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def dedup_within(samples: DataFrame, delay: str) -> DataFrame:
    """Drop repeated samples with bounded state: keys older than ``delay`` are forgotten.

    The tables do not need it, as they check every key; it is for sinks that cannot.
    """
    return samples.withWatermark("sample_at", delay).dropDuplicatesWithinWatermark(SAMPLE_KEY)
