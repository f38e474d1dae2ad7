"""Stored tables: device states, samples, acknowledgements, dead letters.

All of them are Parquet folders that are only ever added to, so a reader never
loses a file under its plan and a repeated batch changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, LongType, StringType, StructField, StructType

from rackpulse.operators.filters import equals
from rackpulse.operators.merge import first_wins, insert_if_absent, merge_states
from rackpulse.operators.seek import Cursor, seek
from rackpulse.operators.sizes import written
from rackpulse.schemas import ACK_LOG, GPUS, SAMPLE_KEY, TELEMETRY_RECORD, TELEMETRY_SAMPLES
from rackpulse.sources.sample_keys import KEY_FILTER, filter_rows, held_keys, possibly_held

# A later record wins by time, then by its place in the log.
RECORD_ORDER = ["ingested_unix_ns", "topic", "partition", "offset"]
_ORDER_FIELDS = [
    StructField("ingested_unix_ns", LongType()),
    StructField("topic", StringType()),
    StructField("partition", IntegerType()),
    StructField("offset", LongType()),
]
_BATCH = [StructField("batch", StringType())]
STATES = StructType([*GPUS.fields, *_ORDER_FIELDS])
CHANGES = StructType([*STATES.fields, *_BATCH])
VERSIONED = StructType([*STATES.fields, StructField("version", LongType())])
MARKERS = StructType([StructField("version", LongType()), *_BATCH])
STORED_SAMPLES = StructType([*TELEMETRY_SAMPLES.fields, StructField("sample_date", DateType())])
STORED_ACKS = StructType([*ACK_LOG.fields, *_BATCH])
DEAD_LETTERS = StructType([
    StructField("topic", StringType()), StructField("partition", IntegerType()), StructField("offset", LongType()),
    StructField("reason", StringType()), StructField("payload", TELEMETRY_RECORD), *_BATCH,
])
# One row per topic and number of partitions: their ids begin at number * ID_RANGE.
ID_RANGES = StructType([
    StructField("topic", StringType()), StructField("partitions", IntegerType()), StructField("number", LongType()),
])
ID_RANGE = 1 << 52
MOST_RANGES = 1 << 11

# Parquet options of the samples: what a lookup by device or metric compares, a row group
# can rule out by its Bloom filter where its smallest and largest value cannot.
SKIPPABLE = {
    f"parquet.bloom.filter.{option}#{name}": "true" for name in ("uuid", "metric_name") for option in ("enabled", "adaptive.enabled")
}
# A day is compacted into files of about so many bytes.
TARGET_BYTES = 256 << 20

# Days whose times and devices a lookup names one by one. More days are named by their dates
# and their common bounds: a filter of very many terms is too long for the JVM to compile.
MOST_DAYS = 8


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table at ``path``, or no rows if nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Tables:
    """The tables below one root folder that every executor can reach."""

    spark: SparkSession
    root: str

    def _read(self, name: str, schema: StructType) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/{name}", schema)

    def _put(self, rows: DataFrame, name: str, batch: str) -> None:
        """Write a batch's own folder; a repeated batch writes the same one again."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def _folders(self, name: str) -> list[str]:
        """Values of the partition folders of a table, from a listing by the driver."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        return [status.getPath().getName().partition("=")[2] for status in files.listStatus(path) if status.isDirectory()]

    # Devices: one state per device and batch, merged when read.

    def put_devices(self, states: DataFrame, batch: str) -> None:
        self._put(states.select(*STATES.names), "gpus/changes", batch)

    def _compacted(self) -> tuple[int, set[str]]:
        """The last complete version and the batches that are in it."""
        markers = self._read("gpus/compactions", MARKERS)
        return markers.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0], {
            row["batch"] for row in markers.select("batch").distinct().toLocalIterator()
        }

    def _open_batches(self, covered: set[str]) -> list[str]:
        return sorted(set(self._folders("gpus/changes")) - covered)

    def device_states(self) -> DataFrame:
        """Compacted states, and the states of the batches that no compaction holds yet."""
        version, covered = self._compacted()
        changes = self._read("gpus/changes", CHANGES).where(F.col("batch").isin(self._open_batches(covered)))
        compacted = self._read("gpus/compacted", VERSIONED).where(F.col("version") == version)
        return compacted.select(*STATES.names).unionByName(changes.select(*STATES.names))

    def devices(self) -> DataFrame:
        """The dimension: one current row per device."""
        return merge_states(self.device_states(), RECORD_ORDER).select(*GPUS.names)

    def compact_devices(self) -> None:
        """Write the merged states as a new version, to keep reads short.

        Run between batches. The markers name the batches that are in the version; they
        are written last, so an unfinished version is never read. A batch is marked once,
        by the version that took it in.
        """
        version, covered = self._compacted()
        taken = self._open_batches(covered)
        merge_states(self.device_states(), RECORD_ORDER).select(*STATES.names).write.mode("overwrite").parquet(
            f"{self.root}/gpus/compacted/version={version + 1}"
        )
        self.spark.createDataFrame([(version + 1, batch) for batch in taken], MARKERS).coalesce(1).write.mode(
            "append"
        ).parquet(f"{self.root}/gpus/compactions")

    # Samples: first row of a key stays.

    def samples(self) -> DataFrame:
        """The fact table, with ``sample_date`` for pruning."""
        return self._read("telemetry_samples", STORED_SAMPLES)

    def sample_days(self) -> list[date]:
        """The days that have samples, from the folder names."""
        return sorted(date.fromisoformat(name) for name in self._folders("telemetry_samples") if name[:1].isdigit())

    def newest_samples(self, limit: int, cursor: Cursor | None = None, **wanted: str) -> DataFrame:
        """The latest samples, or those before a cursor, of one ``uuid`` or ``metric_name`` if given."""
        return seek(equals(self.samples(), **wanted), self.sample_days(), limit, cursor)

    def sample_files(self) -> DataFrame:
        """Files and bytes per day; ``small`` counts the files below half of ``TARGET_BYTES``."""
        path = f"{self.root}/telemetry_samples"
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        return files.groupBy(F.col("sample_date").cast("date").alias("sample_date")).agg(
            F.count("*").alias("files"), F.sum("length").alias("bytes"),
            F.count_if(F.col("length") < TARGET_BYTES // 2).alias("small"),
        )

    def compact_samples(self, target_bytes: int = TARGET_BYTES, row_group_bytes: int | None = None) -> list[date]:
        """Rewrite the days that have several small files; returns them.

        Run between batches. The rows are laid out by range again, in as many files as a
        day has multiples of ``target_bytes``, and written beside the table first. Only
        then do they replace the days' folders; if that is cut short, the next
        compaction or insert finishes it from the complete copy.
        """
        self._finish_compaction()
        if not self.sample_days():
            return []
        crowded = self.sample_files().where("small > 1").select(
            "sample_date", F.ceil(F.col("bytes") / target_bytes).cast("int").alias("bins")
        ).collect()
        if not crowded:
            return []
        days = sorted(row["sample_date"] for row in crowded)
        rows = self.samples().where(F.col("sample_date").isin(days))
        writer = self._laid_out(rows, sum(row["bins"] for row in crowded))
        if row_group_bytes:
            writer = writer.option("parquet.block.size", row_group_bytes)
        writer.mode("overwrite").partitionBy("sample_date").parquet(self._copy)
        self._finish_compaction()
        return days

    @property
    def _copy(self) -> str:
        return f"{self.root}/telemetry_samples_compacted"

    def _finish_compaction(self) -> None:
        """Put a complete copy of compacted days in place of their folders."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        copy, table = jvm.Path(self._copy), jvm.Path(f"{self.root}/telemetry_samples")
        files = copy.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if files.exists(jvm.Path(copy, "_SUCCESS")):
            for status in files.listStatus(copy):
                if status.isDirectory():
                    old = jvm.Path(table, status.getPath().getName())
                    files.delete(old, True)
                    files.rename(status.getPath(), old)
        files.delete(copy, True)

    def _laid_out(self, rows: DataFrame, parts: int | None = None) -> DataFrameWriter:
        """Files cut by date, device, metric and time, with Bloom filters."""
        layout = ["sample_date", *SAMPLE_KEY]
        ranged = rows.repartitionByRange(parts, *layout) if parts else rows.repartitionByRange(*layout)
        return ranged.sortWithinPartitions(*layout).write.options(**SKIPPABLE)

    def _days_of(self, rows: DataFrame) -> list[date]:
        return [row["sample_date"] for row in rows.select("sample_date").distinct().collect()]

    def _key_filter(self, days: list[date]) -> DataFrame:
        return self._read("sample_keys", KEY_FILTER).where(F.col("sample_date").isin(days))

    def _remember(self, rows: DataFrame, mode: str = "append") -> None:
        """Put the keys of ``rows`` into the filter."""
        held = held_keys(self._key_filter(self._days_of(rows) if mode == "append" else []))
        # Few files a day: blocks are small, and each task would write a file for every day.
        laid = filter_rows(rows, held).repartition("sample_date", F.shiftright("block", 12))
        laid.write.mode(mode).partitionBy("sample_date").parquet(f"{self.root}/sample_keys")

    def _complete_filter(self) -> None:
        """Build the filter of samples that were stored before there was one."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        done = jvm.Path(f"{self.root}/sample_keys/_SUCCESS")
        if self.sample_days() and not done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            self._remember(self.samples(), "overwrite")

    def absent_samples(self, rows: DataFrame) -> DataFrame:
        """The rows, one per key and with ``sample_date``, whose key is not stored.

        The filter of the keys tells nearly all new rows. The others are looked up among
        the samples of their own days, times and devices; without any, no sample is read.
        """
        return insert_if_absent(rows, self._repeated(rows))

    def _repeated(self, rows: DataFrame) -> DataFrame:
        """The stored keys among those of ``rows``."""
        self._complete_filter()
        filters = self._key_filter(self._days_of(rows))
        maybe = written(possibly_held(rows, filters, held_keys(filters)), "maybe")
        return self._candidates(maybe).select(*SAMPLE_KEY).join(maybe.select(*SAMPLE_KEY), SAMPLE_KEY, "left_semi")

    def _candidates(self, rows: DataFrame) -> DataFrame:
        """Stored samples from the times and devices of some rows; only those can repeat their keys."""
        micros = F.unix_micros("sample_at")
        spans = rows.groupBy("sample_date").agg(
            F.min(micros).alias("low"), F.max(micros).alias("high"), F.min("uuid").alias("first"), F.max("uuid").alias("last")
        )
        stored = self.samples()
        days = spans.collect()
        if not days:
            return stored.limit(0)
        if len(days) > MOST_DAYS:
            low, high = min(span.low for span in days), max(span.high for span in days)
            return stored.where(
                F.col("sample_date").isin([span.sample_date for span in days])
                & F.col("sample_at").between(F.timestamp_micros(F.lit(low)), F.timestamp_micros(F.lit(high)))
                & F.col("uuid").between(min(span.first for span in days), max(span.last for span in days))
            )
        return stored.where(reduce(Column.__or__, [
            (F.col("sample_date") == F.lit(span.sample_date))
            & F.col("sample_at").between(F.timestamp_micros(F.lit(span.low)), F.timestamp_micros(F.lit(span.high)))
            & F.col("uuid").between(span.first, span.last) for span in days
        ]))

    def _claimed(self, number: int) -> int:
        """The first free number from ``number`` on, taken by creating its file.

        Of two writers that start at once only one creates a file; the other goes on to
        the next number, or fails and is repeated.
        """
        jvm = self.spark._jvm.org.apache.hadoop.fs
        files = jvm.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(jvm.Path(f"{self.root}/id_claims"))
        while not files.createNewFile(jvm.Path(f"{self.root}/id_claims/{number}")):
            number += 1
        return number

    def _id_start(self, rows: DataFrame, partitions: int) -> DataFrame:
        """``topic`` and the number of its id range, given out when a topic first comes.

        A number is claimed before it is stored, so it is never given twice, and a topic
        that two writers register at once may own two ranges.
        """
        known = self._read("id_ranges", ID_RANGES)
        rows = rows.where(F.col("topic").isNotNull()).select("topic").distinct()
        mine = known.where(F.col("partitions") == partitions).select("topic")
        new = sorted(row["topic"] for row in rows.join(mine, "topic", "left_anti").limit(MOST_RANGES + 1).collect())
        if new:
            first = known.agg(F.coalesce(F.max("number") + 1, F.lit(0))).first()[0]
            ranges = []
            for topic in new:
                first = self._claimed(first)
                if first >= MOST_RANGES:
                    raise ValueError(f"the tables hold at most {MOST_RANGES} topics")
                ranges.append((topic, partitions, first))
                first += 1
            self.spark.createDataFrame(ranges, ID_RANGES).coalesce(1).write.mode("append").parquet(f"{self.root}/id_ranges")
        return self._read("id_ranges", ID_RANGES).where(F.col("partitions") == partitions).groupBy("topic").agg(
            F.min("number").alias("_number")
        )

    def add_samples(self, samples: DataFrame, partitions: int) -> None:
        """Append the samples whose key is new; the first of a key wins.

        ``id`` is ``offset * partitions + partition`` within the topic's own range of ids,
        which is stored and never given to another topic or number of partitions, so ids
        stay unique over topics. The first row of each key is written once to the scratch
        folder, as the range layout reads the rows twice; if any of them is stored already,
        so are the rest. Files are cut by date, device, metric and time,
        so one device's range is few row groups and a busy device or day is spread. The
        keys go into the filter first: a crash before the samples leaves keys that are
        looked up in vain, never samples that the filter does not know.
        """
        self._finish_compaction()
        needed = samples.select(*TELEMETRY_SAMPLES.names[1:], *RECORD_ORDER)
        rows = written(first_wins(needed, RECORD_ORDER).withColumn("sample_date", F.to_date("sample_at")), "first")
        ranges = written(self._id_start(rows, partitions), "ranges")
        repeated = written(self._repeated(rows), "repeated")
        if repeated.head(1):
            rows = written(insert_if_absent(rows, repeated), "fresh")
        self._remember(rows)
        number = F.col("_number") * ID_RANGE + F.col("offset") * F.lit(partitions) + F.col("partition")
        placed = rows.join(ranges, "topic").withColumn("id", number).select(*STORED_SAMPLES.names)
        self._laid_out(placed).mode("append").partitionBy("sample_date").parquet(f"{self.root}/telemetry_samples")

    # Progress and rejected messages.

    def put_acks(self, acks: DataFrame, batch: str) -> None:
        self._put(acks.select(*ACK_LOG.names), "acks", batch)

    def acks(self) -> DataFrame:
        return self._read("acks", STORED_ACKS).select(*ACK_LOG.names)

    def put_dead_letters(self, rows: DataFrame, batch: str) -> None:
        self._put(rows.select(*DEAD_LETTERS.names[:-1]), "dead_letter", batch)

    def dead_letters(self) -> DataFrame:
        return self._read("dead_letter", DEAD_LETTERS).select(*DEAD_LETTERS.names[:-1])
