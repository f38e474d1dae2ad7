"""Queries over stored tables and running streams, next to the SQL that must agree."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.operators import progress
from rackpulse.operators.records import check_records, with_times
from rackpulse.operators.seek import pages
from rackpulse.operators.sizes import written
from rackpulse.operators.trigrams import posting_lists, search, write_postings
from rackpulse.plans import queries, views
from rackpulse.plans.checks import (
    GPU_COLUMNS,
    ORACLE,
    QUERIES,
    RECORD_COLUMNS,
    RECORD_NAMES,
    SAMPLE_COLUMNS,
    STORED_SQL,
    query,
    stored_columns,
)
from rackpulse.plans.ingest import apply_batch
from rackpulse.plans.params import TelemetryFilter
from rackpulse.schemas import DEFAULT_PARTITIONS, MESSAGE_LOG, SAMPLE_KEY
from rackpulse.session import scratch_dir
from rackpulse.sources.bucketed import save_bucketed
from rackpulse.sources.log_files import append_log, message_records, read_log, stream_log, write_log
from rackpulse.sources.subscribe import subscribe
from rackpulse.sources.tables import Tables
from rackpulse.streaming.ingest import dedup_within
from rackpulse.streaming.state import (
    STATE_CONF,
    kept_commits,
    kept_devices,
    kept_heads,
    kept_model_counts,
    start_commits,
    start_devices,
    start_heads,
)

__all__ = ["ORACLE", "QUERIES"]  # those of plans/checks.py, with the queries of this module


def _loaded(spark, sf, parts: int = 1) -> Tables:
    """Tables that took the records of all events in several batches, every batch over all days."""
    tables, path = Tables(spark, scratch_dir(spark, "tables")), scratch_dir(spark, "log")
    append_log(views.records(spark, sf), path, "event_id")
    messages = read_log(spark, path)
    for part in range(parts):
        apply_batch(tables, messages.where(F.col("partition") % parts == part), "collector", part, stored=True)
    return tables


def _plain_times(samples: DataFrame) -> DataFrame:
    return samples.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("ingested_at", "sample_at")})


@query(f"SELECT {SAMPLE_COLUMNS} FROM telemetry_samples s ORDER BY s.sample_at DESC, s.id DESC LIMIT 700")
def samples_newest_first(spark, sf):
    return _plain_times(queries.sample_output(_loaded(spark, sf).newest_samples(700)))


@query(f"""SELECT {SAMPLE_COLUMNS} FROM telemetry_samples s WHERE s.uuid = 'GPU-000008' AND s.metric_name = 'EVT_CLICK'
           ORDER BY s.sample_at DESC, s.id DESC LIMIT 40""")
def device_samples_newest_first(spark, sf):
    found = _loaded(spark, sf, 2).newest_samples(40, uuid="GPU-000008", metric_name="EVT_CLICK")
    return _plain_times(queries.sample_output(found))


@query(STORED_SQL)
def samples_compacted(spark, sf):
    tables = _loaded(spark, sf, 3)
    tables.compact_samples()
    return stored_columns(tables)


@query("SELECT event_id AS id, uuid, metric_name, sample_at, value FROM records WHERE event_id % 10 IN (2, 5, 7)")
def stored_absent(spark, sf):
    """What an insert of all records would add to tables that miss three log partitions of each day."""
    tables, path = Tables(spark, scratch_dir(spark, "tables")), scratch_dir(spark, "log")
    append_log(views.records(spark, sf), path, "event_id")
    messages = read_log(spark, path)
    late = F.col("partition").isin(2, 5, 7)
    apply_batch(tables, messages.where(~late), "collector", stored=True)
    samples = check_records(with_times(message_records(messages))).samples
    absent = tables.absent_samples(samples.withColumn("sample_date", F.to_date("sample_at")))
    return absent.select(
        (F.col("offset") * DEFAULT_PARTITIONS + F.col("partition")).alias("id"), "uuid", "metric_name",
        F.col("sample_at").cast("timestamp_ntz").alias("sample_at"), "value",
    )


@query("""SELECT event_id AS id, date_trunc('day', ts) AS sample_at,
            (row_number() OVER (ORDER BY date_trunc('day', ts) DESC, event_id DESC) - 1)
              // ((SELECT count(*) FROM events) // 5 + 1) AS page_number FROM events""")
def samples_keyset_pages(spark, sf):
    """All samples in five pages, the times of a day tied."""
    path = scratch_dir(spark, "tied")
    tied = views.samples(spark, sf).withColumn("sample_at", F.date_trunc("day", "sample_at").cast("timestamp_ntz"))
    tied.withColumn("sample_date", F.to_date("sample_at")).write.partitionBy("sample_date").parquet(path)
    samples = spark.read.parquet(path)
    days = [row[0] for row in samples.select("sample_date").distinct().collect()]
    size = samples.count() // 5 + 1
    numbered = [
        page.select("id", "sample_at", F.lit(number).cast("bigint").alias("page_number"))
        for number, page in enumerate(pages(samples, days, size))
    ]
    return reduce(DataFrame.unionByName, numbered)


@query(f"""SELECT CAST(place AS INT) AS part_id, msg_offset, {RECORD_COLUMNS} FROM (
             SELECT *, event_id % 10 AS place, row_number() OVER (PARTITION BY event_id % 10 ORDER BY event_id) - 1 AS msg_offset,
               count(*) OVER (PARTITION BY event_id % 10) AS head FROM records)
           WHERE place = 9 OR msg_offset * 10 >= head * (place + 1)""")
def stream_resume(spark, sf):
    """A subscription from the committed offsets, stopped and started again while the log grows."""
    log, out, place = (scratch_dir(spark, name) for name in ("log", "resumed", "checkpoint"))
    rows = views.records(spark, sf)
    total = rows.groupBy("partition").agg(F.count("*").alias("head"))
    acks = total.where("partition < 9").select(
        F.lit(views.TOPIC).alias("topic"), F.lit(views.GROUP).alias("consumer_group"), "partition",
        (F.ceil(F.col("head") * (F.col("partition") + 1) / 10) - 1).cast("bigint").alias("offset"),
    )
    early = F.col("event_id") < views.table(spark, sf, "events").count() // 2
    for part in (early, ~early):
        append_log(rows.where(part), log, "event_id")
        feed = subscribe(spark, log, views.TOPIC, progress.committed(acks), views.GROUP)
        run = feed.writeStream.format("parquet").option("checkpointLocation", place).trigger(availableNow=True).start(out)
        run.awaitTermination()
    found = spark.read.schema(MESSAGE_LOG).parquet(out)
    return message_records(found).select(
        F.col("partition").alias("part_id"), F.col("offset").alias("msg_offset"), *RECORD_NAMES
    )


# State kept by running queries.

@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """The provider that the stateful queries need, for as long as they run."""
    usual = {name: spark.conf.get(name) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in usual.items():
            spark.conf.set(name, value)


def _device_stream(spark, sf, out: str) -> DataFrame:
    """A log whose records change every device's attributes, put through the device state in some micro-batches.

    Returns what ``out`` names: the devices, or the counts per model.
    """
    log, checkpoint, deltas = (scratch_dir(spark, name) for name in ("log", "checkpoint", "deltas"))
    rows, event = views.records(spark, sf), F.col("event_id")
    changing = rows.withColumns({
        "gpu_index": (event % 8).cast("string"), "device": F.col("metric_name"),
        "model_name": F.concat(F.lit("MODEL "), "metric_name"), "hostname": F.concat(F.lit("host-"), event.cast("string")),
    })
    append_log(changing, log, "event_id")
    timed = with_times(message_records(stream_log(spark, log, max_files=4)))
    with _state_store(spark):
        start_devices(check_records(timed).devices, checkpoint, deltas).awaitTermination()
        return written(kept_devices(spark, checkpoint) if out == "devices" else kept_model_counts(spark, deltas), out)


_LATEST = """SELECT * FROM (
    SELECT uuid, CAST(event_id % 8 AS VARCHAR) AS gpu_index, metric_name AS device, 'MODEL ' || metric_name AS model_name,
      'host-' || event_id AS hostname, min(sample_at) OVER (PARTITION BY uuid) AS created_at,
      max(sample_at) OVER (PARTITION BY uuid) AS updated_at,
      row_number() OVER (PARTITION BY uuid ORDER BY sample_at DESC, event_id % 10 DESC, event_id DESC) AS place FROM records)
  WHERE place = 1"""


@query(f"SELECT uuid, gpu_index, device, model_name, hostname, created_at, updated_at FROM ({_LATEST})")
def stream_device_state(spark, sf):
    times = {name: F.col(name).cast("timestamp_ntz") for name in ("created_at", "updated_at")}
    return _device_stream(spark, sf, "devices").withColumns(times)


@query(f"SELECT model_name, CAST(count(*) AS INT) AS gpu_count FROM ({_LATEST}) GROUP BY model_name")
def models_count_incremental(spark, sf):
    return _device_stream(spark, sf, "models")


@query("SELECT part_id, head, tail FROM log_heads")
def log_heads_stream(spark, sf):
    log, checkpoint = scratch_dir(spark, "messages"), scratch_dir(spark, "checkpoint")
    write_log(views.messages(spark, sf), log)
    feed = spark.readStream.schema(spark.read.parquet(log).schema).option("maxFilesPerTrigger", 4).parquet(log)
    with _state_store(spark):
        start_heads(feed, checkpoint).awaitTermination()
        found = written(kept_heads(spark, checkpoint, views.CAPACITY), "heads")
    return found.select(F.col("partition").cast("int").alias("part_id"), "head", "tail")


@query("SELECT part_id, committed FROM committed")
def log_commits_stream(spark, sf):
    path, checkpoint = scratch_dir(spark, "acks"), scratch_dir(spark, "checkpoint")
    acks = views.acks(views.stored_messages(spark, sf))
    acks.repartition(6).write.parquet(path)
    feed = spark.readStream.schema(acks.schema).option("maxFilesPerTrigger", 2).parquet(path)
    with _state_store(spark):
        start_commits(feed, checkpoint).awaitTermination()
        found = written(kept_commits(spark, checkpoint), "commits")
    return found.select(F.col("partition").alias("part_id"), "committed")


@query("SELECT DISTINCT uuid, metric_name, sample_at FROM telemetry_samples")
def stream_bounded_dedup(spark, sf):
    """Samples in time order, every third one twice, and very late repeats at the end: bounded state drops both."""
    path, out, checkpoint = (scratch_dir(spark, name) for name in ("samples", "deduped", "checkpoint"))
    rows = views.samples(spark, sf).select(*SAMPLE_KEY[:2], F.col("sample_at").cast("timestamp").alias("sample_at"), "id")
    rows = rows.unionByName(rows.where("id % 3 = 0"))
    day = F.to_date("sample_at")
    first, last = rows.agg(F.min(day), F.max(day)).first()
    span = (last - first) / 4
    bounds = [first + span * part for part in range(1, 4)] + [last]
    for place, high in enumerate(bounds):
        part = rows.where((day <= F.lit(high)) & (day > F.lit(bounds[place - 1]) if place else day <= F.lit(high)))
        if place == 3:
            part = part.unionByName(rows.where(day <= F.lit(bounds[0])))
        # A part is a micro-batch of its own, in as many files as it was written by tasks.
        part.write.mode("append").parquet(path)
        feed = spark.readStream.schema(rows.schema).parquet(path)
        with _state_store(spark):
            run = dedup_within(feed, "1 hour").writeStream.format("parquet").option("checkpointLocation", checkpoint)
            run.trigger(availableNow=True).start(out).awaitTermination()
    found = spark.read.schema(rows.schema).parquet(out)
    return found.select(*SAMPLE_KEY[:2], F.col("sample_at").cast("timestamp_ntz").alias("sample_at"))


# Layouts for lookups and joins.

@query(f"SELECT {GPU_COLUMNS} FROM gpus WHERE model_name ILIKE '%l_buil%ing%'")
def gpus_trigram_search(spark, sf):
    devices, path = written(views.gpus(spark, sf), "devices"), scratch_dir(spark, "postings")
    write_postings(posting_lists(devices, "uuid", "model_name"), path)
    return queries.gpu_output(search(devices, spark.read.parquet(path), "uuid", "model_name", "l_buil%ing"))


@query(f"""SELECT {SAMPLE_COLUMNS} FROM telemetry_samples s JOIN gpus g ON s.uuid = g.uuid
           WHERE s.metric_name = 'EVT_VIEW' AND g.model_name ILIKE '%build%'
             AND s.sample_at >= TIMESTAMP '2024-01-05 00:00:00' AND s.sample_at <= TIMESTAMP '2024-01-25 22:00:00'
           ORDER BY s.sample_at, s.id LIMIT 200 OFFSET 10""")
def telemetry_search_bucketed(spark, sf):
    """The search of ``telemetry_search`` over tables that are bucketed by device."""
    paths = [scratch_dir(spark, name) for name in ("samples", "gpus")]
    names = [f"rackpulse_{path.rpartition('-')[2]}" for path in paths]
    facts = save_bucketed(views.samples(spark, sf), names[0], paths[0], 8, ["uuid", "metric_name", "sample_at"])
    devices = save_bucketed(views.gpus(spark, sf), names[1], paths[1], 8)
    wanted = TelemetryFilter.parse(
        metric_name="EVT_VIEW", model_name="build", start_time="2024-01-05T00:00:00Z",
        end_time="2024-01-26T00:00:00+02:00", limit=200, offset=10,
    )
    return queries.search_samples(facts, devices, wanted)
