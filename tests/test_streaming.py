from pyspark.sql import functions as F

from helpers import csv_line, record, write_csv
from rackpulse.plans.ingest import apply_batch
from rackpulse.schemas import TELEMETRY_RECORD
from rackpulse.sources.csv import stream_csv
from rackpulse.sources.log_files import append_log, message_records, read_log, stream_log
from rackpulse.sources.replay import replay_stream
from rackpulse.sources.tables import Tables
from rackpulse.streaming.ingest import dedup_within, start_ingest, start_produce

MAY = 1_777_636_800_000_000_000


def append(spark, path, rows):
    records = spark.createDataFrame(
        [(n, "t", n % 3, *(rec[name] for name in TELEMETRY_RECORD.names)) for n, rec in enumerate(rows)],
        "seq bigint, topic string, partition int, " + ", ".join(
            f"{f.name} {f.dataType.simpleString()}" for f in TELEMETRY_RECORD))
    append_log(records, path, "seq")


def test_ingest_drains_resumes_and_repeats(spark, tmp_path, rows_of):
    log, tables = str(tmp_path / "log"), Tables(spark, str(tmp_path / "tables"))

    def drain(checkpoint):
        run = start_ingest(stream_log(spark, log, max_files=2), tables, str(tmp_path / checkpoint), partitions=3)
        assert run.awaitTermination(300)
        assert run.exception() is None

    append(spark, log, [record(f"GPU-{n % 4}", MAY + n * 1000, value=float(n)) for n in range(12)])
    drain("c1")
    assert rows_of(tables.samples(), "value") == sorted([(float(n),) for n in range(12)], key=repr)
    append(spark, log, [record("GPU-0", MAY, value=77.0), record("GPU-9", MAY + 5000, hostname="late")])
    drain("c1")
    once = rows_of(tables.samples())
    assert len(once) == 13 and 77.0 not in [r[5] for r in once]
    # A lost checkpoint delivers everything again and changes nothing.
    devices = rows_of(tables.devices())
    drain("c2")
    assert rows_of(tables.samples()) == once
    assert rows_of(tables.devices()) == devices and len(devices) == 5


def test_replay_stream_goes_on_where_it_stopped(spark, tmp_path, rows_of):
    path, out, place = (str(tmp_path / name) for name in ("rows", "out", "c"))
    spark.createDataFrame([(n, f"GPU-{n}") for n in range(5)], "row_num bigint, uuid string").write.parquet(path)
    rows = spark.read.parquet(path)
    for _ in range(3):
        feed = replay_stream(spark, rows, 5, 4, interval_ms=100)
        run = feed.writeStream.format("parquet").option("checkpointLocation", place).trigger(availableNow=True).start(out)
        assert run.awaitTermination(120)
    got = rows_of(spark.read.parquet(out).orderBy("stamp_ns"), "stamp_ns", "pass", "row_num", "uuid")
    assert sorted(got) == [(n * 100_000_000, n // 5, n % 5, f"GPU-{n % 5}") for n in range(12)]


def test_bounded_dedup(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("u", "m", "2026-05-01 12:00:00", 1.0)] * 3 + [("u", "m", "2026-05-01 12:00:01", 2.0)],
                                 "uuid string, metric_name string, s string, value double")
    rows = rows.select("uuid", "metric_name", F.col("s").cast("timestamp").alias("sample_at"), "value")
    rows.write.parquet(path)
    stream = dedup_within(spark.readStream.schema(rows.schema).parquet(path), "1 hour")
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(
        availableNow=True).start(out)
    assert run.awaitTermination(180)
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == [1.0, 2.0]


def test_rows_appended_again_carry_the_same_stamps(spark, tmp_path, rows_of):
    log, folder = str(tmp_path / "log"), tmp_path / "csv"
    write_csv(folder, csv_line("GPU-a", "1"), csv_line("GPU-a", "2"), csv_line("GPU-b", "3"))
    for checkpoint in ("c1", "c2"):  # the second run stands for a repeat whose note was lost
        feed = stream_csv(spark, str(folder), with_times=True)
        assert start_produce(feed, log, str(tmp_path / checkpoint), "t", 1, 1).awaitTermination(300)
    rows = message_records(read_log(spark, log))
    assert rows.count() == 6 and rows.select("uuid", "metric_name", "sample_unix_ns").distinct().count() == 3
    tables = Tables(spark, str(tmp_path / "tables"))
    apply_batch(tables, read_log(spark, log), "g", partitions=1)
    assert rows_of(tables.samples(), "value") == [(1.0,), (2.0,), (3.0,)]
