import time

import pytest
from helpers import record
from pyspark.sql import functions as F
from rackpulse.operators.progress import committed, heads, resume
from rackpulse.schemas import ACK_LOG, MESSAGE_LOG, TELEMETRY_RECORD
from rackpulse.sources import subscribe as source
from rackpulse.sources.log_files import append_log, read_log
from rackpulse.sources.subscribe import Held, LogReader, subscribe
from rackpulse.sources.tables import Tables
from rackpulse.streaming.ingest import start_ingest

MAY = 1_777_636_800_000_000_000


def append(spark, path, numbers, topic="t", parts=3):
    """Messages whose value is their number, in partition ``number % parts``."""
    rows = [(n, topic, n % parts, *record(f"GPU-{n % 4}", MAY + n * 1000, value=float(n)).values()) for n in numbers]
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TELEMETRY_RECORD)
    ordered = [(*row[:3], *(dict(zip(record().keys(), row[3:]))[name] for name in TELEMETRY_RECORD.names)) for row in rows]
    append_log(spark.createDataFrame(ordered, f"seq bigint, topic string, partition int, {names}"), path, "seq")


def commits_of(spark, rows):
    return committed(spark.createDataFrame(rows, ACK_LOG))


def drain(stream, tmp_path, place="c", **writer):
    run = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / place)).trigger(
        availableNow=True).start(str(tmp_path / "out"))
    assert run.awaitTermination(180) and run.exception() is None


def test_starts_behind_the_commit_and_goes_on(spark, tmp_path, rows_of):
    log = str(tmp_path / "log")
    append(spark, log, range(30))
    append(spark, log, range(30, 36), topic="other")
    commits = commits_of(spark, [("t", "g", 0, 6), ("t", "g", 0, 2), ("t", "g", 1, 9), ("t", "h", 2, 5), ("other", "g", 2, 8)])
    want = resume(read_log(spark, log), commits, "t", "g")
    drain(subscribe(spark, log, "t", commits, "g"), tmp_path)
    got = spark.read.parquet(str(tmp_path / "out"))
    names = ["topic", "partition", "offset", "payload.value", "timestamp_ns"]
    assert rows_of(got, *names) == rows_of(want, *names) and got.count() == 3 + 0 + 10
    # From here on the checkpoint counts, not the commits, and a new partition begins at its first offset.
    append(spark, log, range(36, 48), parts=4)
    drain(subscribe(spark, log, "t", commits_of(spark, []), "g"), tmp_path)
    more = resume(read_log(spark, log), commits, "t", "g")
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), *names) == rows_of(more, *names)


def test_starts_at_the_tail_where_it_fell_behind(spark, tmp_path, rows_of):
    log = str(tmp_path / "log")
    append(spark, log, range(30))
    commits = commits_of(spark, [("t", "g", 0, 8), ("t", "g", 1, 2)])
    drain(subscribe(spark, log, "t", commits, "g", heads(read_log(spark, log), 4)), tmp_path)
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "partition", "offset") == sorted(
        [(0, 9)] + [(p, o) for p in (1, 2) for o in range(6, 10)], key=repr)


def test_slices_split_a_long_range(spark, tmp_path, monkeypatch, rows_of):
    monkeypatch.setattr(source, "SLICE", 4)
    log = str(tmp_path / "log")
    append(spark, log, range(30), parts=2)
    reader = LogReader({"path": log, "topic": "t", "start": '{"0": 5}'}, source.MESSAGE_LOG)
    assert reader.initialOffset() == {"0": 5, "1": 0} and reader.latestOffset() == {"0": 15, "1": 15}
    slices = reader.partitions({"0": 5, "1": 0}, {"0": 15, "1": 15})
    assert sorted((s.partition, s.low, s.high) for s in slices) == [
        (0, 5, 9), (0, 9, 13), (0, 13, 15), (1, 0, 4), (1, 4, 8), (1, 8, 12), (1, 12, 15)]
    assert sorted(o for s in slices for b in reader.read(s) for o in b.column("offset").to_pylist() if s.partition == 0) == list(range(5, 15))


@pytest.mark.parametrize(("files", "heads", "head"), [
    ([(0, 9), (10, 19)], {10, 20}, 20),
    # The first file of an append is not there yet: nothing behind it is read.
    ([(0, 9), (15, 19)], {10, 20}, 10),
    # An append died after it had announced 20; the next one began there.
    ([(0, 9), (20, 29)], {10, 20, 30}, 30),
    ([(0, 9), (12, 14), (20, 29)], {10, 20, 30}, 30),
    ([], {10}, 0),
    ([(5, 9)], set(), 0),
])
def test_head_never_passes_messages_that_may_still_come(files, heads, head):
    held = Held(0, {str(place): span for place, span in enumerate(files)})
    held.advance(heads)
    assert held.head == head


def test_waiting_ingest_takes_what_is_appended(spark, tmp_path, rows_of):
    """A running query with a processing-time trigger, and acks that a later group start goes on from."""
    log, tables = str(tmp_path / "log"), Tables(spark, str(tmp_path / "tables"))
    append(spark, log, range(6))
    none = commits_of(spark, [])
    run = start_ingest(subscribe(spark, log, "t", none, "collector"), tables, str(tmp_path / "c"), partitions=3, every="1 second")
    try:
        for upto, more in ((6, range(6, 10)), (10, None)):
            late = time.monotonic() + 120
            while tables.samples().count() < upto:
                assert time.monotonic() < late and run.exception() is None and run.isActive
                time.sleep(0.5)
            if more:
                append(spark, log, more)
        while run.status["isTriggerActive"]:
            time.sleep(0.2)
    finally:
        run.stop()
    assert rows_of(tables.samples(), "value") == sorted([(float(n),) for n in range(10)], key=repr)
    append(spark, log, range(10, 12))
    commits = committed(tables.acks())
    drain(subscribe(spark, log, "t", commits, "collector"), tmp_path, "other")
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), F.col("payload.value")) == [(10.0,), (11.0,)]


def test_a_slice_may_begin_inside_a_file_of_several_batches(spark, tmp_path):
    """A batch without rows of the slice has the same schema as the others, or is not passed on."""
    log = str(tmp_path / "log")
    rows = spark.range(70_000).select(
        F.col("id").alias("seq"), F.lit("t").alias("topic"), F.lit(0).alias("partition"),
        *(F.lit(value).cast(TELEMETRY_RECORD[name].dataType).alias(name) for name, value in record().items()),
    )
    append_log(rows, log, "seq")
    reader = LogReader({"path": log, "topic": "t"}, MESSAGE_LOG)
    reader.latestOffset()
    (whole,) = reader.partitions({"0": 66_000}, {"0": 70_000})
    assert (whole.low, whole.high) == (66_000, 70_000)
    assert sum(len(batch) for batch in reader.read(whole)) == 4000
    drain(subscribe(spark, log, "t", commits_of(spark, [("t", "g", 0, 65_999)]), "g"), tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.min("offset"), F.count("*")).first() == (66_000, 4000)
