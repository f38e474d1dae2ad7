import pytest
from helpers import messages, record
from pyspark.sql import Row
from pyspark.sql import functions as F
from rackpulse.operators.merge import latest_state
from rackpulse.operators.progress import committed, heads
from rackpulse.operators.records import check_records, with_times
from rackpulse.plans import stored_checks
from rackpulse.plans.queries import count_models
from rackpulse.schemas import ACK_LOG, GPUS, MESSAGE_LOG
from rackpulse.sources.log_files import message_records
from rackpulse.sources.tables import RECORD_ORDER
from rackpulse.streaming import state
from rackpulse.streaming.ingest import dedup_within
from rackpulse.streaming.state import (
    STATE_CONF,
    device_changes,
    kept_commits,
    kept_devices,
    kept_heads,
    kept_model_counts,
    start_commits,
    start_devices,
    start_heads,
)

MAY = 1_777_636_800_000_000_000


@pytest.fixture
def rocksdb(spark):
    usual = {name: spark.conf.get(name) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in usual.items():
        spark.conf.set(name, value)


def batches():
    """Inserts, moves, late records that change nothing but the first time, ties, a device that moves back."""
    def row(p, o, uuid, ns, model, **more):
        return p, o, record(uuid, MAY + ns, model_name=model, **more)

    return [
        [row(0, 0, "a", 5_000, "X"), row(0, 1, "b", 6_000, "X"), row(1, 0, "a", 9_000, "Y", hostname="h")],
        [row(0, 2, "a", 7_000, "Z"), row(0, 3, "c", 6_000, "Y"), row(1, 1, "b", 6_000, "Z"), *[row(0, 9 + n, "hot", n, "H") for n in range(50)]],
        [row(1, 2, "b", 1_000, "Q"), row(1, 3, "a", 9_000, "X"), row(1, 4, "hot", 60_000, "X")],
        [row(1, 5, "c", 99_000, "X", hostname=None), row(2, 0, None, 1_000, "X"), row(2, 1, "d", 1_000, None)],
    ]


def checked(rows):
    return check_records(with_times(message_records(rows))).devices


def stream_of(spark, path):
    return spark.readStream.schema(MESSAGE_LOG).option("maxFilesPerTrigger", 1).parquet(path)


def finish(run):
    assert run.awaitTermination(240) and run.exception() is None
    return run


def test_device_state_equals_the_batch_result(rocksdb, tmp_path, rows_of):
    spark, path, place, deltas = rocksdb, *(str(tmp_path / name) for name in ("log", "c", "deltas"))
    seen = None
    for number, rows in enumerate(batches()):
        part = messages(spark, rows)
        part.coalesce(1).write.mode("append").parquet(path)
        # Every batch is a run of its own, so the state is taken up again from the checkpoint.
        finish(start_devices(checked(stream_of(spark, path)), place, deltas))
        seen = part if seen is None else seen.unionByName(part)
        want = latest_state(checked(seen), RECORD_ORDER).select(*GPUS.names)
        assert rows_of(kept_devices(spark, place)) == rows_of(want), number
        assert [tuple(row) for row in kept_model_counts(spark, deltas).collect()] == [tuple(row) for row in count_models(want).collect()]


def test_only_changed_devices_are_emitted(rocksdb, tmp_path):
    spark, path, got = rocksdb, str(tmp_path / "log"), []
    for rows in ([(0, n, record(f"g{n}", MAY + n)) for n in range(20)], [(0, 20, record("g3", MAY + 99_000, model_name="N")), (0, 21, record("g4", MAY + 4))]):
        messages(spark, rows).coalesce(1).write.mode("append").parquet(path)
    run = device_changes(checked(stream_of(spark, path))).writeStream.outputMode("update").foreachBatch(
        lambda batch, number: got.append(sorted((r.uuid, r.known, r.old_model, r.model_name) for r in batch.collect()))
    ).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    finish(run)
    assert len(got[0]) == 20 and not any(known for _, known, *_ in got[0])
    # The second record of g4 has another place in the log: its state changes, its model does not.
    assert got[1] == [("g3", True, "Corvid X1 48GB", "N"), ("g4", True, "Corvid X1 48GB", "Corvid X1 48GB")]


def test_records_are_combined_before_the_shuffle(spark):
    rows = checked(messages(spark, batches()[1])).coalesce(1)
    combined = state._seen(rows).mapInPandas(state._combined, state._RECORD)
    hot = [row for row in combined.collect() if row.uuid == "hot"]
    assert len(hot) == 1 and (hot[0].offset, hot[0].first_us, hot[0].last_us) == (58, MAY // 1000, MAY // 1000)


def test_heads_and_commits(rocksdb, tmp_path, rows_of):
    spark, path, place = rocksdb, str(tmp_path / "log"), str(tmp_path / "c")
    for low in (0, 40):
        part = messages(spark, [(n % 3, low + n // 3, record(value=1.0)) for n in range(60)])
        part.write.mode("append").parquet(path)
        finish(start_heads(stream_of(spark, path), place))
        assert rows_of(kept_heads(spark, place, 7)) == rows_of(heads(spark.read.schema(MESSAGE_LOG).parquet(path), 7))
    acks, place = str(tmp_path / "acks"), str(tmp_path / "d")
    spark.createDataFrame([("t", "g", 0, 5), ("t", "g", 0, 3), ("t", "h", 0, 9), ("t", "g", None, 1)], ACK_LOG).write.parquet(acks)
    finish(start_commits(spark.readStream.schema(ACK_LOG).parquet(acks), place))
    assert rows_of(kept_commits(spark, place)) == rows_of(committed(spark.read.schema(ACK_LOG).parquet(acks)))


def test_bounded_dedup_forgets_and_drops(rocksdb, tmp_path, rows_of):
    """Keys older than the delay leave the state; rows older than the watermark are dropped, not let through again."""
    spark, path, out = rocksdb, str(tmp_path / "in"), str(tmp_path / "out")
    schema = "uuid string, metric_name string, sample_at timestamp, value double"
    for hour in range(6):
        times = [f"2026-05-01 {6 + hour:02d}:{minute:02d}:00" for minute in range(0, 60, 5)]
        rows = [(f"g{n % 3}", "m", time, float(hour)) for n, time in enumerate(times)] * 2
        if hour == 5:
            rows += [("g0", "m", "2026-05-01 06:00:00", 99.0)] * 4
        frame = spark.createDataFrame(rows, "uuid string, metric_name string, sample_at string, value double")
        frame.withColumn("sample_at", F.col("sample_at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    run = finish(dedup_within(feed, "1 hour").writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out))
    got = spark.read.parquet(out)
    assert got.count() == got.select("uuid", "sample_at").distinct().count() == 72 and got.where("value = 99").count() == 0
    state_of = [progress["stateOperators"][0] for progress in run.recentProgress if progress["stateOperators"]]
    assert sum(step["numRowsDroppedByWatermark"] for step in state_of) == 4
    assert max(step["numRowsTotal"] for step in state_of) <= 36 < 72


def test_device_state_works_on_rows():
    """One lookup per device and batch, and a row out only where the state changes."""
    class Value:
        held, asked = None, 0

        def get(self):
            self.asked += 1
            return self.held

        def update(self, row):
            self.held = row

    value = Value()
    device = state.DeviceState()
    device.init(type("Handle", (), {"getValueState": lambda self, name, schema: value})())

    def row(model, micros, offset):
        return Row(uuid="a", gpu_index="0", device="d", model_name=model, hostname="h", first_us=micros, last_us=micros,
                   stamp=micros * 1000, topic="t", partition=0, offset=offset)

    (first,) = device.handleInputRows(("a",), iter([row("X", 5, 1), row("Y", 9, 2), row("Z", 1, 3)]), None)
    assert (first.uuid, first.model_name, first.first_us, first.last_us, first.known, first.old_model) == ("a", "Y", 1, 9, False, None)
    (second,) = device.handleInputRows(("a",), iter([row("N", 10, 0)]), None)
    assert (second.model_name, second.known, second.old_model) == ("N", True, "Y")
    assert list(device.handleInputRows(("a",), iter([row("N", 10, 0)]), None)) == [] and value.asked == 3


def test_parts_of_the_bounded_dedup_are_not_written_by_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stored_checks, "scratch_dir", lambda spark, name: str(tmp_path / name))
    found = stored_checks.stream_bounded_dedup(spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert len(list((tmp_path / "samples").glob("*.parquet"))) > 4
