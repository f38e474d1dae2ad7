from datetime import datetime

from pyspark.sql import functions as F

from helpers import messages, plan_of, record
from rackpulse.operators import merge
from rackpulse.plans.ingest import apply_batch
from rackpulse.schemas import GPUS
from rackpulse.sources.tables import Tables

DAY = 86_400_000_000_000
MAY = 1_777_636_800_000_000_000  # 2026-05-01 12:00:00 UTC


def tables_in(spark, tmp_path):
    return Tables(spark, str(tmp_path / "tables"))


def test_first_delivery_wins(spark, rows_of):
    rows = spark.createDataFrame([("u", "m", 1, 5, 0.5), ("u", "m", 1, 3, 0.3), ("u", "m", 2, 9, 0.9)],
                                 "uuid string, metric_name string, sample_at int, seq int, value double")
    assert rows_of(merge.first_wins(rows, ["seq"]), "sample_at", "seq", "value") == [(1, 3, 0.3), (2, 9, 0.9)]


def test_many_copies_of_one_key_are_reduced_before_the_shuffle(spark):
    rows = spark.range(1000).select(
        F.lit("u").alias("uuid"), (F.col("id") % 3).alias("metric_name"), F.lit(1).alias("sample_at"), "id"
    )
    plan = plan_of(merge.first_wins(rows, ["id"]))
    assert plan.index("Exchange") < plan.index("Partial")


def test_insert_if_absent(spark, rows_of):
    keys = "uuid string, metric_name string, sample_at int"
    new = spark.createDataFrame([("a", "m", 1), ("a", "m", 2), ("b", "m", 1)], keys)
    old = spark.createDataFrame([("a", "m", 2), ("c", "m", 9)], keys)
    assert rows_of(merge.insert_if_absent(new, old)) == [("a", "m", 1), ("b", "m", 1)]


def test_latest_state_breaks_ties_by_log_place(spark):
    rows = spark.createDataFrame(
        [("u", "0", "d", "m", "old", 5, 1, 7), ("u", "0", "d", "m", "new", 5, 1, 8), ("u", "0", "d", "m", "first", 4, 3, 99)],
        "uuid string, gpu_index string, device string, model_name string, hostname string, ns bigint, part int, off bigint")
    row = merge.latest_state(rows.withColumn("ingested_at", F.col("ns")), ["ns", "part", "off"]).first()
    assert (row.hostname, row.created_at, row.updated_at) == ("new", 4, 5)


def test_merge_keeps_created_at_and_overwrites_with_null(spark, rows_of):
    one, two, three = (datetime(2026, 5, d) for d in (1, 2, 3))
    old = spark.createDataFrame([("a", "0", "d", "m", "h", one, one), ("b", "0", "d", "m", "h", one, one)], GPUS)
    new = spark.createDataFrame([("a", "1", None, "m2", None, two, three), ("c", "2", "d", "m", "h", two, two)], GPUS)
    assert rows_of(merge.merge_devices(old, new)) == [
        ("a", "1", None, "m2", None, one, three), ("b", "0", "d", "m", "h", one, one), ("c", "2", "d", "m", "h", two, two)
    ]


def test_references(spark, rows_of):
    samples = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, uuid string")
    devices = spark.createDataFrame([("a",), ("c",)], "uuid string")
    assert rows_of(merge.with_device(samples, devices), "id") == [(1,), (3,)]
    assert rows_of(merge.without_device(samples, devices), "id") == [(2,)]


def test_batch_writes_device_then_sample(spark, tmp_path, rows_of):
    tables = tables_in(spark, tmp_path)
    apply_batch(tables, messages(spark, [(2, 5, record("GPU-1", MAY, value=3.5, sample_unix_ns=MAY + 1_000_000_000))]), "g", 0)
    sample, device = tables.samples().first(), tables.devices().first()
    assert (sample.sample_at - sample.ingested_at).total_seconds() == 1
    assert sample.ingested_at == datetime(2026, 5, 1, 12) and sample.id == 52 and sample.value == 3.5
    assert (device.uuid, device.created_at) == ("GPU-1", datetime(2026, 5, 1, 12))
    assert rows_of(tables.acks()) == [("telemetry", "g", 2, 5)]


def test_bad_messages_touch_nothing_and_are_passed_over(spark, tmp_path, rows_of):
    tables = tables_in(spark, tmp_path)
    apply_batch(tables, messages(spark, [
        (0, 0, None), (0, 1, record("G" * 65, MAY)), (0, 2, record("GPU-2", MAY, metric="m" * 65)),
        (0, 3, record("GPU-3", MAY)),
    ]), "g", 0)
    assert rows_of(tables.devices(), "uuid") == [("GPU-2",), ("GPU-3",)]
    assert rows_of(tables.samples(), "uuid") == [("GPU-3",)]
    assert rows_of(tables.dead_letters(), "offset", "reason") == [(0, "payload"), (1, "uuid"), (2, "metric_name")]
    assert rows_of(tables.acks(), "offset") == [(3,)]


def test_repeated_and_late_batches(spark, tmp_path, rows_of):
    tables = tables_in(spark, tmp_path)
    first = messages(spark, [(0, n, record("GPU-1", MAY + n * DAY, value=float(n))) for n in range(3)])
    for _ in range(2):
        apply_batch(tables, first, "g", 0)
    again = [(0, 3, record("GPU-1", MAY + DAY, value=99.0)), (0, 4, record("GPU-1", MAY - DAY, value=-1.0)),
             (0, 5, record("GPU-1", MAY + 500, value=98.0)), (0, 6, record("GPU-1", MAY + 2000, value=7.0))]
    apply_batch(tables, messages(spark, again), "g", 1)
    # 500 ns later is the same microsecond, 2000 ns later is not.
    assert rows_of(tables.samples(), "value") == sorted([(0.0,), (1.0,), (2.0,), (-1.0,), (7.0,)], key=repr)
    assert tables.samples().select("id").distinct().count() == 5


def test_a_batch_of_many_days_finds_its_duplicates(spark, tmp_path):
    tables = tables_in(spark, tmp_path)
    batch = messages(spark, [(0, n, record("GPU-1", MAY + n * DAY)) for n in range(70)])
    apply_batch(tables, batch, "g", 0)
    apply_batch(tables, batch, "g", 1)
    assert tables.samples().count() == 70


def test_compaction_changes_no_device(spark, tmp_path, rows_of):
    tables = tables_in(spark, tmp_path)
    for batch, host in enumerate(["h0", "h1", "h2"]):
        rows = [(0, batch, record("GPU-1", MAY + batch * DAY, hostname=host)),
                (1, batch, record(f"GPU-new-{batch}", MAY, hostname=host))]
        apply_batch(tables, messages(spark, rows), "g", batch)
        before = rows_of(tables.devices())
        if batch:
            tables.compact_devices()
        assert rows_of(tables.devices()) == before
    apply_batch(tables, messages(spark, [(0, 9, record("GPU-1", MAY - DAY, hostname="older"))]), "other", 0)
    one = tables.devices().where("uuid = 'GPU-1'").first()
    assert one.hostname == "h2" and one.created_at == datetime(2026, 4, 30, 12) and one.updated_at == datetime(2026, 5, 3, 12)
    assert tables.devices().count() == 4


def test_time_range_prunes_date_folders(spark, tmp_path):
    from rackpulse.plans.queries import gpu_samples

    tables = tables_in(spark, tmp_path)
    apply_batch(tables, messages(spark, [(0, n, record("GPU-1", MAY + n * DAY)) for n in range(5)]), "g", 0)
    found = gpu_samples(tables.samples(), "GPU-1", start=datetime(2026, 5, 2, 12), end=datetime(2026, 5, 3, 12))
    assert [r.id for r in found.collect()] == [10, 20]
    plan = plan_of(found)
    assert "sample_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(sample_at" in plan and "EqualTo(uuid" in plan


def test_empty_tables_read_as_no_rows(spark, tmp_path):
    tables = tables_in(spark, tmp_path)
    assert tables.devices().count() == tables.samples().count() == tables.acks().count() == 0
    counts = {r.table_name: r.row_count for r in merge.table_counts(tables.devices(), tables.samples()).collect()}
    assert counts == {"gpus": 0, "telemetry_samples": 0}


def test_batches_of_two_checkpoints_keep_each_other(spark, tmp_path, rows_of):
    tables = tables_in(spark, tmp_path)
    apply_batch(tables, messages(spark, [(0, 0, record("GPU-1", MAY)), (0, 1, None)]), "g", 1)
    tables.compact_devices()
    # A new checkpoint numbers its batches from 0 again.
    apply_batch(tables, messages(spark, [(1, 0, record("GPU-2", MAY)), (1, 1, None)]), "g", 0)
    apply_batch(tables, messages(spark, [(2, 0, record("GPU-3", MAY))]), "g", 0)
    assert rows_of(tables.devices(), "uuid") == [("GPU-1",), ("GPU-2",), ("GPU-3",)]
    assert rows_of(tables.acks(), "partition") == [(0,), (1,), (2,)]
    assert rows_of(tables.dead_letters(), "partition", "offset") == [(0, 1), (1, 1)]
    tables.compact_devices()
    assert rows_of(tables.devices(), "uuid") == [("GPU-1",), ("GPU-2",), ("GPU-3",)]


def test_compacted_batches_are_not_read(spark, tmp_path):
    tables = tables_in(spark, tmp_path)
    apply_batch(tables, messages(spark, [(0, 0, record("GPU-1", MAY))]), "g", 0)
    tables.compact_devices()
    apply_batch(tables, messages(spark, [(0, 1, record("GPU-2", MAY))]), "g", 1)
    filters = [part.split("]")[0] for part in plan_of(tables.device_states()).split("PartitionFilters: [")[1:]]
    assert any("batch" in held for held in filters)
    states = tables.device_states()
    read = [row[0] for row in states.select(F.input_file_name()).distinct().collect()]
    assert sum("gpus/changes" in name for name in read) == 1 and states.count() == 2


def test_two_topics_have_ids_of_their_own(spark, tmp_path, rows_of):
    tables = tables_in(spark, tmp_path)
    for topic in ("b", "a", "b"):
        rows = [(p, o, record(f"GPU-{topic}", MAY + (10 * o + p) * 1000)) for o in range(4) for p in range(2)]
        apply_batch(tables, messages(spark, rows, topic), "g", 0)
    assert tables.samples().count() == tables.samples().select("id").distinct().count() == 16


def test_messages_without_a_place_are_set_aside(spark, tmp_path, rows_of):
    tables = tables_in(spark, tmp_path)
    rows = messages(spark, [(0, 0, record("GPU-1", MAY)), (10, 0, record("GPU-2", MAY)), (None, 1, record("GPU-3", MAY))])
    apply_batch(tables, rows.unionByName(messages(spark, [(0, 5, record("GPU-4", MAY))], None)), "g", 0)
    assert rows_of(tables.samples(), "uuid") == [("GPU-1",)]
    assert rows_of(tables.dead_letters(), "payload.uuid", "reason") == [("GPU-2", "place"), ("GPU-3", "place"), ("GPU-4", "place")]


def test_dead_letters_of_empty_tables(spark, tmp_path):
    assert tables_in(spark, tmp_path).dead_letters().count() == 0
