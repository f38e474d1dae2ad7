import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpers import FULL_ROW, csv_line, record, write_csv
from rackpulse.operators.records import check_records, split_rows, with_times
from rackpulse.operators.routing import known_topics, named_members, owned_by, partition_load, route, tag_partition
from rackpulse.plans.ingest import produce
from rackpulse.schemas import TELEMETRY_RECORD
from rackpulse.sources.csv import read_csv, read_numbered_csv, split_by_form, stream_csv, with_row_numbers
from rackpulse.sources.log_files import append_log, message_records, read_log
from rackpulse.sources.replay import replay


def numbered(spark, folder):
    return read_numbered_csv(spark, folder)


def test_full_row_maps_every_field(spark, tmp_path):
    row = split_rows(numbered(spark, write_csv(tmp_path, FULL_ROW))).good.first()
    assert row.asDict() | {"ingested_unix_ns": 0, "sample_unix_ns": 0} == {
        "row_num": 0, "ingested_unix_ns": 0, "sample_unix_ns": 0, "metric_name": "BOARD_WATTS",
        "uuid": "GPU-north-6", "gpu_index": "6", "device": "accel6", "model_name": "Corvid X2 96GB",
        "hostname": "node-k12", "container": "trainer", "pod": "run-88", "namespace": "lab", "value": 317.25,
        "labels_raw": 'firmware="9.4.1",slot="6"',
    }
    assert row.ingested_unix_ns == row.sample_unix_ns > 1_700_000_000_000_000_000


def test_bad_rows_are_set_aside_and_later_rows_still_arrive(spark, tmp_path, rows_of):
    folder = write_csv(
        tmp_path, csv_line("GPU-1", "5", stamp="some day"), csv_line("GPU-2", "warm"),
        "only,three,columns", csv_line("GPU-3", "6", extra=",more"), csv_line("GPU-4", ""), csv_line("GPU-5", "4096"),
    )
    split = split_rows(numbered(spark, folder))
    assert rows_of(split.good, "row_num", "uuid", "value", "container", "pod", "namespace") == [
        (0, "GPU-1", 5.0, "", "", ""), (5, "GPU-5", 4096.0, "", "", "")
    ]
    assert rows_of(split.dead_letter, "row_num", "reason", "raw.uuid") == [
        (1, "value", "GPU-2"), (2, "column_count", None), (3, "column_count", "GPU-3"), (4, "value", "GPU-4")
    ]


def test_missing_file_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_csv(spark, str(tmp_path / "nothing.csv"))


def test_row_numbers_over_many_splits_and_files(spark, tmp_path):
    folder = tmp_path / "many"
    for part in range(3):
        write_csv(folder, *(csv_line(f"GPU-{part * 1000 + i:06d}", str(i)) for i in range(1000)), name=f"{part}.csv")
    key, usual = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "8192")
    try:
        scan = read_csv(spark, str(folder))
        assert scan.rdd.getNumPartitions() > 10
        got = with_row_numbers([scan]).select("row_num", "uuid").orderBy("row_num").collect()
        assert got == numbered(spark, str(folder)).select("row_num", "uuid").orderBy("row_num").collect()
    finally:
        spark.conf.set(key, usual)
    assert [tuple(r) for r in got] == [(i, f"GPU-{i:06d}") for i in range(3000)]


def test_every_row_has_one_owner(spark):
    rows = spark.range(1000).withColumnRenamed("id", "row_num")
    owned = [owned_by(rows, index, 5).withColumn("owner", F.lit(index)) for index in range(5)]
    both = owned[0]
    for part in owned[1:]:
        both = both.unionByName(part)
    assert both.groupBy("row_num").count().where("count <> 1").count() == 0 and both.count() == 1000
    assert both.where(F.col("row_num") % 5 != F.col("owner")).count() == 0


def test_partition_is_the_owner_index(spark):
    tagged = tag_partition(spark.range(1000).withColumnRenamed("id", "row_num"), 10)
    assert tagged.where(F.col("partition") != F.col("row_num") % 10).count() == 0


def test_explicit_routing_and_refusal(spark, rows_of):
    rows = spark.createDataFrame([("t", i, p) for i, p in enumerate([0, 1, 2, 3, 99, 4])],
                                 "topic string, seq bigint, partition int")
    split = route(rows, 4, "seq")
    assert rows_of(split.good, "seq", "partition") == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert rows_of(split.dead_letter, "seq", "reason") == [(4, "partition_unknown"), (5, "partition_unknown")]


def test_round_robin_is_even_and_counts_only_its_own_rows(spark, rows_of):
    rows = spark.createDataFrame([("t", i, -1 if i % 2 else 0) for i in range(18)],
                                 "topic string, seq bigint, partition int")
    spread = route(rows.where("partition < 0"), 3, "seq").good
    assert rows_of(partition_load(spread)) == [(0, 3), (1, 3), (2, 3)]
    mixed = route(rows, 3, "seq").good.where("seq % 2 = 1")
    assert rows_of(mixed, "seq", "partition") == sorted(((2 * n + 1, n % 3) for n in range(9)), key=repr)


def test_topic_and_member_names(spark, rows_of):
    rows = spark.createDataFrame([(1, "t"), (2, ""), (3, None), (4, "other")], "n int, topic string")
    split = known_topics(rows, spark.createDataFrame([("t",)], "topic string"))
    assert rows_of(split.good, "n") == [(1,)]
    assert rows_of(split.dead_letter, "n", "reason") == [(2, "topic_missing"), (3, "topic_missing"), (4, "topic_unknown")]
    members = spark.createDataFrame([("a",), ("",), (None,)], "consumer_id string")
    assert named_members(members).good.count() == 1 and named_members(members).dead_letter.count() == 2


def test_replay_repeats_all_rows_with_new_stamps(spark, tmp_path):
    folder = write_csv(tmp_path, csv_line("GPU-one"), csv_line("GPU-one", "2"), csv_line("GPU-two"))
    fed = replay(numbered(spark, folder), 2, 3, interval_ms=100, start_us=5)
    got = fed.orderBy("stamp_ns").select("uuid", "pass", "row_num", "stamp_ns").collect()
    assert [r.uuid for r in got] == ["GPU-one", "GPU-one", "GPU-two"] * 2
    assert [(r["pass"], r.row_num) for r in got] == [(p, n) for p in range(2) for n in range(3)]
    assert [r.stamp_ns for r in got] == [5000 + n * 100_000_000 for n in range(6)]
    assert replay(numbered(spark, folder), 2, 3, interval_ms=0).select("stamp_ns").distinct().count() == 6


def test_column_rules(spark, rows_of):
    rows = [
        record("GPU-1"), record("G" * 65), record("GPU-2", metric="m" * 65), record("GPU-3", model_name=None),
        record("GPU-4", pod="p" * 128 + "  "), record("GPU-5", value=None),
    ]
    df = spark.createDataFrame([tuple(r[n] for n in TELEMETRY_RECORD.names) for r in rows], TELEMETRY_RECORD)
    checked = check_records(with_times(df))
    assert rows_of(checked.devices, "uuid") == [("GPU-1",), ("GPU-2",), ("GPU-4",), ("GPU-5",)]
    assert rows_of(checked.samples, "uuid", F.length("pod")) == [("GPU-1", 0), ("GPU-4", 128)]
    assert rows_of(checked.dead_letter, F.substring("uuid", 1, 5), "reason") == [
        ("GGGGG", "uuid"), ("GPU-2", "metric_name"), ("GPU-3", "model_name"), ("GPU-5", "value")
    ]


def test_csv_to_log_continues_offsets(spark, tmp_path, rows_of):
    folder = write_csv(tmp_path / "csv", *(csv_line(f"GPU-{i}", "bad" if i == 4 else str(i)) for i in range(12)))
    log = str(tmp_path / "log")
    for _ in range(2):
        made = produce(numbered(spark, folder), "telemetry", producers=4, partitions=3)
        append_log(made.records, log, "row_num")
    assert rows_of(made.dead_letter, "row_num", "reason") == sorted(
        [(4, "value"), (3, "partition_unknown"), (7, "partition_unknown"), (11, "partition_unknown")], key=repr)
    got = rows_of(message_records(read_log(spark, log)), "partition", "offset", "uuid")
    assert got == [
        (0, 0, "GPU-0"), (0, 1, "GPU-8"), (0, 2, "GPU-0"), (0, 3, "GPU-8"),
        (1, 0, "GPU-1"), (1, 1, "GPU-5"), (1, 2, "GPU-9"), (1, 3, "GPU-1"), (1, 4, "GPU-5"), (1, 5, "GPU-9"),
        (2, 0, "GPU-2"), (2, 1, "GPU-6"), (2, 2, "GPU-10"), (2, 3, "GPU-2"), (2, 4, "GPU-6"), (2, 5, "GPU-10"),
    ]


def test_csv_stream_reads_the_same_rows(spark, tmp_path, rows_of):
    folder = write_csv(tmp_path / "in", FULL_ROW, csv_line("GPU-1", "x"))
    out = str(tmp_path / "out")
    run = (stream_csv(spark, folder).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
           .trigger(availableNow=True).start(out))
    assert run.awaitTermination(120)
    assert rows_of(spark.read.parquet(out).drop("_file")) == rows_of(read_csv(spark, folder))


def test_quoted_line_breaks_and_odd_lines(spark, tmp_path, rows_of):
    long = csv_line("GPU-1")[:-1] + '"first\n\nthird, ""x"""'
    folder = write_csv(tmp_path / "in", csv_line("GPU-0"), long, "   ", csv_line("GPU-2"), "", csv_line("GPU-3"), name="a.csv")
    write_csv(tmp_path / "in", csv_line("GPU-4"), csv_line("GPU-5")[:-1] + '"never closed', csv_line("GPU-6"), name="b c.csv")
    write_csv(tmp_path / "in", csv_line("GPU-7"), name="c.csv")
    forms = split_by_form(spark, folder)
    assert [len(held) for held in forms] == [1, 2, 1]
    assert read_csv(spark, folder).count() == 8
    rows = numbered(spark, folder)
    split = split_rows(rows)
    assert rows_of(split.good, "row_num", "uuid", "labels_raw") == sorted([
        (0, "GPU-0", "x"), (1, "GPU-1", 'first\n\nthird, "x"'), (3, "GPU-2", "x"), (4, "GPU-3", "x"), (5, "GPU-4", "x"),
        (7, "GPU-7", "x")], key=repr)
    assert rows_of(split.dead_letter, "row_num") == [(2,), (6,)]


def test_replay_without_passes(spark, tmp_path):
    folder = write_csv(tmp_path, csv_line(), csv_line())
    assert replay(numbered(spark, folder), 0, 2).count() == 0
