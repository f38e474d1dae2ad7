from pyspark.sql import functions as F

from helpers import messages, plan_of, record
from rackpulse.operators import progress
from rackpulse.operators.numbering import number_rows
from rackpulse.operators.routing import route
from rackpulse.schemas import TELEMETRY_RECORD
from rackpulse.sources.log_files import read_log, to_messages


def log_of(spark, *offsets, topic="t"):
    return spark.createDataFrame([(topic, p, o) for p, o in offsets], "topic string, partition int, offset bigint")


def acks_of(spark, *acks):
    return spark.createDataFrame([("t", g, p, o) for g, p, o in acks],
                                 "topic string, consumer_group string, partition int, offset bigint")


def test_offsets_are_dense_in_arrival_order(spark, rows_of):
    rows = spark.createDataFrame([("t", 0, n) for n in (30, 10, 20)] + [("t", 1, 15)],
                                 "topic string, partition int, seq bigint")
    assert rows_of(progress.assign_offsets(rows, "seq"), "partition", "seq", "offset") == [
        (0, 10, 0), (0, 20, 1), (0, 30, 2), (1, 15, 0)
    ]


def test_offsets_continue_after_heads(spark, rows_of):
    rows = spark.createDataFrame([("t", 0, 1), ("t", 0, 2), ("t", 1, 3)], "topic string, partition int, seq bigint")
    heads = progress.heads(log_of(spark, (0, 0), (0, 6)))
    assert rows_of(progress.assign_offsets(rows, "seq", heads), "seq", "offset") == [(1, 7), (2, 8), (3, 0)]


def test_numbering_does_not_depend_on_the_tasks(spark):
    rows = spark.range(-500, 1500).select((F.col("id") * 7).alias("seq"), F.pmod("id", F.lit(3)).alias("k"))
    want = None
    for tasks in (1, 10):
        got = {(r.k, r.seq): r.n for r in number_rows(rows.repartition(tasks), ["k"], "seq", "n").collect()}
        assert want in (None, got)
        want = got
    for key in range(3):
        mine = sorted((seq, n) for (k, seq), n in want.items() if k == key)
        assert [n for _, n in mine] == list(range(len(mine)))


def test_a_hot_group_is_spread_over_tasks(spark):
    rows = spark.range(100_000).select("id", F.lit(0).alias("k"))
    numbered = number_rows(rows, ["k"], "id", "n")
    assert numbered.where("n <> id").count() == 0
    assert "Window" not in plan_of(numbered)


def test_heads_tails_and_reading(spark, rows_of):
    log = log_of(spark, *((0, o) for o in range(6)))
    heads = progress.heads(log, 4)
    assert rows_of(heads) == [("t", 0, 6, 2)]
    assert rows_of(progress.retained(log, heads), "offset") == [(2,), (3,), (4,), (5,)]
    asked = log_of(spark, (0, 0), (0, 1), (0, 2), (0, 5), (0, 6), (0, 99), (1, 0))
    assert rows_of(progress.offset_class(asked, heads), "partition", "offset", "read_class") == sorted([
        (0, 0, "too_old"), (0, 1, "too_old"), (0, 2, "ok"), (0, 5, "ok"), (0, 6, "future"), (0, 99, "future"),
        (1, 0, "future"),
    ], key=repr)


def test_next_offset(spark, tmp_path):
    assert progress.next_offset(log_of(spark, (0, 0), (0, 1), (0, 2))).first()[0] == 3
    assert progress.next_offset(read_log(spark, str(tmp_path / "none"))).first()[0] == 0


def test_commits_only_grow(spark, rows_of):
    acks = acks_of(spark, ("g", 0, 5), ("g", 0, 3), ("g", 0, 5))
    log = log_of(spark, *((0, o) for o in range(13)))
    assert rows_of(progress.committed(acks), "committed") == [(5,)]
    later = acks.unionByName(acks_of(spark, ("g", 0, 10)))
    for got, first in ((acks, 6), (later, 11)):
        left = progress.resume(log, progress.committed(got), "t", "g")
        assert left.agg(F.min("offset")).first()[0] == first
    assert progress.resume(log, progress.committed(acks), "t", "other").count() == 13


def test_committed_map(spark):
    commits = progress.committed(acks_of(spark, ("g", 0, 17), ("g", 2, 5)))
    asked = spark.createDataFrame([("t", "g"), ("t", "nobody")], "topic string, consumer_group string")
    got = {r.consumer_group: r.offsets for r in progress.committed_map(commits, asked).collect()}
    assert got == {"g": {0: 17, 2: 5}, "nobody": {}}


def test_falling_behind(spark, rows_of):
    log = log_of(spark, *((0, o) for o in range(10)), *((1, o) for o in range(3)))
    commits = progress.committed(acks_of(spark, ("g", 0, 1)))
    starts = progress.starts(commits, progress.heads(log, 4), "t", "g")
    assert rows_of(starts, "partition", "resume", "start", "lost") == [(0, 2, 6, 4), (1, 0, 0, 0)]
    polled = progress.fair_poll(log, starts)
    # Partition 0 spends round 0 on its jump.
    assert [tuple(r) for r in polled.orderBy("poll_round", "partition").select("poll_round", "partition", "offset").collect()] == [
        (0, 1, 0), (1, 0, 6), (1, 1, 1), (2, 0, 7), (2, 1, 2), (3, 0, 8), (4, 0, 9)
    ]


def test_failed_messages(spark, rows_of):
    failed = acks_of(spark, ("g", 0, 2), ("g", 0, 9), ("g", 1, 0))
    commits = progress.committed(acks_of(spark, ("g", 0, 4)))
    assert rows_of(progress.skipped_forever(failed, commits), "partition", "offset") == [(0, 2)]
    assert rows_of(progress.will_retry(failed, commits), "partition", "offset") == [(0, 9), (1, 0)]


def test_envelope(spark):
    log = messages(spark, [(0, 0, record())])
    again = to_messages(log.select("topic", "partition", "offset", "payload.*"), F.lit(7))
    row = again.first()
    assert (row.topic, row.partition, row.offset, row.headers, row.timestamp_ns) == ("telemetry", 0, 0, {}, 7)
    assert row.payload.uuid == "GPU-one"


def test_written_sides_are_broadcast_by_their_size(spark):
    from rackpulse.operators.sizes import written

    big = spark.range(1_000_000).withColumnRenamed("id", "k")
    side = spark.range(100_000).groupBy((F.col("id") % 9).alias("k")).count()
    assert "BroadcastHashJoin" in plan_of(big.join(written(side), "k"))
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "SortMergeJoin" in plan_of(big.join(written(side), "k"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_no_row_is_lost_in_numbering(spark, rows_of):
    rows = spark.createDataFrame(
        [("a", 5), ("a", None), (None, 7), (None, None), ("a", -(1 << 60)), ("b", 1 << 60)], "k string, at bigint")
    assert rows_of(number_rows(rows, ["k"], "at", "n")) == sorted([
        ("a", None, 0), ("a", -(1 << 60), 1), ("a", 5, 2), (None, None, 0), (None, 7, 1), ("b", 1 << 60, 0)], key=repr)
    assert number_rows(rows.limit(0), ["k"], "at", "n").count() == 0


def test_routing_accounts_for_every_row(spark, rows_of):
    rows = spark.createDataFrame(
        [("t", -1, 3), (None, -1, 4), ("t", -1, None), ("t", 2, None), ("t", 99, 1), ("t", None, 2), ("t", -1, 9)],
        "topic string, partition int, at bigint")
    split = route(rows, 10, "at")
    assert rows_of(split.good) == sorted([("t", 0, 3), ("t", 1, 9), ("t", 2, None)], key=repr)
    assert rows_of(split.dead_letter, "at", "reason") == sorted([
        (4, "topic_missing"), (None, "arrival_missing"), (1, "partition_unknown"), (2, "partition_unknown")], key=repr)


def test_sparse_arrival_is_numbered_in_many_tasks(spark):
    rows = spark.range(20_000).select(F.lit("t").alias("k"), (F.col("id") * 1_000_000_007).alias("at"))
    numbered = number_rows(rows, ["k"], "at", "n")
    assert numbered.where(F.col("n") * 1_000_000_007 == F.col("at")).count() == 20_000
    assert "Window" not in plan_of(numbered)


def test_appends_read_the_manifest_and_not_the_log(spark, tmp_path, rows_of):
    from rackpulse.sources.log_files import append_log, manifest_heads

    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("t", 0, i) for i in range(5)], "topic string, partition int, at bigint")
    rows = rows.join(spark.createDataFrame([tuple(record()[n] for n in TELEMETRY_RECORD.names)], TELEMETRY_RECORD))
    for _ in range(2):
        append_log(rows, log, "at")
    assert rows_of(manifest_heads(spark, log)) == [("t", 0, 10)]
    assert rows_of(read_log(spark, log), "offset") == sorted([(n,) for n in range(10)], key=repr)
    assert all("/log_heads/" in name for name in manifest_heads(spark, log).inputFiles())


def test_resume_skips_old_segments(spark, tmp_path, rows_of):
    from rackpulse.schemas import SEGMENT
    from rackpulse.sources.log_files import write_log

    log = str(tmp_path / "log")
    write_log(spark.createDataFrame([("t", p, o) for p in (0, 1) for o in (1, SEGMENT + 1)], "topic string, partition int, offset bigint"), log)
    stored = spark.read.parquet(log)
    commits = spark.createDataFrame([("t", "g", 0, SEGMENT)], "topic string, consumer_group string, partition int, committed bigint")
    left = progress.resume(stored, commits, "t", "g")
    assert rows_of(left, "partition", "offset") == sorted([(0, SEGMENT + 1), (1, 1), (1, SEGMENT + 1)], key=repr)
    assert "segment" in plan_of(left).split("PartitionFilters: [")[1].split("]")[0]
