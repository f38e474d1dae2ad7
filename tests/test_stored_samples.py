import shutil
from datetime import datetime, timezone

import pytest
from helpers import messages, record, scanned_rows
from pyspark.sql import functions as F
from rackpulse.operators.seek import Cursor, pages, seek
from rackpulse.plans.ingest import apply_batch
from rackpulse.sources.tables import Tables

DAY = 86_400_000_000_000
MAY = 1_777_636_800_000_000_000  # 2026-05-01 12:00:00 UTC


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """Four batches of samples over six days, all days in every batch."""
    tables = Tables(spark, str(tmp_path_factory.mktemp("filled") / "tables"))
    for batch in range(4):
        rows = [
            (0, batch * 1000 + n, record(f"GPU-{n % 7}", MAY + (n % 6) * DAY + (n // 2) * 1_000_000, metric=f"m{batch}", value=float(n)))
            for n in range(60)
        ]
        apply_batch(tables, messages(spark, rows), "g", batch, partitions=1)
    return tables.root


@pytest.fixture
def tables(spark, tmp_path, filled):
    return Tables(spark, shutil.copytree(filled, str(tmp_path / "tables")))


def files_of(tables):
    return {row.sample_date: row.files for row in tables.sample_files().collect()}


def test_compaction_keeps_all_rows_in_fewer_files(tables, rows_of):
    before, files = rows_of(tables.samples()), files_of(tables)
    assert len(before) == 240 and min(files.values()) > 1
    assert tables.compact_samples() == tables.sample_days()
    after = files_of(tables)
    assert sum(after.values()) < sum(files.values()) and after.keys() == files.keys()
    assert rows_of(tables.samples()) == before
    # A day that has no crowd of small files is left alone.
    alone = [day for day, count in after.items() if count == 1]
    assert not set(alone) & set(tables.compact_samples())


def test_compaction_that_was_cut_short_is_finished(spark, tables, rows_of, monkeypatch):
    before = rows_of(tables.samples())
    whole, calls = Tables._finish_compaction, []

    def first_only(self):
        calls.append(1)
        if len(calls) == 1:
            whole(self)

    monkeypatch.setattr(Tables, "_finish_compaction", first_only)
    tables.compact_samples()
    monkeypatch.undo()
    jvm = spark._jvm.org.apache.hadoop.fs
    copy = jvm.Path(f"{tables.root}/telemetry_samples_compacted")
    files = copy.getFileSystem(spark._jsc.hadoopConfiguration())
    assert files.exists(copy)
    # One day's old folder is gone and its new one not yet in place.
    day = tables.sample_days()[2]
    files.delete(jvm.Path(f"{tables.root}/telemetry_samples/sample_date={day}"), True)
    apply_batch(tables, messages(spark, [(0, 9000, record("GPU-new", MAY + 2 * DAY))]), "g", 9, partitions=1)
    assert not files.exists(copy)
    assert len(rows_of(tables.samples())) == len(before) + 1
    assert rows_of(tables.samples().where("uuid != 'GPU-new'")) == before


def test_bloom_filter_skips_row_groups(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "tables"))
    for batch in range(2):
        rows = [(0, 5000 * batch + n, record(f"GPU-{2 * n}-{batch}", MAY + n * 1000, container="c" * 120 + str(n))) for n in range(3000)]
        apply_batch(tables, messages(spark, rows), "g", batch, partitions=1)
    tables.compact_samples(row_group_bytes=64 << 10)
    # Inside the range of all uuids, but of no device.
    assert scanned_rows(tables.samples().where("uuid = 'GPU-2001-0'")) == 0
    hit = tables.samples().where("uuid = 'GPU-2000-0'")
    assert hit.count() == 1 and 0 < scanned_rows(hit) < 3000


def test_newest_first_opens_the_last_days_only(spark, tables):
    order = [F.desc("sample_at"), F.desc("id")]
    want = [row.id for row in tables.samples().orderBy(*order).select("id").collect()]
    assert [row.id for row in tables.newest_samples(25).collect()] == want[:25]
    assert [row.id for row in tables.newest_samples(1000).collect()] == want
    # Without the older folders the page is the same, so they were not opened.
    some = tables.sample_days()[-1:]
    assert [row.id for row in seek(tables.samples(), some, 25).collect()] == want[:25]
    mine = tables.samples().where("uuid = 'GPU-3' and metric_name = 'm2'").orderBy(*order).limit(4)
    assert tables.newest_samples(4, uuid="GPU-3", metric_name="m2").collect() == mine.collect()
    assert tables.newest_samples(3, uuid="nobody").count() == 0
    assert Tables(spark, tables.root + "_none").newest_samples(3).count() == 0


@pytest.mark.parametrize("newest", [True, False])
def test_pages_joined_are_the_full_order(tables, newest):
    tied = tables.samples().withColumn("sample_at", F.date_trunc("day", "sample_at"))
    whole = sorted(((row.sample_at, row.id) for row in tied.collect()), reverse=newest)
    got = [[(row.sample_at, row.id) for row in page.collect()] for page in pages(tied, tables.sample_days(), 50, newest)]
    assert [row for page in got for row in page] == whole and [len(page) for page in got] == [50, 50, 50, 50, 40]


def test_cursor_bound_reaches_the_scan(tables):
    from helpers import plan_of
    from rackpulse.operators.seek import behind

    plan = plan_of(behind(tables.samples(), Cursor(datetime(2026, 5, 3, 12, tzinfo=timezone.utc), 7), True))
    assert "LessThanOrEqual(sample_at" in plan and "sample_date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(ValueError):
        seek(tables.samples(), [], 0)


def test_lookup_over_many_days_is_one_short_filter(spark, tmp_path, monkeypatch):
    """A lookup over more days than are named one by one is bounded by common times and devices, and stays exact."""
    tables, path = Tables(spark, str(tmp_path / "tables")), str(tmp_path / "keys")
    day = 86_400_000_000_000
    rows = [(0, n, record(f"GPU-{n % 5}", 1_777_636_800_000_000_000 + n * day)) for n in range(12)]
    apply_batch(tables, messages(spark, rows), "g")
    again = [(0, 20 + n, rows[n][2]) for n in range(12)] + [(0, 40, record("GPU-0", 1_777_636_800_000_001_000))]
    maybe = tables.samples().select("sample_date", "uuid", "metric_name", "sample_at")
    condition = tables._candidates(maybe)._jdf.queryExecution().optimizedPlan().toString()
    assert condition.count("uuid#") < 8 and condition.count(" OR ") < 2
    assert tables._candidates(maybe).count() == 12
    apply_batch(tables, messages(spark, again), "g")
    assert tables.samples().count() == 13


def test_a_batch_of_new_samples_is_copied_once(spark, tmp_path, monkeypatch, rows_of):
    """An append stores the numbered rows only, a batch of a stored log the first row of each key, and no copies of those."""
    from rackpulse.operators import numbering, sizes
    from rackpulse.plans import ingest
    from rackpulse.sources import log_files, tables as module

    sides = []

    def noted(side, name="side"):
        sides.append((name, side.columns))
        return sizes.written(side, name)

    for user in (numbering, ingest, log_files, module):
        monkeypatch.setattr(user, "written", noted)
    log, tables = str(tmp_path / "log"), Tables(spark, str(tmp_path / "tables"))
    rows = messages(spark, [(n % 3, 0, record(f"GPU-{n % 5}", 1_777_636_800_000_000_000 + n * 1_000_000)) for n in range(30)])
    log_files.append_log(rows.select("topic", "partition", "payload.*"), log, "sample_unix_ns")
    stored = log_files.read_log(spark, log)
    assert rows_of(stored, "partition", "offset") == [(part, at) for part in range(3) for at in range(10)]
    assert [name for name, held in sides if "labels_raw" in held] == ["numbered"]
    sides.clear()
    apply_batch(tables, stored.where("partition < 2"), "g", stored=True)
    assert [name for name, held in sides if "labels_raw" in held] == ["first"]
    assert all("model_name" not in held for _, held in sides)
    # With stored samples among them the rest is written once more, and nothing comes twice.
    apply_batch(tables, stored, "g", 1, stored=True)
    assert [name for name, held in sides if "labels_raw" in held] == ["first", "first", "fresh"]
    assert rows_of(tables.samples(), "id") == sorted([(at * 10 + part,) for part in range(3) for at in range(10)], key=repr)
