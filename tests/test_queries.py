from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from helpers import plan_of
from rackpulse.operators.paging import page, sample_page
from rackpulse.operators.sizes import written
from rackpulse.plans import queries
from rackpulse.plans.params import GpuFilter, TelemetryFilter
from rackpulse.schemas import GPUS, TELEMETRY_SAMPLES

T0 = datetime(2026, 5, 1, 12)


@pytest.fixture(scope="module")
def gpus(spark):
    rows = [(f"GPU-{n:02d}", None if n == 3 else "0", "nvidia0",
             "Corvid H100 80GB HBM3" if n < 12 else "Corvid A100 40GB", None if n % 5 == 0 else f"Host-{n}", T0, T0)
            for n in range(16)]
    return spark.createDataFrame(rows, GPUS)


@pytest.fixture(scope="module")
def samples(spark):
    rows = [(n, f"GPU-{n % 16:02d}", "util" if n % 2 else "temp", T0, T0 + timedelta(seconds=n // 4), float(n),
             None, "pod" if n % 3 else None, None, None) for n in range(160)]
    return spark.createDataFrame(rows, TELEMETRY_SAMPLES)


def uuids(df):
    return [r.uuid for r in df.collect()]


def ids(df):
    return [r.id for r in df.collect()]


def test_models(gpus):
    assert [tuple(r) for r in queries.count_models(gpus).collect()] == [
        ("Corvid H100 80GB HBM3", 12), ("Corvid A100 40GB", 4)
    ]


def test_model_ties_go_by_name(spark):
    at = [(u, "0", "d", m, "h", T0, T0) for u, m in (("a", "Z"), ("b", "A"), ("c", "M"), ("d", "M"))]
    assert [r.model_name for r in queries.count_models(spark.createDataFrame(at, GPUS)).collect()] == ["M", "A", "Z"]


def test_gpu_filters(gpus):
    assert len(uuids(queries.list_gpus(gpus, GpuFilter(model_name="h100")))) == 12
    assert uuids(queries.list_gpus(gpus, GpuFilter(hostname="HOST-1", limit=3))) == ["GPU-01", "GPU-11", "GPU-12"]
    assert uuids(queries.list_gpus(gpus, GpuFilter(model_name="a100", hostname="host"))) == ["GPU-12", "GPU-13", "GPU-14"]
    assert uuids(queries.list_gpus(gpus, GpuFilter(limit=2, offset=3))) == ["GPU-03", "GPU-04"]
    assert uuids(queries.list_gpus(gpus, GpuFilter(offset=99))) == []
    for wrong in (GpuFilter(limit=0), GpuFilter(offset=-1), GpuFilter(offset=3_000_000_000)):
        with pytest.raises(ValueError, match="limit|offset"):
            queries.list_gpus(gpus, wrong)
    for offset in (0, 3, 12, 16):
        want = uuids(queries.list_gpus(gpus, GpuFilter(limit=5, offset=offset)))
        assert uuids(page(gpus, ["uuid"], 5, offset, shallow=2)) == want
    assert len(uuids(queries.list_all_gpus(gpus))) == 16


def test_wildcards_and_backslashes(gpus):
    assert len(uuids(queries.list_gpus(gpus, GpuFilter(model_name="h_00%gb")))) == 12
    assert len(uuids(queries.list_gpus(gpus, GpuFilter(model_name="H\\100")))) == 12
    assert uuids(queries.list_gpus(gpus, GpuFilter(model_name="h\\%"))) == []
    assert uuids(queries.list_gpus(gpus, GpuFilter(model_name="hbm3\\"))) == []


def test_nulls_come_out_empty_but_filters_see_nulls(gpus):
    row = queries.list_gpus(gpus, GpuFilter(limit=1)).first()
    assert row.hostname == "" and row.gpu_index == "0"
    assert "GPU-00" not in uuids(queries.list_gpus(gpus, GpuFilter(hostname="%")))


def test_device_samples(samples):
    assert ids(queries.gpu_samples(samples, "GPU-01")) == list(range(1, 160, 16))
    assert ids(queries.gpu_samples(samples, "GPU-01", "util", limit=2, offset=1)) == [17, 33]
    assert ids(queries.gpu_samples(samples, "GPU-01", "UTIL")) == []
    assert ids(queries.gpu_samples(samples, "GPU-01", start=T0 + timedelta(seconds=4), end=T0 + timedelta(seconds=8))) == [17, 33]
    assert ids(queries.gpu_samples(samples, "nobody")) == []
    aware = (T0 + timedelta(seconds=4)).replace(tzinfo=timezone.utc).astimezone(timezone(timedelta(hours=5)))
    assert ids(queries.gpu_samples(samples, "GPU-01", start=aware, end=aware)) == [17]
    assert ids(queries.gpu_samples(samples, "GPU-01", start=T0 + timedelta(hours=1), end=T0)) == []
    row = queries.gpu_samples(samples, "GPU-00").first()
    assert (row.container, row.pod, row.namespace, row.labels_raw) == ("", "", "", "")


def test_search(samples, gpus):
    a100 = TelemetryFilter(model_name="a100", limit=1000)
    assert ids(queries.search_samples(samples, gpus, a100)) == [n for n in range(160) if n % 16 >= 12]
    both = TelemetryFilter(model_name="a100", metric_name="util", uuid="GPU-13", end=T0 + timedelta(seconds=10))
    assert ids(queries.search_samples(samples, gpus, both)) == [13, 29]
    assert ids(queries.search_samples(samples, gpus, TelemetryFilter(limit=3, offset=5))) == [5, 6, 7]
    with pytest.raises(ValueError, match="limit"):
        queries.search_samples(samples, gpus, TelemetryFilter(limit=1 << 31))
    orphans = queries.search_samples(samples, gpus.where("uuid < 'GPU-02'"), TelemetryFilter(limit=500))
    assert ids(orphans) == [n for n in range(160) if n % 16 < 2]
    assert ids(queries.search_samples(samples, gpus, TelemetryFilter(model_name="none"))) == []


def test_search_plan(samples, gpus):
    gpus = written(gpus)
    plan = plan_of(queries.search_samples(samples, gpus, TelemetryFilter(model_name="h100")))
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert "Exchange hashpartitioning" not in plan
    assert "LeftSemi" in plan_of(queries.search_samples(samples, gpus, TelemetryFilter(metric_name="util")))


def test_pages_put_rows_without_a_time_last(spark):
    rows = spark.createDataFrame([(i, T0 + timedelta(seconds=i) if i % 3 else None) for i in range(30)], "id bigint, sample_at timestamp")
    want = [i for i in range(30) if i % 3] + [i for i in range(30) if i % 3 == 0]
    for offset in (0, 7, 17, 19, 20, 25, 29, 30):
        for shallow in (100, 4):
            assert ids(sample_page(rows, 4, offset, shallow=shallow)) == want[offset:offset + 4]


@pytest.mark.parametrize("limit, offset", [(10, 0), (7, 30), (50, 100), (30, 150), (10, 159), (10, 160), (10, 5000)])
def test_deep_pages_equal_shallow_ones(samples, limit, offset):
    want = ids(sample_page(samples, limit, offset))
    assert ids(sample_page(samples, limit, offset, shallow=2)) == want


def test_deep_page_within_one_instant(spark):
    rows = spark.range(-300, 700).select(
        (F.col("id") * 1_000_003).alias("id"), F.when(F.col("id") % 3 == 0, F.lit("2026-05-02")).otherwise(
            F.lit("2026-05-01")).cast("timestamp_ntz").alias("sample_at"))
    for offset in (0, 600, 650, 667, 900, 995):
        assert ids(sample_page(rows, 20, offset, shallow=10)) == ids(sample_page(rows, 20, offset))


def test_deep_page_with_times_out_of_the_usual(spark):
    stamps = ["0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "9999-12-31 23:59:59.999999"]
    rows = spark.createDataFrame(list(enumerate(stamps)), "id bigint, s string").select(
        "id", F.col("s").cast("timestamp_ntz").alias("sample_at"))
    ancient = spark.range(1).select((F.col("id") - 1).alias("id"), F.timestamp_micros(F.lit(-(1 << 60))).cast(
        "timestamp_ntz").alias("sample_at"))
    rows = rows.unionByName(ancient)
    for offset in range(5):
        assert ids(sample_page(rows, 1, offset, shallow=0).select("id")) == [offset - 1]


def test_group_progress(spark):
    log = spark.createDataFrame([("t", p, o) for p in (0, 1) for o in range(6)], "topic string, partition int, offset bigint")
    acks = spark.createDataFrame([("t", "g", 0, 4)], "topic string, consumer_group string, partition int, offset bigint")
    got = {r.partition: (r.committed, r.head, r.tail, r.start, r.lost)
           for r in queries.group_progress(log, acks, "t", "g", 4).collect()}
    assert got == {0: (4, 6, 2, 5, 0), 1: (None, 6, 2, 2, 2)}
