import json
import math
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from rackpulse.functions.numbers import parse_double
from rackpulse.functions.text import like_pattern, too_long
from rackpulse.functions.time import ns_to_timestamp, rfc3339_text
from rackpulse.plans.json_rows import gpu_json, sample_json
from rackpulse.plans.params import GpuFilter, TelemetryFilter, parse_limit, parse_offset, parse_time
from rackpulse.schemas import GPUS, TELEMETRY_SAMPLES

ACCEPTED = {
    "317.25": 317.25, "4096": 4096.0, "-1.": -1.0, ".5": 0.5, "+7e2": 700.0, "1_000.2_5e+1_0": 1000.25e10,
    "0x1p-2": 0.25, "0X_1.8P1": 3.0, "1e-400": 0.0, "inf": math.inf, "-Infinity": -math.inf, "+INF": math.inf,
}
REJECTED = ["warm", "", " 7", "7 ", "1d", "2F", "1e999", "-1e999", "0x1", "1__0", "_1", "1_", "1_.5", "+nan",
            "0x1p99999", "1e", ".", "e5", "1\n", "١"]


def test_number_texts(spark):
    texts = [*ACCEPTED, *REJECTED, "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = dict(df.select("t", parse_double(F.col("t"))).collect())
    assert {t: got[t] for t in ACCEPTED} == ACCEPTED
    assert [t for t in REJECTED if got[t] is not None] == []
    assert math.isnan(got["NaN"])


def test_ns_become_microseconds_rounded_down(spark):
    ns = [1_777_636_800_000_000_999, 1_777_636_801_000_000_000, -1, 1_753_871_999_999_999_999]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    micros = [r[0] for r in df.select(F.unix_micros(ns_to_timestamp(F.col("n")))).collect()]
    assert micros == [n // 1000 for n in ns]


def test_too_long_counts_characters_and_allows_trailing_blanks(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",), ("abcd   ",), ("äöüß",), ("abcd x",), (None,)], "t string")
    assert [r[0] for r in df.select(too_long(F.col("t"), 4)).collect()] == [False, True, False, False, True, None]


@pytest.mark.parametrize("text, pattern", [
    ("h100", "%h100%"), ("", None), (None, None), ("a%b_c", "%a%b_c%"), ("a\\xb", "%axb%"), ("a\\%b", "%a\\%b%"),
    ("a\\\\b", "%a\\\\b%"), ("end\\", "%end\\%"),
])
def test_like_pattern(text, pattern):
    assert like_pattern(text) == pattern


def test_rfc3339_text_drops_trailing_zeros(spark):
    texts = ["2026-05-01 12:00:00", "2026-05-01 12:00:10.1", "2026-05-01 12:00:00.000120"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp").alias("t"))
    assert [r[0] for r in df.select(rfc3339_text(F.col("t"))).collect()] == [
        "2026-05-01T12:00:00Z", "2026-05-01T12:00:10.1Z", "2026-05-01T12:00:00.00012Z",
    ]


def test_limits():
    assert parse_limit(None) == parse_limit("") == 100
    assert parse_limit("99999") == 1000
    with pytest.raises(ValueError, match="limit"):
        parse_limit(1 << 31)
    assert parse_limit("7") == parse_limit(7) == 7
    for bad in ("abc", "0", "-3", "1.5", " 5", "1_0", "9" * 30):
        with pytest.raises(ValueError, match="limit"):
            parse_limit(bad)


def test_offsets():
    assert parse_offset(None) == 0 and parse_offset("12") == 12
    assert parse_offset((1 << 31) - 1) == (1 << 31) - 1
    with pytest.raises(ValueError, match="offset"):
        parse_offset(1 << 31)
    for bad in ("-5", "x"):
        with pytest.raises(ValueError, match="offset"):
            parse_offset(bad)


def test_times():
    noon = datetime(2025, 7, 18, 12, tzinfo=timezone.utc)
    assert parse_time("2025-07-18T12:00:00Z", "start_time") == noon
    assert parse_time("2025-07-18T14:00:00+02:00", "start_time") == noon
    assert parse_time("2025-07-18T06:30:00.000001999-05:30", "start_time") == noon.replace(microsecond=1)
    assert parse_time("", "start_time") is None
    for bad in ("yesterday", "2025-07-18", "2025-07-18 12:00:00Z", "2025-07-18T12:00:00", "2025-02-30T00:00:00Z",
                "2025-07-18T24:00:00Z", "2025-07-18T12:00:00+99:00", "2025-07-18t12:00:00z"):
        with pytest.raises(ValueError, match="start_time"):
            parse_time(bad, "start_time")


def test_filters_keep_texts_unchanged():
    assert GpuFilter.parse(model_name="h100") == GpuFilter("h100", "", 100, 0)
    wanted = TelemetryFilter.parse(uuid="GPU-1", end_time="2025-07-18T12:00:00Z", limit="5", offset="2")
    assert (wanted.uuid, wanted.metric_name, wanted.start, wanted.limit, wanted.offset) == ("GPU-1", "", None, 5, 2)
    with pytest.raises(ValueError, match="end_time"):
        TelemetryFilter.parse(end_time="later")


def test_json_rows(spark):
    at = datetime(2026, 5, 1, 12)
    gpus = spark.createDataFrame([("GPU-1", "", "nvidia0", "A \"B\"", "", at, at)], GPUS)
    assert json.loads(gpu_json(gpus).first()["json"])["hostname"] == ""
    tricky = '"value":"NaN",x'
    samples = spark.createDataFrame(
        [(1, "GPU-1", "m", at, at, 1.5, "", "p", "", tricky), (2, "GPU-1", "m", at, at, math.nan, "", "", "", ""),
         (3, "GPU-1", "m", at, at, -math.inf, "", "", "", "")], TELEMETRY_SAMPLES)
    first, nan, inf = [json.loads(r[0]) for r in sample_json(samples).orderBy("id").select("json").collect()]
    assert first["labels_raw"] == tricky and first["pod"] == "p" and first["value"] == 1.5
    assert "container" not in first and "namespace" not in first
    assert nan["value"] is None and inf["value"] is None and "pod" not in nan
