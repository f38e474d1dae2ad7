"""The queries: device list, samples of a device, search, models, progress."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.text import empty_if_null
from rackpulse.operators.filters import contains, equals, in_time_range
from rackpulse.operators.merge import with_device
from rackpulse.operators.paging import page, sample_page
from rackpulse.operators.progress import committed, heads, starts
from rackpulse.plans.params import GpuFilter, TelemetryFilter
from rackpulse.schemas import DEFAULT_CAPACITY, DEFAULT_LIMIT, GPUS, TELEMETRY_SAMPLES

NULLABLE_GPU = {"gpu_index", "device", "hostname"}
NULLABLE_SAMPLE = {"container", "pod", "namespace", "labels_raw"}


def _output(df: DataFrame, names: list[str], nullable: set[str]) -> DataFrame:
    """The result columns, NULL texts as empty ones. Filters run before, on the raw columns."""
    return df.select(
        *(empty_if_null(F.col(name)).alias(name) if name in nullable else F.col(name) for name in names)
    )


def gpu_output(devices: DataFrame) -> DataFrame:
    return _output(devices, GPUS.names, NULLABLE_GPU)


def sample_output(samples: DataFrame) -> DataFrame:
    return _output(samples, TELEMETRY_SAMPLES.names, NULLABLE_SAMPLE)


def list_gpus(devices: DataFrame, wanted: GpuFilter = GpuFilter()) -> DataFrame:
    """Devices by ``uuid``, filtered by parts of the model and host name."""
    found = contains(devices, model_name=wanted.model_name, hostname=wanted.hostname)
    return gpu_output(page(found, ["uuid"], wanted.limit, wanted.offset))


def list_all_gpus(devices: DataFrame) -> DataFrame:
    """All devices by ``uuid``."""
    return gpu_output(devices).orderBy("uuid")


def gpu_samples(samples: DataFrame, uuid: str, metric_name: str = "", start: datetime | None = None,
                end: datetime | None = None, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """Samples of one device by time. An unknown device gives no rows."""
    mine = samples.where(F.col("uuid") == F.lit(uuid))
    found = in_time_range(equals(mine, metric_name=metric_name), start, end)
    return sample_output(sample_page(found, limit, offset))


def matching_samples(samples: DataFrame, devices: DataFrame, wanted: TelemetryFilter) -> DataFrame:
    """All samples a search finds, before sorting and paging.

    A sample whose device is not there is not found. A semi join is enough because no
    device column is returned.
    """
    found = equals(samples, uuid=wanted.uuid, metric_name=wanted.metric_name)
    found = in_time_range(found, wanted.start, wanted.end)
    return with_device(found, contains(equals(devices, uuid=wanted.uuid), model_name=wanted.model_name))


def search_samples(samples: DataFrame, devices: DataFrame,
                   wanted: TelemetryFilter = TelemetryFilter()) -> DataFrame:
    """Samples across devices by time, filtered by any mix of fields."""
    return sample_output(sample_page(matching_samples(samples, devices, wanted), wanted.limit, wanted.offset))


def count_models(devices: DataFrame) -> DataFrame:
    """Devices per model, most first, then by name."""
    return (
        devices.groupBy("model_name")
        .agg(F.count("*").cast("int").alias("gpu_count"))
        .orderBy(F.desc("gpu_count"), F.asc("model_name"))
    )


def group_progress(log: DataFrame, acks: DataFrame, topic: str, group: str,
                   capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """Per partition: committed offset, head, tail, where to read on and what is lost."""
    commits = committed(acks)
    mine = commits.where((F.col("topic") == topic) & (F.col("consumer_group") == group))
    return starts(commits, heads(log, capacity), topic, group).join(
        mine.select("topic", "partition", "committed"), ["topic", "partition"], "left"
    )
