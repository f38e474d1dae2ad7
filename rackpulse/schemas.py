"""Schemas, keys and limits of the data model."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _strings(*names: str) -> list[StructField]:
    return [StructField(name, StringType()) for name in names]


# The exporter's twelve CSV columns, in file order.
CSV_COLUMNS = [
    "timestamp", "metric_name", "gpu_id", "device", "uuid", "modelName",
    "Hostname", "container", "pod", "namespace", "value", "labels_raw",
]
CORRUPT = "_corrupt"
RAW_CSV = StructType(_strings(*CSV_COLUMNS))
RAW_CSV_SCAN = StructType(_strings(*CSV_COLUMNS, CORRUPT))

TELEMETRY_RECORD = StructType(
    [StructField("ingested_unix_ns", LongType()), StructField("sample_unix_ns", LongType())]
    + _strings("metric_name", "uuid", "gpu_index", "device", "model_name", "hostname",
               "container", "pod", "namespace")
    + [StructField("value", DoubleType())]
    + _strings("labels_raw")
)

MESSAGE_LOG = StructType([
    StructField("topic", StringType()),
    StructField("partition", IntegerType()),
    StructField("offset", LongType()),
    StructField("payload", TELEMETRY_RECORD),
    StructField("headers", MapType(StringType(), StringType())),
    StructField("timestamp_ns", LongType()),
])

STORED_LOG = StructType([*MESSAGE_LOG.fields, StructField("segment", LongType())])

ACK_LOG = StructType(
    _strings("topic", "consumer_group")
    + [StructField("partition", IntegerType()), StructField("offset", LongType())]
)

GPUS = StructType(
    _strings("uuid", "gpu_index", "device", "model_name", "hostname")
    + [StructField("created_at", TimestampType()), StructField("updated_at", TimestampType())]
)

TELEMETRY_SAMPLES = StructType(
    [StructField("id", LongType())]
    + _strings("uuid", "metric_name")
    + [StructField("ingested_at", TimestampType()), StructField("sample_at", TimestampType()),
       StructField("value", DoubleType())]
    + _strings("container", "pod", "namespace", "labels_raw")
)

GPU_ATTRIBUTES = ["gpu_index", "device", "model_name", "hostname"]
SAMPLE_KEY = ["uuid", "metric_name", "sample_at"]
LOG_KEY = ["topic", "partition"]
# Offsets per segment folder of a stored log partition.
SEGMENT = 1 << 24
PROGRESS_KEY = ["topic", "consumer_group", "partition"]

# Most characters a column holds, and the columns that must be there.
GPU_LENGTHS = {"uuid": 64, "gpu_index": 8, "device": 32, "model_name": 128, "hostname": 128}
GPU_REQUIRED = ["uuid", "model_name"]
SAMPLE_LENGTHS = {"uuid": 64, "metric_name": 64, "container": 128, "pod": 128, "namespace": 128}
SAMPLE_REQUIRED = ["uuid", "metric_name", "ingested_at", "sample_at", "value"]

# Defaults of the log and of the query pages.
DEFAULT_PARTITIONS = 10
DEFAULT_CAPACITY = 65_536
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
DEFAULT_INTERVAL_MS = 100
