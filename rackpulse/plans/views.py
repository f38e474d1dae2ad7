"""The test tables (events, customer, nation) seen as devices, samples, messages and acks.

Each event is one sample of the device with the number of its user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.operators.progress import assign_offsets, heads
from rackpulse.schemas import CSV_COLUMNS, DEFAULT_PARTITIONS, LOG_KEY
from rackpulse.session import scratch_dir
from rackpulse.sources.log_files import write_log

TOPIC, GROUP = "telemetry", "collector"
CAPACITY = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _uuid(key: Column) -> Column:
    # Wider keys keep all their digits; lpad alone would cut them.
    text = key.cast("string")
    return F.concat(F.lit("GPU-"), F.lpad(text, F.greatest(F.lit(6), F.char_length(text)), "0"))


def gpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have events, as devices."""
    seen = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")
    )
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(seen, key == F.col("user_id"))
        .select(
            _uuid(key).alias("uuid"),
            (key % 8).cast("string").alias("gpu_index"),
            F.concat(F.lit("nvidia"), (key % 8).cast("string")).alias("device"),
            F.concat(F.lit("MODEL "), "c_mktsegment").alias("model_name"),
            F.when(key % 10 != 0, F.concat(F.lit("host-"), F.lower("n_name"))).alias("hostname"),
            "created_at", "updated_at",
        )
    )


def gpus_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension that lacks the devices at index 7, so that references can break."""
    return gpus(spark, sf_dir).where(F.col("gpu_index") != "7")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a sample."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        event.alias("id"),
        _uuid(F.col("user_id")).alias("uuid"),
        F.concat(F.lit("EVT_"), F.upper("event_type")).alias("metric_name"),
        F.col("ts").alias("ingested_at"),
        F.col("ts").alias("sample_at"),
        "value",
        F.lit(None).cast("string").alias("container"),
        F.when(event % 3 == 0, F.concat(F.lit("pod-"), (event % 7).cast("string"))).alias("pod"),
        F.lit(None).cast("string").alias("namespace"),
        F.col("props").alias("labels_raw"),
    )


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with its topic and partition."""
    return table(spark, sf_dir, "events").select(
        F.lit(TOPIC).alias("topic"),
        (F.col("event_id") % DEFAULT_PARTITIONS).cast("int").alias("partition"),
        "event_id", "event_type", "value",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a log message with its offset."""
    return assign_offsets(routed(spark, sf_dir), "event_id")


def stored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages, written once as a log, for queries that read it several times."""
    path = scratch_dir(spark, "messages")
    write_log(messages(spark, sf_dir), path)
    return spark.read.parquet(path).withColumn("partition", F.col("partition").cast("int"))


def acks(log: DataFrame) -> DataFrame:
    """Acknowledged messages: none for errors and partition 9, a share of the rest that grows with the partition."""
    part = F.col("partition")
    return (
        log.join(heads(log, CAPACITY), LOG_KEY)
        .where((F.col("event_type") != "error") & (part != 9)
               & (F.col("offset") * 10 < F.col("head") * (part + 1)))
        .select("topic", F.lit(GROUP).alias("consumer_group"), "partition", "offset")
    )


def failed(log: DataFrame) -> DataFrame:
    """Messages the consumer could not process."""
    return log.where(F.col("event_type") == "error").select(
        "topic", F.lit(GROUP).alias("consumer_group"), "partition", "offset", "event_id"
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a typed record with topic and partition, before offsets."""
    devices = gpus(spark, sf_dir).select("uuid", "gpu_index", "device", "model_name", "hostname")
    ns = F.unix_micros(F.col("sample_at").cast("timestamp")) * F.lit(1000)
    return samples(spark, sf_dir).join(devices, "uuid").select(
        F.col("id").alias("event_id"),
        F.lit(TOPIC).alias("topic"),
        (F.col("id") % DEFAULT_PARTITIONS).cast("int").alias("partition"),
        ns.alias("ingested_unix_ns"), ns.alias("sample_unix_ns"),
        "metric_name", "uuid", "gpu_index", "device", "model_name",
        *(F.coalesce(name, F.lit("")).alias(name) for name in ("hostname", "container", "pod", "namespace")),
        "value", "labels_raw",
    )


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a row of the exporter's CSV, some with a bad value or uuid."""
    event, number = F.col("event_id"), F.col("value").cast("string")
    value = (
        F.when(event % 97 == 0, "warm").when(event % 89 == 0, "")
        .when(event % 83 == 0, "1d").otherwise(number)
    )
    uuid = F.when(event % 79 == 0, F.concat("uuid", F.repeat(F.lit("x"), 64))).otherwise(F.col("uuid"))
    shaped = records(spark, sf_dir).withColumns({
        "timestamp": F.lit("some day"),
        "gpu_id": F.col("gpu_index"), "modelName": F.col("model_name"), "Hostname_": F.col("hostname"),
        "uuid_": uuid, "value_": value,
    })
    renamed = {"Hostname": "Hostname_", "uuid": "uuid_", "value": "value_"}
    return shaped.select("event_id", *(F.col(renamed.get(name, name)).alias(name) for name in CSV_COLUMNS))


def write_csv(spark: SparkSession, sf_dir: str) -> str:
    """``csv_rows`` as CSV files in event order, in a fresh folder."""
    path = scratch_dir(spark, "csv")
    rows = csv_rows(spark, sf_dir).orderBy("event_id").select(*CSV_COLUMNS)
    rows.write.options(header="true", escape='"', emptyValue="").csv(path, mode="overwrite")
    return path
