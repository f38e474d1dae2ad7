"""CSV row to typed record, with rejected rows set aside."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.numbers import parse_double
from rackpulse.functions.text import clipped, empty_if_null, too_long
from rackpulse.functions.time import now_ns, ns_to_timestamp
from rackpulse.schemas import (
    CORRUPT,
    CSV_COLUMNS,
    GPU_LENGTHS,
    GPU_REQUIRED,
    SAMPLE_LENGTHS,
    SAMPLE_REQUIRED,
    TELEMETRY_RECORD,
)


class Split(NamedTuple):
    """Accepted rows and rejected rows, both lazy over the same input."""

    good: DataFrame
    dead_letter: DataFrame


# Record field <- CSV column, where the names differ.
RENAMED = {"gpu_index": "gpu_id", "model_name": "modelName", "hostname": "Hostname"}


def parse_problem() -> Column:
    """Why a raw row cannot become a record; NULL if it can."""
    return F.when(F.col(CORRUPT).isNotNull(), "column_count").when(parse_double(F.col("value")).isNull(), "value")


def to_records(raw: DataFrame, stamp_ns: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rename and type the raw columns; both times get the same stamp.

    The CSV's own timestamp is not used. Without ``stamp_ns`` the wall clock of the
    batch is taken.
    """
    fields = {
        field.name: empty_if_null(F.col(RENAMED.get(field.name, field.name)))
        for field in TELEMETRY_RECORD
        if not field.name.endswith("_unix_ns")
    }
    fields["value"] = parse_double(F.col("value"))
    stamp = now_ns() if stamp_ns is None else stamp_ns
    fields["ingested_unix_ns"] = stamp
    fields["sample_unix_ns"] = stamp
    return raw.select(*keep, *(fields[field.name].alias(field.name) for field in TELEMETRY_RECORD))


def split_rows(raw: DataFrame, stamp_ns: Column | None = None,
               keep: tuple[str, ...] = ("row_num",)) -> Split:
    """Typed records, and the rows that are too short, too long or have no number."""
    marked = raw.withColumn("reason", parse_problem())
    good = to_records(marked.where(F.col("reason").isNull()), stamp_ns, keep)
    dead = marked.where(F.col("reason").isNotNull()).select(
        *keep, "reason", F.struct(*CSV_COLUMNS).alias("raw")
    )
    return Split(good, dead)


def _violation(lengths: dict[str, int], required: list[str]) -> Column:
    checks = [F.when(F.col(name).isNull(), name) for name in required]
    checks += [F.when(too_long(F.col(name), most), name) for name, most in lengths.items()]
    return F.coalesce(*checks)


def device_violation() -> Column:
    """First dimension column that breaks a length or NOT NULL rule, or NULL."""
    return _violation(GPU_LENGTHS, GPU_REQUIRED)


def sample_violation() -> Column:
    """First fact column that breaks a length or NOT NULL rule, or NULL."""
    return _violation(SAMPLE_LENGTHS, SAMPLE_REQUIRED)


def with_times(records: DataFrame) -> DataFrame:
    """Timestamps of the two nanosecond fields."""
    return records.withColumns({
        "ingested_at": ns_to_timestamp(F.col("ingested_unix_ns")),
        "sample_at": ns_to_timestamp(F.col("sample_unix_ns")),
    })


class Checked(NamedTuple):
    """A batch after its column checks.

    ``devices`` feed the dimension, ``samples`` the facts. A row whose device fails
    reaches neither; a row whose sample fails still updates its device.
    """

    devices: DataFrame
    samples: DataFrame
    dead_letter: DataFrame


def check_records(timed: DataFrame) -> Checked:
    """Apply the column rules to records that carry timestamps."""
    marked = timed.withColumns({"_device": device_violation(), "_sample": sample_violation()})
    lengths = {**SAMPLE_LENGTHS, **GPU_LENGTHS}
    # A text in a device or sample passed its own check, so cutting at the limit only drops blanks.
    devices = marked.where(F.col("_device").isNull())
    samples = devices.where(F.col("_sample").isNull())
    devices = devices.withColumns({name: clipped(F.col(name), most) for name, most in GPU_LENGTHS.items()})
    samples = samples.withColumns({name: clipped(F.col(name), most) for name, most in lengths.items()})
    dead = (
        marked.withColumn("reason", F.coalesce("_device", "_sample"))
        .where(F.col("reason").isNotNull())
        .drop("_device", "_sample")
    )
    return Checked(devices.drop("_device", "_sample"), samples.drop("_device", "_sample"), dead)
