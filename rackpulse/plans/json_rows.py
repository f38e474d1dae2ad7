"""One JSON text per result row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackpulse.functions.numbers import is_finite
from rackpulse.functions.text import null_if_empty
from rackpulse.functions.time import rfc3339_text
from rackpulse.plans.queries import NULLABLE_SAMPLE
from rackpulse.schemas import GPUS, TELEMETRY_SAMPLES

_TIMES = {"created_at", "updated_at", "ingested_at", "sample_at"}


def _texts(names: list[str], optional: set[str]) -> Column:
    """JSON of some fields; those that are NULL, or optional and empty, are left out."""
    fields = []
    for name in names:
        column = F.col(name)
        if name in _TIMES:
            column = rfc3339_text(column)
        elif name in optional:
            column = null_if_empty(column)
        fields.append(column.alias(name))
    return F.to_json(F.struct(*fields))


def _joined(*objects: Column) -> Column:
    """One JSON object of the fields of several."""
    inner = [F.substring(text, F.lit(2), F.length(text) - 2) for text in objects]
    return F.concat(F.lit("{"), F.array_join(F.filter(F.array(*inner), lambda text: text != ""), ","), F.lit("}"))


def gpu_json(devices: DataFrame) -> DataFrame:
    """Adds ``json`` with all device fields."""
    return devices.withColumn("json", _texts(GPUS.names, set()))


def sample_json(samples: DataFrame) -> DataFrame:
    """Adds ``json`` with the sample fields; empty optional texts are left out.

    JSON has no NaN or infinity: such a value becomes null.
    """
    names = TELEMETRY_SAMPLES.names
    place = names.index("value")
    number = F.when(is_finite(F.col("value")), F.col("value")).alias("value")
    return samples.withColumn("json", _joined(
        _texts(names[:place], NULLABLE_SAMPLE), F.to_json(F.struct(number), {"ignoreNullFields": "false"}),
        _texts(names[place + 1:], NULLABLE_SAMPLE),
    ))
