"""A consumer group's subscription to the stored log as a stream, with offsets per log partition."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from rackpulse.operators.progress import starts
from rackpulse.schemas import MESSAGE_LOG, SEGMENT

FORMAT = "rackpulse_log"
# An input partition of the stream holds at most so many offsets.
SLICE = 1 << 18

# The classes travel to the planning and reading processes by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Held:
    """The files of one log partition that were seen, and how far they reach without a gap."""

    head: int
    files: dict[str, tuple[int, int]] = field(default_factory=dict)

    def advance(self, heads: set[int]) -> None:
        """Move ``head`` to the end of what can be read.

        A file holds one dense range of offsets, but the files of an append become
        visible one by one, so only ranges that join are taken. Offsets of an append that
        died are never written: they are passed over once a later append, which begins
        where the dead one would have ended (``heads``), shows its first file.
        """
        ranges = sorted(self.files.values())
        begins = {low for low, _ in ranges}
        while True:
            before = self.head
            for low, high in ranges:
                if low <= self.head <= high:
                    self.head = high + 1
            if self.head == before:
                later = [head for head in heads & begins if head > self.head]
                if not later:
                    return
                self.head = min(later)


@dataclass
class Slice(InputPartition):
    """Offsets ``low`` to ``high - 1`` of one log partition and the files that hold them."""

    partition: int
    low: int
    high: int
    files: list[str]


def _opened(path: str) -> tuple[object, str]:
    """The file system of a path and its place there; ``file:/x`` and ``/x`` are local."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class LogReader(DataSourceStreamReader):
    """Plans from folder names and file footers; only ``read`` opens messages."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.topic = options["path"].rstrip("/"), options["topic"]
        self.first = {int(name): int(value) for name, value in json.loads(options.get("start", "{}")).items()}
        self.schema, self.names = schema, schema.names
        self.held: dict[int, Held] = {}
        self.manifest: dict[str, dict[int, set[int]]] = {}

    def _files(self, folder: str) -> tuple[object, list]:
        from pyarrow import fs

        system, base = _opened(folder)
        return system, system.get_file_info(fs.FileSelector(base, recursive=False, allow_not_found=True))

    def _folders(self, folder: str, name: str) -> dict[int, str]:
        """Number -> path of the folders ``name=number``."""
        _, infos = self._files(folder)
        found = (info.base_name.partition("=") for info in infos if not info.is_file)
        return {int(value): f"{folder}/{key}={value}" for key, _, value in found if key == name and value.isdigit()}

    def _heads(self) -> dict[int, set[int]]:
        """All heads that appends have announced, by log partition; files are read once."""
        import pyarrow.parquet as pq

        system, infos = self._files(f"{self.path}_heads")
        for info in infos:
            if info.is_file and info.base_name.endswith(".parquet") and info.path not in self.manifest:
                heads: dict[int, set[int]] = {}
                for row in pq.read_table(info.path, filesystem=system).to_pylist():
                    if row["topic"] == self.topic:
                        heads.setdefault(row["partition"], set()).add(row["head"])
                self.manifest[info.path] = heads
        merged: dict[int, set[int]] = {}
        for heads in self.manifest.values():
            for partition, some in heads.items():
                merged.setdefault(partition, set()).update(some)
        return merged

    def _look(self) -> None:
        """See which files have come; segments behind the head are not listed again."""
        import pyarrow.parquet as pq

        heads = self._heads()
        for partition, folder in self._folders(f"{self.path}/topic={self.topic}", "partition").items():
            held = self.held.setdefault(partition, Held(self.first.get(partition, 0)))
            for segment, inner in self._folders(folder, "segment").items():
                if segment < held.head // SEGMENT:
                    continue
                system, infos = self._files(inner)
                for info in infos:
                    if info.path in held.files or not info.base_name.endswith(".parquet") or info.base_name.startswith(("_", ".")):
                        continue
                    footer = pq.read_metadata(info.path, filesystem=system)
                    column = footer.schema.to_arrow_schema().get_field_index("offset")
                    bounds = [footer.row_group(group).column(column).statistics for group in range(footer.num_row_groups)]
                    if bounds:
                        held.files[info.path] = (min(b.min for b in bounds), max(b.max for b in bounds))
            held.advance(heads.get(partition, set()))

    def initialOffset(self) -> dict:
        self._look()
        return {str(partition): self.first.get(partition, 0) for partition in self.held}

    def latestOffset(self) -> dict:
        self._look()
        return {str(partition): held.head for partition, held in self.held.items()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        """The offsets from ``start`` to ``end`` in slices; a partition that has come since starts at its first."""
        if not self.held:
            self._look()
        slices = []
        for name, high in end.items():
            partition = int(name)
            held = self.held.get(partition, Held(0))
            for low in range(start.get(name, self.first.get(partition, 0)), high, SLICE):
                top = min(low + SLICE, high)
                files = [path for path, (first, last) in held.files.items() if first < top and last >= low]
                if files:
                    slices.append(Slice(partition, low, top, sorted(files)))
        return slices or [Slice(-1, 0, 0, [])]

    def read(self, partition: Slice) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = _opened(self.path)
        stored = [name for name in self.names if name not in ("topic", "partition")]
        # All batches have one schema, whatever rows and nulls they hold.
        schema = to_arrow_schema(self.schema)
        for path in partition.files:
            for batch in pq.ParquetFile(path, filesystem=system).iter_batches(columns=stored):
                offset = batch.column("offset")
                batch = batch.filter(pc.and_(pc.greater_equal(offset, partition.low), pc.less(offset, partition.high)))
                if not len(batch):
                    continue
                places = {"topic": pa.array([self.topic] * len(batch)), "partition": pa.array([partition.partition] * len(batch))}
                columns = [
                    (places[field.name] if field.name in places else batch.column(field.name)).cast(field.type) for field in schema
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


class LogSource(DataSource):
    """``path`` and ``topic`` of a stored log; ``start`` maps partitions to their first offset, as JSON."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return MESSAGE_LOG

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(self.options, schema)


def subscribe(spark: SparkSession, path: str, topic: str, commits: DataFrame, group: str,
              log_heads: DataFrame | None = None) -> DataFrame:
    """The messages of ``topic`` after what ``group`` has committed, and all that follow.

    A partition without a commit starts at 0; with ``log_heads`` none starts below its
    tail. ``commits`` only says where a new query begins: from then on its checkpoint
    holds the next offset of every log partition. The driver sees one number per log
    partition. ``path`` is one that pyarrow opens.
    """
    spark.dataSource.register(LogSource)
    if log_heads is None:
        mine = commits.where((F.col("topic") == topic) & (F.col("consumer_group") == group))
        begin = mine.select("partition", (F.col("committed") + 1).alias("start"))
    else:
        begin = starts(commits, log_heads, topic, group).select("partition", "start")
    first = {str(row["partition"]): row["start"] for row in begin.where("partition is not null").collect()}
    return spark.readStream.format(FORMAT).option("topic", topic).option("start", json.dumps(first)).load(path)
