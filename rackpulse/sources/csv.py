"""The exporter's CSV files as a batch or streaming source, and their row numbers."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackpulse.operators.sizes import written
from rackpulse.schemas import CORRUPT, RAW_CSV_SCAN

# Doubled quotes inside a quoted field; rows of another width are kept and marked. A row's
# width is only checked if the reader splits all of its columns.
OPTIONS = {
    "header": "true", "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
    "columnPruning": "false",
}
_BLOCK = ["_file", "_start"]


class Forms(NamedTuple):
    """Files by how they are read: line by line, or by quoted records; of the latter those with an open quote."""

    plain: list[str]
    whole: list[str]
    unclosed: list[str]


def split_by_form(spark: SparkSession, path: str) -> Forms:
    """Look at the quotes and blanks of every line.

    A line with an odd number of quotes is part of a longer record. A line of blanks is
    a record too short, which the reader of plain lines passes over. One narrow pass over
    the lines finds the files that hold either; usually there are none. An odd number of
    quotes in a file leaves its last record open.
    """
    line = F.col("value")
    quotes = _quotes(line)
    whole = (quotes % 2 == 1) | ((F.trim(line) == "") & (line != ""))
    lines = spark.read.text(path)
    marked = lines.where(whole).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.sum(quotes % 2).alias("odd"))
    found = {unquote(row["file"]): row["odd"] % 2 == 1 for row in marked.collect()}
    if not found:
        return Forms([path], [], [])
    # Local files are named with one or three slashes.
    known = {name.replace(":///", ":/", 1) for name in found}
    plain = [name for name in map(unquote, lines.inputFiles()) if name.replace(":///", ":/", 1) not in known]
    return Forms(plain, sorted(found), sorted(name for name, odd in found.items() if odd))


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _forms(spark: SparkSession, path: str, multiline: bool | None) -> Forms:
    if multiline is None:
        return split_by_form(spark, path)
    return Forms([], [path], []) if multiline else Forms([path], [], [])


class Records(NamedTuple):
    """Parsed rows with their place (``_file``, ``_start``, ``_id``), and files that this cannot read."""

    rows: DataFrame
    bare: list[str]


def quoted_records(spark: SparkSession, paths: list[str]) -> Records:
    """The records of files whose quoted fields hold line breaks, read in splits.

    Whether a split begins inside a quoted field follows from the number of quotes in
    the splits before it: one narrow pass counts them per split, and a running parity
    over that small table gives every split its state. Within a split a line begins a
    record if the quotes before it are even. What a split's last record has in later
    splits is put back behind it; that is at most one piece per split and file. The
    lines are shuffled once, by split, and the records written once.

    Fields must be quoted whole and records must end in ``\\n`` or ``\\r\\n``, which inside a
    field is kept as ``\\n``. Files with a quote inside an unquoted field, or with other line
    ends, are named in ``bare``.
    """
    lines = spark.read.text(paths, lineSep="\n").select(
        F.regexp_replace("value", r"\r\z", "").alias("value"), (_quotes(F.col("value")) % 2).alias("_odd"),
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    states = written(
        lines.groupBy(*_BLOCK).agg(F.sum("_odd").alias("_sum"))
        .select(*_BLOCK, (F.coalesce(F.sum("_sum").over(before), F.lit(0)) % 2).alias("_state")),
        "states",
    )
    # As many rows as splits, a list the driver already holds to plan the scan.
    held = lines.join(F.broadcast(states), _BLOCK)
    upto = Window.partitionBy(*_BLOCK).orderBy("_line")
    inside = (F.col("_state") + F.sum("_odd").over(upto) - F.col("_odd")) % 2
    begun = held.withColumn("_begins", F.when(inside == 0, 1).otherwise(0)).withColumn("_record", F.sum("_begins").over(upto))
    parts = begun.groupBy(*_BLOCK, "_record").agg(_joined("_line", "value").alias("text"))
    by_record, split = Window.partitionBy(*_BLOCK).orderBy("_record"), Window.partitionBy(*_BLOCK)
    counted = F.sum(F.when((F.col("_record") > 0) & (F.col("text") != ""), 1).otherwise(0)).over(by_record)
    parts = written(parts.withColumn("_id", counted).withColumn("_tail", F.col("_record") == F.max("_record").over(split)), "records")

    edges = parts.where("_record = 0 or _tail")
    in_file = Window.partitionBy("_file").orderBy("_start", "_record")
    owner = F.sum(F.when(F.col("_record") > 0, 1).otherwise(0)).over(in_file)
    place = F.struct("_start", "_record", "_id")
    mended = edges.withColumn("_owner", owner).groupBy("_file", "_owner").agg(
        F.min(place).alias("_first"), _joined(["_start", "_record"], "text").alias("text")
    ).select("_file", "_first._start", "_first._id", "text")
    whole = parts.where("_record > 0 and not _tail").select("_file", "_start", "_id", "text").unionByName(mended)
    # The first record of a file is its header.
    whole = whole.where("text != '' and not (_start = 0 and _id = 1)")
    unquoted = F.regexp_replace(F.replace("text", F.lit('""'), F.lit("")), r'(^|,)"[^"]*"(?=,|\z)', "$1")
    open_end = _quotes(F.col("text")) % 2 == 1
    odd = whole.where(~open_end & unquoted.rlike('["\r]')).select("_file").distinct()
    bare = sorted(unquote(row["_file"]) for row in odd.collect())
    if bare:
        whole = whole.where(~F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B"))).isin(bare))
    options = {name: value for name, value in OPTIONS.items() if name != "header"}
    fields = F.from_csv("text", RAW_CSV_SCAN.toDDL(), {**options, "multiLine": "true"})
    rows = whole.select("_file", "_start", "_id", "text", fields.alias("_row")).select("*", "_row.*").withColumn(
        CORRUPT, F.when(open_end, F.coalesce(CORRUPT, "text")).otherwise(F.col(CORRUPT))
    )
    return Records(rows.select(*_BLOCK, "_id", *RAW_CSV_SCAN.names), bare)


def _joined(order: str | list[str], text: str) -> Column:
    """The texts of a group as lines, in the order of a column or several."""
    columns = [order] if isinstance(order, str) else order
    lines = F.array_sort(F.collect_list(F.struct(*columns, text)))
    return F.concat_ws("\n", F.transform(lines, lambda line: line[text]))


class _Parts(NamedTuple):
    """Scans of the files that Spark's reader takes, cheaper ones for counting, and quoted records."""

    scans: list[DataFrame]
    counted: list[DataFrame]
    records: list[DataFrame]


def _scan(spark: SparkSession, paths: list[str], whole: bool, pruned: bool = False) -> list[DataFrame]:
    """Counting needs no column, so the scan for it may skip the parsing (``pruned``)."""
    if not paths:
        return []
    options = {**OPTIONS, "columnPruning": str(pruned).lower(), "multiLine": str(whole).lower()}
    return [spark.read.schema(RAW_CSV_SCAN).options(**options).csv(paths)]


def _parts(spark: SparkSession, forms: Forms) -> _Parts:
    records, bare = [], []
    if forms.whole:
        found = quoted_records(spark, forms.whole)
        records, bare = [found.rows], found.bare
    both = [_scan(spark, forms.plain, False, pruned) + _scan(spark, bare, True, pruned) for pruned in (False, True)]
    return _Parts(*both, records)


def read_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """Twelve text columns and ``_corrupt``, which is set on a row of another width.

    Quoted line breaks are kept, and a record whose quote is never closed is corrupt.
    Files that hold any of these are read in splits by ``quoted_records``; ``multiline``
    says so for all files, or for none, without the look beforehand. Only a file with quotes
    inside unquoted fields is parsed by one task, which takes an open quote to the end of the file.
    """
    parts = _parts(spark, _forms(spark, path, multiline))
    return reduce(DataFrame.unionByName, [*parts.scans, *(rows.select(*RAW_CSV_SCAN.names) for rows in parts.records)])


def stream_csv(spark: SparkSession, path: str, max_files: int = 1000, with_times: bool = False) -> DataFrame:
    """The same rows from files as they arrive in a folder, with their ``_file``.

    ``with_times`` adds when it was ``_modified``. A file is the unit of a stream and is parsed as a whole, so quoted line breaks are kept.
    """
    rows = (
        spark.readStream.schema(RAW_CSV_SCAN).options(**OPTIONS)
        .option("maxFilesPerTrigger", max_files).option("multiLine", True).csv(path)
    )
    times = [F.col("_metadata.file_modification_time").alias("_modified")] if with_times else []
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), *times)


def read_numbered_csv(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """``read_csv`` with the ``row_num`` of ``with_row_numbers``."""
    return with_row_numbers(*_parts(spark, _forms(spark, path, multiline)))


def _placed(scans: list[DataFrame], records: list[DataFrame]) -> DataFrame:
    placed = [
        scan.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_id"),
        ) for scan in scans
    ]
    return reduce(DataFrame.unionByName, placed + records)


def with_row_numbers(scans: list[DataFrame], counted: list[DataFrame] | None = None,
                     records: list[DataFrame] | None = None) -> DataFrame:
    """0-based ``row_num`` over all data rows, in file name and file order.

    A narrow first pass counts the rows of each input split; the second adds the
    rows of all splits before. ``monotonically_increasing_id`` gives the place
    inside a task, and both passes read the same splits. The count table has one
    row per split; it is written once and broadcast, as the driver's own list of splits
    bounds it. ``counted`` may be cheaper scans of the same files for the first pass.
    ``records`` have their place already (``quoted_records``).
    """
    records = records or []
    earlier = Window.orderBy(*_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = written(
        _placed(counted or scans, records).groupBy(*_BLOCK)
        .agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
        .select(*_BLOCK, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")),
        "splits",
    )
    rows = _placed(scans, records).join(F.broadcast(blocks), _BLOCK)
    return rows.select((F.col("_id") + F.col("_shift")).alias("row_num"), *RAW_CSV_SCAN.names)
