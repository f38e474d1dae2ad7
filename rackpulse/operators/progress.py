"""Offsets, retention and consumer progress over the partitioned log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.operators.numbering import number_rows
from rackpulse.operators.sizes import written
from rackpulse.schemas import DEFAULT_CAPACITY, LOG_KEY, PROGRESS_KEY, SEGMENT

# Partitions whose bounds are written into a plan as filters.
MOST_BOUNDS = 256


def heads(log: DataFrame, capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """Next offset and oldest readable offset of each partition."""
    return (
        log.groupBy(*LOG_KEY)
        .agg((F.max("offset") + 1).alias("head"))
        .withColumn("tail", F.greatest(F.lit(0).cast("bigint"), F.col("head") - capacity))
    )


def assign_offsets(messages: DataFrame, arrival: str | list[str], log_heads: DataFrame | None = None) -> DataFrame:
    """Dense offsets per partition in arrival order, going on from ``log_heads``."""
    numbered = number_rows(messages, LOG_KEY, arrival, "offset")
    if log_heads is None:
        return numbered
    start = log_heads.select(
        F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), F.col("head").alias("_head")
    )
    same = F.col("topic").eqNullSafe(F.col("_topic")) & F.col("partition").eqNullSafe(F.col("_partition"))
    return numbered.join(start, same, "left").withColumn(
        "offset", F.col("offset") + F.coalesce("_head", F.lit(0))
    ).drop("_topic", "_partition", "_head")


def next_offset(log: DataFrame) -> DataFrame:
    """One row: the offset after the highest one in ``log``, 0 for an empty log."""
    return log.agg(F.coalesce(F.max("offset") + 1, F.lit(0).cast("bigint")).alias("next_offset"))


def _reading_on(log: DataFrame, bounds: DataFrame, bound: str) -> DataFrame:
    """Log rows joined to their partition's bound, from that offset on.

    The bounds are computed once. The lowest of all partitions is also a plain filter,
    which lets the scan skip old row groups and, in a stored log, old segment folders.
    """
    bounds = written(bounds, "bounds")
    lowest = bounds.agg(F.min(bound)).first()[0]
    if lowest is not None:
        log = log.where(F.col("offset") >= lowest)
        if "segment" in log.columns:
            log = log.where(F.col("segment") >= lowest // SEGMENT)
    return log.join(bounds, LOG_KEY).where(F.col("offset") >= F.col(bound))


def retained(log: DataFrame, log_heads: DataFrame) -> DataFrame:
    """Messages whose offset is not below its partition's tail."""
    return _reading_on(log, log_heads, "tail").select(*log.columns)


def offset_class(offsets: DataFrame, log_heads: DataFrame) -> DataFrame:
    """``too_old``, ``ok`` or ``future`` for each asked offset.

    A partition without messages has head and tail 0, so all its offsets are future.
    """
    zero = F.lit(0).cast("bigint")
    joined = offsets.join(written(log_heads, "heads"), LOG_KEY, "left")
    return joined.select(
        *offsets.columns,
        F.when(F.col("offset") < F.coalesce("tail", zero), "too_old")
        .when(F.col("offset") >= F.coalesce("head", zero), "future")
        .otherwise("ok").alias("read_class"),
    )


def committed(acks: DataFrame) -> DataFrame:
    """Highest acknowledged offset; late and repeated acks change nothing."""
    return acks.groupBy(*PROGRESS_KEY).agg(F.max("offset").alias("committed"))


def committed_map(commits: DataFrame, asked: DataFrame) -> DataFrame:
    """Per asked (topic, group) a map partition -> committed, empty if there is none.

    A map holds one entry per log partition, never one per message.
    """
    maps = commits.groupBy("topic", "consumer_group").agg(
        F.map_from_entries(F.collect_list(F.struct("partition", "committed"))).alias("offsets")
    )
    empty = F.create_map().cast("map<int,bigint>")
    return asked.join(maps, ["topic", "consumer_group"], "left").withColumn(
        "offsets", F.coalesce("offsets", empty)
    )


def starts(commits: DataFrame, log_heads: DataFrame, topic: str, group: str) -> DataFrame:
    """Where one group reads on in each partition, and what it has lost.

    ``start`` is the offset after the committed one, or the tail if that has moved
    past it; ``lost`` counts the offsets in between.
    """
    mine = commits.where((F.col("topic") == topic) & (F.col("consumer_group") == group))
    resume = F.coalesce(F.col("committed") + 1, F.lit(0).cast("bigint"))
    return (
        log_heads.where(F.col("topic") == topic)
        .join(mine.select(*LOG_KEY, "committed"), LOG_KEY, "left")
        .select(
            *LOG_KEY, "head", "tail", resume.alias("resume"),
            F.greatest(resume, "tail").alias("start"),
            F.greatest(F.col("tail") - resume, F.lit(0).cast("bigint")).alias("lost"),
        )
    )


def resume(log: DataFrame, commits: DataFrame, topic: str, group: str) -> DataFrame:
    """Log rows after the group's committed offset, from 0 where it has none.

    Segments that lie before the commits of all partitions are not opened.
    """
    mine = commits.where((F.col("topic") == topic) & (F.col("consumer_group") == group))
    done = written(mine.select(*LOG_KEY, F.col("committed").alias("_done")), "commits")
    log = log.where(F.col("topic") == topic)
    columns = log.columns
    if "segment" in columns:
        # One filter per partition with a commit: its older segments are skipped. More
        # partitions than a plan should list are bounded by the join alone, as one without
        # a commit is read from its first segment.
        known = done.where("_done is not null").limit(MOST_BOUNDS + 1).collect()
        if len(known) <= MOST_BOUNDS:
            for row in known:
                log = log.where((F.col("partition") != row["partition"]) | (F.col("segment") >= (row["_done"] + 1) // SEGMENT))
    return log.join(done, LOG_KEY, "left").where(F.col("offset") > F.coalesce("_done", F.lit(-1))).select(*columns)


def fair_poll(log: DataFrame, group_starts: DataFrame) -> DataFrame:
    """Readable messages with the poll round that delivers them.

    A round takes one message of every partition. A partition whose cursor had
    fallen behind spends its first round on the jump to the tail.
    """
    start = group_starts.select(
        *LOG_KEY, "start", F.when(F.col("lost") > 0, 1).otherwise(0).alias("_jump")
    )
    return _reading_on(log, start, "start").withColumn(
        "poll_round", F.col("offset") - F.col("start") + F.col("_jump")
    ).select("poll_round", *log.columns)


def failed_messages(failed: DataFrame, commits: DataFrame) -> DataFrame:
    """Failed messages with ``skipped``: true if a later commit passed them for good."""
    done = written(commits, "commits")
    return failed.join(done, PROGRESS_KEY, "left").select(
        *failed.columns, F.coalesce(F.col("offset") <= F.col("committed"), F.lit(False)).alias("skipped")
    )


def skipped_forever(failed: DataFrame, commits: DataFrame) -> DataFrame:
    """Failed messages that will not be delivered again."""
    return failed_messages(failed, commits).where("skipped").drop("skipped")


def will_retry(failed: DataFrame, commits: DataFrame) -> DataFrame:
    """Failed messages that the group will read again when it reconnects."""
    return failed_messages(failed, commits).where(~F.col("skipped")).drop("skipped")
