"""Which producer owns a row and which log partition it goes to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.operators.numbering import number_rows
from rackpulse.operators.records import Split


def owned_by(rows: DataFrame, index: int, total: int) -> DataFrame:
    """The rows that producer ``index`` of ``total`` sends."""
    return rows.where(F.col("row_num") % total == index)


def tag_partition(rows: DataFrame, total: int) -> DataFrame:
    """Every row with its producer's partition, all producers at once."""
    return rows.withColumn("partition", (F.col("row_num") % total).cast("int"))


def known_topics(messages: DataFrame, topics: DataFrame) -> Split:
    """Messages of a topic that exists; no topic or an unknown one is refused.

    ``topics`` has one row per topic, so the left join adds no rows; Spark
    broadcasts it if its measured size allows.
    """
    marked = messages.join(topics.select("topic", F.lit(True).alias("_known")), "topic", "left").withColumn(
        "reason",
        F.when(F.coalesce(F.col("topic"), F.lit("")) == "", "topic_missing")
        .when(F.col("_known").isNull(), "topic_unknown"),
    ).drop("_known")
    return Split(marked.where(F.col("reason").isNull()).drop("reason"),
                 marked.where(F.col("reason").isNotNull()))


def named_members(members: DataFrame) -> Split:
    """Consumers with a name; a missing or empty ``consumer_id`` is refused."""
    named = F.coalesce(F.col("consumer_id"), F.lit("")) != ""
    return Split(members.where(named), members.where(~named).withColumn("reason", F.lit("consumer_id_missing")))


def route(messages: DataFrame, partitions: int, arrival: str) -> Split:
    """Resolve the asked partition ``partition``.

    0..partitions-1 stays, a negative one goes round robin in arrival order per
    topic, anything above is refused, and so is a message to spread that has no topic or
    no arrival. ``arrival`` is unique per topic. Accepted and refused rows add up to the input.
    """
    asks = F.coalesce(F.col("partition") < 0, F.lit(False))
    lacks = F.when(F.col("topic").isNull(), "topic_missing").when(F.col(arrival).isNull(), "arrival_missing")
    turn = number_rows(messages.where(asks & lacks.isNull()), ["topic"], arrival, "_turn")
    spread = turn.withColumn("partition", F.pmod("_turn", F.lit(partitions)).cast("int")).drop("_turn")
    placed = in_partitions(messages.where(~asks), partitions)
    refused = messages.where(asks & lacks.isNotNull()).withColumn("reason", lacks)
    return Split(placed.good.unionByName(spread), placed.dead_letter.unionByName(refused))


def in_partitions(messages: DataFrame, partitions: int) -> Split:
    """Messages for partition 0..partitions-1; any other is refused."""
    exists = F.coalesce(F.col("partition").between(0, partitions - 1), F.lit(False))
    refused = messages.where(~exists).withColumn("reason", F.lit("partition_unknown"))
    return Split(messages.where(exists), refused)


def partition_load(messages: DataFrame) -> DataFrame:
    """Messages per partition."""
    return messages.groupBy("partition").agg(F.count("*").alias("messages"))
