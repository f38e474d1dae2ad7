"""Helpers the operators share: stored steps, word hashes, buckets, connected groups."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackpulse.session import scratch_dir

# A side may be broadcast up to this many narrow rows (about 16 bytes each); beyond
# it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000
# Buckets up to this size are compared pair by pair, larger ones through a leader.
SMALL_BUCKET = 8
# Rows per partition where they are dealt by bucket before they are counted.
DEALT_ROWS = 500_000

_SLICE = 1 << 18
# Documents that a task takes at once out of a batch.
PART = 500
# Rows of the batches in which Spark hands texts to Python; its own default is 10,000.
BATCH_ROWS = 1000
_U64 = np.uint64
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x61:0x7B] = _WORD_BYTE[0x80:] = True
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, _U64))
# What two bytes side by side add to a hash; the second one nothing if it ends the word.
_FIRST, _SECOND = np.arange(1 << 16) & 255, np.arange(1 << 16) >> 8
_PAIRS = (_FIRST + 1).astype(_U64) + np.where(_WORD_BYTE[_SECOND], _SECOND + 1, 0).astype(_U64) * _POWERS[0]
# Words up to so many bytes are hashed side by side.
_SHORT = 64


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage safely."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps its Python workers, and their peaks with them."""
    gc.collect()
    with suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Let the session hand at most ``BATCH_ROWS`` rows to Python at once; a smaller setting stays.

    The buffers of a batch lie outside the heap and double until it fits, in each task,
    and what is freed of them stays with the executor. A job with several steps on long
    texts calls this; the rows of no operator here depend on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def parts_of(batches: Iterator[pa.RecordBatch], rows: int = PART) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of few rows, so what a task makes of them stays small."""
    for whole in batches:
        for low in range(0, whole.num_rows, rows):
            yield whole.slice(low, rows)


def small_side(side: DataFrame, rows: int) -> DataFrame:
    """``side`` with a broadcast hint if its counted ``rows`` stay below the bound."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def mix64(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    values = (values ^ (values >> _U64(31))) * _U64(0x7FB5D329728EA185)
    values = (values ^ (values >> _U64(27))) * _U64(0x81DADEF4BC2DD44D)
    return values ^ (values >> _U64(33))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of all spans, one after another."""
    before = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def byte_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans that follow each other without a gap in ``raw``."""
    place = np.arange(len(raw), dtype=np.int64) - np.repeat(starts, lengths)
    terms = (raw.astype(_U64) + _U64(1)) * _POWERS[place & 4095]
    return mix64(np.add.reduceat(terms, starts))


def side_by_side(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``byte_hashes`` of the words at ``starts``, with a byte that is in no word behind each.

    All words take their next two bytes at once, the longer ones first in order, so a
    step works on a head of the arrays. Words beyond ``_SHORT`` bytes go byte by byte.
    """
    key = (_SHORT + 1 - np.minimum(lengths, _SHORT + 1)).astype(np.uint8)
    order = np.argsort(key, kind="stable")
    beyond = np.cumsum(np.bincount(key, minlength=_SHORT + 1))  # of words longer than _SHORT - place
    out = np.empty(len(starts), _U64)
    long, order = order[:beyond[0]], order[beyond[0]:]
    if len(long):
        size = lengths[long]
        out[long] = byte_hashes(raw[spread(starts[long], size)], np.cumsum(size) - size, size)
    at, sums = starts[order], np.zeros(len(order), _U64)
    pairs = raw[:-1] | raw[1:].astype(np.uint16) << 8
    for place in range(0, _SHORT, 2):
        held = beyond[_SHORT - place] - len(long)
        if not held:
            break
        sums[:held] += _PAIRS.take(pairs.take(at[:held] + place)) * _POWERS[place]
    out[order] = mix64(sums)
    return out


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and where each text's words begin."""
    hashes, first, _ = _words(texts, False)
    return hashes, first


def sized_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, where each text's words begin, characters per word.

    A word is a run of letters, digits or non-ASCII characters. Text ``i`` owns
    ``hashes[first[i]:first[i + 1]]``. Null and empty texts own none. The work goes
    over slices of a quarter MB, so the extra memory does not follow the input.
    """
    return _words(texts, True)


def _words(texts: list[str | None], sized: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``sized_words``, without the characters if they are not asked for."""
    hashes, counts, sizes = [], [], []
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < _SLICE):
            part.append((texts[at] or "").lower().encode())
            size += len(part[-1])
            at += 1
        raw = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        inside = _WORD_BYTE.take(raw)
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
        ends = np.cumsum([len(text) + 1 for text in part])
        counts.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        if len(starts):
            # The line feed behind a text ends its last word.
            hashes.append(side_by_side(raw, starts, lengths))
            if sized:
                held, begin = raw[inside], np.cumsum(lengths) - lengths
                sizes.append(np.add.reduceat((held & 0xC0) != 0x80, begin, dtype=np.int64))
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    if not hashes:
        return np.empty(0, _U64), first, np.empty(0, np.int64)
    return np.concatenate(hashes), first, np.concatenate(sizes) if sized else np.empty(0, np.int64)


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word windows.

    A text with fewer words has one window of all its words; one without words none.
    """
    words, first = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - width + 1), _U64)
    for step in range(width):
        rolled = rolled * _U64(0xD6E8FEB86659FD93) + words[step:step + len(rolled)]
    rolled = mix64(rolled)
    for low, high in zip(first[:-1], first[1:], strict=True):
        if high - low >= width:
            yield np.unique(rolled[low:high - width + 1])
        elif high > low:
            value = _U64(high - low)
            with np.errstate(over="ignore"):
                for word in words[low:high]:
                    value = value * _U64(0xD6E8FEB86659FD93) + word
            yield mix64(np.array([value], _U64))
        else:
            yield np.empty(0, _U64)


class Buckets(NamedTuple):
    """What the buckets with at least two nodes say.

    ``pairs`` are the two nodes of each bucket that holds just two; ``members`` are the
    rows of the larger ones, with the bucket's size and its leader.
    """

    pairs: DataFrame
    members: DataFrame


def buckets_of(rows: DataFrame, expected: int | None = None) -> Buckets:
    """Group ``rows`` (``band``, ``key``, ``node``, ``weight``; a node once per bucket) by band and key.

    A bucket is named by a hash of both. Counting combines before the shuffle and keeps
    three numbers per bucket, so buckets of one or two nodes, which are nearly all, are
    settled by that one narrow shuffle. Where nearly all buckets hold one node, combining
    only spills: given the number of rows as ``expected``, two numbers per row are dealt
    into partitions of about half a million rows and counted there. Only the larger ones are looked up again, by a
    broadcast of their names if their count allows. The leader is the node with the
    smallest hash in its bucket, so a large group has other leaders in other bands.
    """
    named = rows.select(F.xxhash64("band", "key").alias("bucket"), "node", "weight")
    counted = named.select("bucket", "node")
    if expected is not None:
        least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        counted = counted.repartition(max(least, -(-expected // DEALT_ROWS)), "bucket")
    counts = [F.count("*").alias("held"), F.min("node").alias("a"), F.max("node").alias("b")]
    held = stored(counted.groupBy("bucket").agg(*counts).where("held > 1"), "buckets")
    large = held.where("held > 2").select("bucket", "held")
    members = stored(named.join(small_side(large, large.count()), "bucket"), "members")
    lead = members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", "bucket"), "node", "weight")).alias("lead"))
    led = members.join(lead, "bucket").select(
        "bucket", "node", "weight", "held", F.col("lead.node").alias("leader"), F.col("lead.weight").alias("leader_weight")
    )
    return Buckets(held.where("held = 2 and a < b").select("a", "b").distinct(), stored(led, "members"))


def pairs_inside(members: DataFrame, fits) -> DataFrame:
    """The fitting pairs ``a < b`` of small buckets, found inside each bucket's array of members.

    A pair that does not fit never becomes a row, so buckets that were met by chance,
    whose number grows faster than the rows where keys are short, cost their members only.
    """
    held = members.groupBy("bucket").agg(F.collect_list(F.struct("node", "weight")).alias("held"))

    def partners(one):
        fitting = F.filter("held", lambda other: (one["node"] < other["node"]) & fits(one["weight"], other["weight"]))
        return F.transform(fitting, lambda other: F.struct(one["node"].alias("a"), other["node"].alias("b")))

    return held.select(F.explode(F.flatten(F.transform("held", partners))).alias("pair")).select("pair.a", "pair.b")


def first_pairs(buckets: Buckets, weights: DataFrame, fits, inside: bool = False) -> DataFrame:
    """Candidate pairs ``a < b``: all pairs of small buckets, leader pairs of large ones.

    ``weights`` maps ``node`` to ``weight``; ``fits(left, right)`` says whether two weights
    can belong to a match at all. The pairs grow in proportion to the members. With
    ``inside`` they are screened before they are rows, for keys that many rows share by chance.
    """
    members = buckets.members
    left = weights.select(F.col("node").alias("a"), F.col("weight").alias("weight_a"))
    right = weights.select(F.col("node").alias("b"), F.col("weight").alias("weight_b"))
    twos = buckets.pairs.join(left, "a").join(right, "b").where(
        fits(F.col("weight_a"), F.col("weight_b"))
    ).select("a", "b")
    led = members.where((F.col("held") > SMALL_BUCKET) & (F.col("node") != F.col("leader"))).where(
        fits(F.col("weight"), F.col("leader_weight"))
    ).select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    small = members.where(F.col("held") <= SMALL_BUCKET).select("bucket", "node", "weight")
    if inside:
        return twos.unionByName(led).unionByName(pairs_inside(small, fits)).distinct()
    other = small.select("bucket", F.col("node").alias("other"), F.col("weight").alias("other_weight"))
    paired = small.join(other, "bucket").where(F.col("node") < F.col("other")).where(
        fits(F.col("weight"), F.col("other_weight"))
    ).select(F.col("node").alias("a"), F.col("other").alias("b"))
    return twos.unionByName(led).unionByName(paired).distinct()


def stray_pairs(buckets: Buckets, groups: DataFrame, fits) -> DataFrame:
    """The pairs of large buckets that can still join two groups.

    ``groups`` maps ``node`` to ``root`` after the first pairs were verified. Where a
    member is not in its leader's group, it is paired with all members of the bucket
    that are in another group than its own. Pairs inside a group change nothing.
    """
    large = buckets.members.where(F.col("held") > SMALL_BUCKET)
    of_leader = groups.select(F.col("node").alias("leader"), F.col("root").alias("leader_root"))
    placed = (
        large.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
        .join(of_leader, "leader", "left")
        .withColumn("leader_root", F.coalesce("leader_root", "leader"))
        .select("bucket", "node", "weight", "root", "leader_root")
    )
    stray = placed.where("root != leader_root").select(
        "bucket", F.col("node").alias("stray"), F.col("weight").alias("stray_weight"), F.col("root").alias("stray_root"),
    )
    return (
        stray.join(placed, "bucket").where(F.col("root") != F.col("stray_root"))
        .where(fits(F.col("weight"), F.col("stray_weight")))
        .select(F.least("node", "stray").alias("a"), F.greatest("node", "stray").alias("b")).distinct()
    )


def ends(pairs: DataFrame) -> DataFrame:
    """The distinct nodes of some pairs, as ``node``."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def linked_groups(buckets: Buckets, weights: DataFrame, fits, check, name: str) -> tuple[DataFrame, DataFrame]:
    """Verified edges and the groups they connect.

    ``check(pairs, nodes)`` returns the pairs that hold; ``nodes`` are their ends.
    """
    pairs = stored(first_pairs(buckets, weights, fits, inside=True), "pairs")
    edges = stored(check(pairs, ends(pairs)), "links")
    groups = connected(edges, name)
    more = stored(stray_pairs(buckets, groups, fits).join(pairs, ["a", "b"], "left_anti"), "strays")
    if more.head(1):
        further = stored(check(more, ends(more)), "links")
        edges = edges.unionByName(further)
        # The groups stand for the edges that made them.
        grown = groups.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(further.select("a", "b"))
        groups = connected(grown, name)
    return edges, groups


def connected(edges: DataFrame, name: str) -> DataFrame:
    """``node`` -> ``root``, the smallest node it is connected with; only nodes with an edge.

    Alternates two rewirings until all edges are stars: each node hands its larger
    neighbours, then its smaller ones, to its smallest neighbour. Rounds grow with the
    logarithm of the longest path. Every round is written to the shared folder; the
    driver sees one row a round.
    """
    now = stored(
        edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name
    )
    # a is the smaller end throughout.
    while _tangled(now).head(1):
        least = _both_ways(now).groupBy("node").agg(F.least(F.min("other"), "node").alias("low"))
        large = now.join(least.withColumnRenamed("node", "a"), "a").select(F.col("low").alias("a"), "b")
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b")
        now = stored(
            small.select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a != b").distinct(), name
        )
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _both_ways(edges: DataFrame) -> DataFrame:
    """``node`` and ``other`` of each edge from either end, in one pass over the edges."""
    ways = [F.struct(F.col(one).alias("node"), F.col(two).alias("other")) for one, two in ("ab", "ba")]
    return edges.select(F.inline(F.array(*ways)))


def _tangled(edges: DataFrame) -> DataFrame:
    """Nodes that keep the edges from being stars: below two others, or below one and above one."""
    below = F.col("node") > F.col("other")
    uses = _both_ways(edges).groupBy("node").agg(F.count_if(~below).alias("above"), F.count_if(below).alias("below"))
    return uses.where("below > 1 or (above > 0 and below > 0)")
