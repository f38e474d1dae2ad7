"""Similarity join of documents on word n-grams, by MinHash banding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import (
    SMALL_BUCKET,
    buckets_of,
    connected,
    ends,
    first_pairs,
    give_back,
    mix64,
    parts_of,
    shingle_sets,
    small_side,
    stored,
)
from rackpulse.llm.minmax_dedup import links_of_strays

WIDTH, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.998, 128
# A class is counted in blocks of about so many nodes, and of about so many n-grams.
BLOCK, BLOCK_GRAMS = 256, 250_000

_U64 = np.uint64


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the longest bands that still find ``recall`` of the pairs at the threshold.

    A pair of similarity s shares a band of r rows with probability s**r, and at least
    one of b bands with 1 - (1 - s**r)**b. Longer bands let fewer unlike pairs through.
    """
    best = None
    for rows in range(1, most + 1):
        hit = threshold ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes cannot reach a recall of {recall} at {threshold}")
    return best


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240229)
    multiply = draw.integers(0, 1 << 63, count, dtype=np.uint64) * _U64(2) + _U64(1)
    return multiply, draw.integers(0, 1 << 63, count, dtype=np.uint64)


def band_keys(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band: a hash of the smallest values under its hash functions."""
    multiply, add = _factors(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for low in range(0, len(shingles), 2048):
        part = shingles[low:low + 2048, None] * multiply + add
        np.minimum(least, part.min(axis=0), out=least)
    keys = np.zeros(bands, np.uint64)
    for row in range(rows):
        keys = mix64(keys * _U64(0xC2B2AE3D27D4EB4F) + least.reshape(bands, rows)[:, row])
    return keys


def sketches(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """Per row: ``doc_id``, number of n-grams, two digests of their set, the band keys."""
    schema = "doc_id bigint, grams bigint, digest_a bigint, digest_b bigint, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            texts = batch.column(1).to_pylist()
            size = len(texts)
            grams, digest_a, digest_b = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)
            keys = np.zeros((size, bands), np.uint64)
            for place, held in enumerate(shingle_sets(texts, width)):
                grams[place] = len(held)
                if len(held):
                    digest_a[place] = mix64(held).sum(dtype=np.uint64)
                    digest_b[place] = np.bitwise_xor.reduce(mix64(held + _U64(0x5851F42D4C957F2D)))
                    keys[place] = band_keys(held, bands, rows)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, (size + 1) * bands, bands, dtype=np.int32)), pa.array(keys.view(np.int64).reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(grams), pa.array(digest_a.view(np.int64)), pa.array(digest_b.view(np.int64)), lists],
                ["doc_id", "grams", "digest_a", "digest_b", "keys"],
            )
        give_back()

    rows_of = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_of.mapInArrow(run, schema)


def gram_sets(docs: DataFrame, nodes: DataFrame, count: int, width: int) -> DataFrame:
    """``node`` and its set of n-grams, for the documents named in ``nodes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            sets = [held.view(np.int64) for held in shingle_sets(batch.column(1).to_pylist(), width)]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "grams"]
            )
        give_back()

    wanted = docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text")).join(
        small_side(nodes, count), "node", "left_semi"
    )
    return wanted.mapInArrow(run, "node bigint, grams array<bigint>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full n-gram sets have at least ``threshold`` Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    similarity = shared / (F.size("grams_a") + F.size("grams_b") - shared)
    return pairs.join(left, "a").join(right, "b").select("a", "b", similarity.alias("similarity")).where(
        F.col("similarity") >= threshold
    )


def shared_counts(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many values each set of the first list shares with each of the second."""
    both = [*one, *other]
    sizes = np.array([len(held) for held in both], np.int64)
    out = np.zeros((len(one), len(other)), np.float64)
    if not sizes.sum():
        return out
    _, column, uses = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(both)), sizes)
    # A value of a single set is shared by none.
    often = uses > 1
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(often.sum()), 4096):
        part = slice(*np.searchsorted(column, [low, low + 4096]))
        held = np.zeros((len(both), 4096), np.float32)
        held[row[part], column[part] - low] = 1
        out += held[:len(one)] @ held[len(one):].T
    return out


def alike(one: list[np.ndarray], other: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of two lists have at least ``threshold`` Jaccard similarity."""
    shared = shared_counts(one, other)
    left, right = (np.array([len(held) for held in some], np.float64) for some in (one, other))
    return shared / np.maximum(left[:, None] + right - shared, 1) >= threshold


def counted_links(docs: DataFrame, members: DataFrame, groups: DataFrame, weights: DataFrame, width: int,
                  threshold: float) -> DataFrame | None:
    """``node`` and its number of links, for all classes with nodes of large buckets; None if there are none.

    There the candidates were not all pairs, so all pairs of the class are compared: its
    nodes are dealt to blocks by a hash, each pair of blocks is one task's work, and a
    task gives one count per node. The rows sent are a node's n-grams once per block of
    its class.
    """
    large = members.where(F.col("held") > SMALL_BUCKET).select("node").distinct().withColumn("large", F.lit(True))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("weight") / BLOCK_GRAMS)).cast("int")
    classes = stored(
        groups.join(weights, "node").join(large, "node", "left").groupBy("root")
        .agg(blocks.alias("blocks"), F.max("large").alias("large")).where("large").select("root", "blocks"),
        "classes",
    )
    count = classes.count()
    if not count:
        return None
    placed = stored(groups.join(small_side(classes, count), "root").select("node", "root", "blocks"), "placed")
    sets = gram_sets(docs, placed.select("node"), placed.count(), width)
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = placed.join(sets, "node").withColumn("block", block).select(
        "root", "node", "grams", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")
    )

    def run(table: pa.Table) -> pa.Table:
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        grams = table.column("grams").combine_chunks()
        ends, values = grams.offsets.to_numpy(), grams.values.to_numpy()
        sets = [values[low:high] for low, high in zip(ends[:-1], ends[1:], strict=True)]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        links = alike([sets[at] for at in first], [sets[at] for at in second], threshold)
        if low == high:
            np.fill_diagonal(links, False)
            held, counts = node[first], links.sum(axis=1)
        else:
            held = np.concatenate([node[first], node[second]])
            counts = np.concatenate([links.sum(axis=1), links.sum(axis=0)])
        return pa.table({"node": pa.array(held, pa.int64()), "links": pa.array(counts, pa.int64())})

    pairs = dealt.select(
        "root", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "node", "grams"
    )
    found = pairs.groupBy("root", "low", "high").applyInArrow(run, "node bigint, links bigint")
    return found.groupBy("node").agg(F.sum("links").alias("links"))


def similarity_join(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL,
                    most_hashes: int = MOST_HASHES, count_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents with their class, and the links between different texts.

    The first table has a row per row of ``docs``: ``doc_id``, ``copy_id`` (smallest id
    with the same n-gram set), ``class_id`` (smallest id it is connected with) and
    ``n_links``. The second has ``a``, ``b``, ``similarity`` of copy ids. Texts are
    lower-cased and cut at anything but letters and digits.

    Equal sets are folded first, so a group of copies is one node whatever its size.
    Buckets of up to eight nodes are compared pair by pair. In larger ones every node
    is compared with the bucket's leader, another one in each band; where that leaves
    several classes in a bucket, the nodes outside the largest are compared with all,
    block against block inside tasks, and only links that join two classes come out. So no two
    nodes that share a band and are linked end up in different classes, while the second table
    grows with a group and not with its square: of a class with nodes of large buckets it
    has the links that hold the class together. ``n_links`` counts all links: in such a
    class every pair is compared, block against block, and only counts leave the tasks.
    Without ``count_links`` it counts the links of the second table.

    Documents without words, null or empty, are linked to nothing: each is its own
    class. A text of fewer words than ``width`` has one n-gram. Rows that share an id
    are one document. Rows with a null id stay, with null ids and no links. Further
    columns are not read; an empty table gives no rows.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)

    def fits(left, right):
        return F.least(left, right) >= threshold * F.greatest(left, right)

    sketched = stored(sketches(docs, width, bands, rows), "sketches")
    same = ["grams", "digest_a", "digest_b"]
    copies = stored(
        sketched.where("grams > 0 and doc_id is not null").groupBy(*same)
        .agg(F.min("doc_id").alias("copy_id"), F.first("keys").alias("keys")),
        "copies",
    )
    spread = copies.select(
        F.col("copy_id").alias("node"), F.col("grams").alias("weight"), F.posexplode("keys").alias("band", "key")
    )
    weights = copies.select(F.col("copy_id").alias("node"), F.col("grams").alias("weight")).dropDuplicates(["node"])

    def check(pairs: DataFrame) -> DataFrame:
        nodes = stored(ends(pairs), "nodes")
        return verified(pairs, stored(gram_sets(docs, nodes, nodes.count(), width), "grams"), threshold)

    buckets = buckets_of(spread)
    edges = stored(check(stored(first_pairs(buckets, weights, fits), "pairs")), "links")
    groups = connected(edges, "groups")
    more = links_of_strays(docs, buckets.members, groups, threshold * 100, width, gram_sets)
    if more is not None:
        edges = stored(edges.unionByName(check(stored(more.distinct(), "strays"))), "links")
        groups = connected(edges, "groups")
    linked = edges.select(F.col("a").alias("copy_id")).unionByName(edges.select(F.col("b").alias("copy_id")))
    known = (
        groups.select(F.col("node").alias("copy_id"), "root")
        .join(linked.groupBy("copy_id").agg(F.count("*").alias("n_links")), "copy_id", "left")
    )
    counted = counted_links(docs, buckets.members, groups, weights, width, threshold) if count_links else None
    if counted is not None:
        known = known.join(counted.withColumnRenamed("node", "copy_id"), "copy_id", "left").select(
            "copy_id", "root", F.coalesce("links", "n_links").alias("n_links")
        )
    folded = sketched.select("doc_id", *same).join(copies.drop("keys"), same, "left")
    own = F.when(F.col("doc_id").isNull(), None).when(F.col("grams") == 0, F.col("doc_id")).otherwise(F.col("copy_id"))
    result = folded.withColumn("copy_id", own).join(known, "copy_id", "left").select(
        "doc_id", "copy_id", F.coalesce("root", "copy_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("grams").alias("n_grams"),
    )
    return result, edges


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose class has a smaller id; rows with a null id stay.

    Where rows share an id, they stay or go together.
    """
    classes, _ = similarity_join(docs, count_links=False, **options)
    gone = stored(classes.where("class_id < doc_id").select("doc_id").distinct(), "gone")
    side = small_side(gone, gone.count()).alias("g")
    return docs.alias("d").join(side, F.col("d.doc_id").cast("bigint") == F.col("g.doc_id"), "left_anti")
