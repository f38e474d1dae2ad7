"""Near duplicates by min-max hashing: two signature values for every hash function."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackpulse.llm.common import SMALL_BUCKET, buckets_of, byte_hashes, connected, ends, first_pairs, mix64, small_side, stored

WIDTH = 3
# A link: at least so many hundredths of the union are shared.
PERCENT = 85
RECALL, MOST_VALUES = 0.99999, 160
# Blocks of a large bucket hold about so many texts, and about so many shingles.
BLOCK, BLOCK_SHINGLES = 256, 250_000
# Rows are spread over so many parts of their text when they are told its component.
SALTS = 8

_SLICE = 1 << 22
_U64 = np.uint64
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False


def choose_bands(share: float = PERCENT / 100, recall: float = RECALL, most: int = MOST_VALUES) -> tuple[int, int]:
    """Bands (an even number) and rows: the longest bands that find ``recall`` of the pairs at ``share``.

    Each hash function gives two values, so ``bands * rows`` values cost half as many
    evaluations. Minima and maxima stand in bands of their own: both agree with the
    pair's similarity as their probability, and if anything differ in which pairs they miss.
    """
    best = None
    for rows in range(1, most + 1):
        hit = share ** rows
        bands = 2 if hit >= 1 else 2 * math.ceil(math.log(1 - recall) / math.log(1 - hit) / 2)
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} values cannot reach a recall of {recall} at {share}")
    return best


def spaced_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words between blanks, A-Z lower-cased, and where each text's begin."""
    hashes, counts = [], []
    at = 0
    while at < len(texts):
        part, size = [], 0
        while at < len(texts) and (not part or size < _SLICE):
            part.append((texts[at] or "").encode().lower())
            size += len(part[-1])
            at += 1
        raw = np.frombuffer(b"\n".join(part) + b"\n", np.uint8)
        inside = _INSIDE[raw]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        starts, lengths = edges[0::2], edges[1::2] - edges[0::2]
        stops = np.cumsum([len(text) + 1 for text in part])
        counts.append(np.diff(np.searchsorted(starts, stops), prepend=0))
        if len(starts):
            hashes.append(byte_hashes(raw[inside], np.cumsum(lengths) - lengths, lengths))
    first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1, np.int64)
    return np.concatenate(hashes) if hashes else np.empty(0, _U64), first


def shingles(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its windows; fewer words are one window, none none."""
    words, first = spaced_words(texts)
    factor = _U64(0xD6E8FEB86659FD93)
    rolled = np.zeros(max(0, len(words) - width + 1), _U64)
    for step in range(width):
        rolled = rolled * factor + words[step:step + len(rolled)]
    rolled = mix64(rolled)
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= width:
            yield np.unique(rolled[low:high - width + 1])
        elif high > low:
            value = np.array([high - low], _U64)
            for word in words[low:high]:
                value = value * factor + word
            yield mix64(value)
        else:
            yield np.empty(0, _U64)


def signature(held: np.ndarray, functions: int) -> np.ndarray:
    """The smallest and the largest value of the set under each hash function: two rows."""
    draw = np.random.default_rng(20260401)
    multiply = draw.integers(0, 1 << 63, functions, dtype=np.uint64) * _U64(2) + _U64(1)
    add = draw.integers(0, 1 << 63, functions, dtype=np.uint64)
    out = np.empty((2, functions), _U64)
    out[0], out[1] = np.iinfo(_U64).max, 0
    for low in range(0, len(held), 1024):
        part = held[low:low + 1024, None] * multiply + add
        np.minimum(out[0], part.min(axis=0), out=out[0])
        np.maximum(out[1], part.max(axis=0), out=out[1])
    return out


def similarity(one: np.ndarray, other: np.ndarray) -> float:
    """The estimate of two sets' Jaccard similarity from their signatures."""
    return float((one == other).mean())


def band_keys(held: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per band: the first half from minima, the second from maxima."""
    values = signature(held, bands // 2 * rows).reshape(bands, rows)
    keys = np.zeros(bands, _U64)
    for row in range(rows):
        keys = mix64(keys * _U64(0xC2B2AE3D27D4EB4F) + values[:, row])
    return keys


def _texts(docs: DataFrame, name: str) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias(name), docs["text"].cast("string").alias("text"))


def sketches(docs: DataFrame, bands: int, rows: int, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs``: size of its set, two digests of it, a key per band."""
    names = ["doc_id", "n_shingles", "digest_a", "digest_b", *(f"k{band}" for band in range(bands))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, bands + 3), _U64)
            for line, held in zip(out, shingles(batch.column(1).to_pylist(), width), strict=True):
                if len(held):
                    line[0] = len(held)
                    line[1] = mix64(held).sum(dtype=_U64)
                    line[2] = np.bitwise_xor.reduce(mix64(held + _U64(0x5851F42D4C957F2D)))
                    line[3:] = band_keys(held, bands, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(column) for column in out.view(np.int64).T.copy())], names)

    return _texts(docs, "doc_id").mapInArrow(run, ", ".join(f"{name} bigint" for name in names))


def shingle_table(docs: DataFrame, nodes: DataFrame, count: int, width: int) -> DataFrame:
    """``node`` and ``grams``, the whole set, for the documents named in ``nodes``; one row per different text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [held.view(np.int64) for held in shingles(batch.column(1).to_pylist(), width)]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["node", "grams"]
            )

    wanted = _texts(docs, "node").join(small_side(nodes, count), "node", "left_semi")
    return wanted.mapInArrow(run, "node bigint, grams array<bigint>").dropDuplicates(["node", "grams"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets share at least ``percent`` hundredths of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("grams_b"))
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    union = F.size("grams_a") + F.size("grams_b") - shared
    return pairs.join(left, "a").join(right, "b").where((shared > 0) & (shared * 100 >= union * percent)).select("a", "b")


def shared_matrix(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of the first list shares with each of the second."""
    out = np.zeros((len(one), len(other)), np.float64)
    if not one or not other:
        return out
    values = np.concatenate([*one, *other])
    row = np.repeat(np.arange(len(one) + len(other)), [len(held) for held in (*one, *other)])
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    number = np.cumsum(np.diff(values, prepend=values[:1]) != 0)
    # Only shingles that stand on both sides can be shared.
    left = np.bincount(number, row < len(one)) > 0
    right = np.bincount(number, row >= len(one)) > 0
    kept = (left & right)[number]
    column = (np.cumsum(left & right) - 1)[number[kept]]
    row = row[kept]
    for low in range(0, int((left & right).sum()), 4096):
        part = slice(*np.searchsorted(column, [low, low + 4096]))
        held = np.zeros((len(one) + len(other), 4096), np.float32)
        held[row[part], column[part] - low] = 1
        out += held[:len(one)] @ held[len(one):].T
    return out


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the links that join two groups, in order; the others close a ring."""
    root: dict[int, int] = {}

    def find(node: int) -> int:
        while root.get(node, node) != node:
            root[node] = root.get(root[node], root[node])
            node = root[node]
        return node

    kept = []
    for place, (one, other) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        one, other = find(one), find(other)
        if one != other:
            root[max(one, other)] = min(one, other)
            kept.append(place)
    return np.array(kept, np.int64)


def links_of_strays(docs: DataFrame, members: DataFrame, groups: DataFrame, percent: float, width: int,
                    sets_of: Callable[[DataFrame, DataFrame, int, int], DataFrame] = shingle_table) -> DataFrame | None:
    """Links in large buckets between groups that the leaders did not join; None if there are no such groups.

    In each bucket the members outside its largest group are compared with all others.
    Both are dealt to blocks and every pair of blocks is one task's work, which holds
    two blocks of bounded size and returns the links that join two groups, fewer
    than it has members. So no pair is ever a row, and rows grow with the members times the
    blocks of those outside. ``sets_of`` gives the ``grams`` of documents, as ``shingle_table`` does.
    """
    placed = members.where(F.col("held") > SMALL_BUCKET).join(groups, "node", "left").select(
        "bucket", "node", "weight", F.coalesce("root", "node").alias("root")
    )
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("count"), F.sum("weight").alias("weight"))
    largest = F.max(F.struct("count", "root"))["root"]
    split = stored(
        sizes.groupBy("bucket").agg(
            largest.alias("main"), F.count("*").alias("groups"), F.max("count").alias("inside"), F.sum("count").alias("held"),
            F.sum("weight").alias("grams"),
        ).where("groups > 1"),
        "split",
    )
    count = split.count()
    if not count:
        return None

    def blocks(rows) -> F.Column:
        return F.greatest(F.ceil(rows / BLOCK), F.ceil(F.col("grams") * rows / F.col("held") / BLOCK_SHINGLES), F.lit(1)).cast("int")

    work = placed.join(small_side(split, count), "bucket").select(
        "bucket", "node", "root", (F.col("root") != F.col("main")).alias("stray"),
        blocks(F.col("held") - F.col("inside")).alias("stray_blocks"), blocks(F.col("held")).alias("blocks"),
    )
    work = stored(work, "strays")
    nodes = stored(work.select("node").distinct(), "nodes")
    sets = sets_of(docs, nodes, nodes.count(), width)
    drawn = F.xxhash64("node", "bucket")
    dealt = work.join(sets, "node")
    strays = dealt.where("stray").select(
        "bucket", F.pmod(drawn, F.col("stray_blocks")).cast("int").alias("of_strays"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("of_all"), F.lit(True).alias("stray"), "node", "root", "grams",
    )
    others = dealt.select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("stray_blocks") - 1)).alias("of_strays"),
        F.pmod(drawn, F.col("blocks")).cast("int").alias("of_all"), F.lit(False).alias("stray"), "node", "root", "grams",
    )

    def run(table: pa.Table) -> pa.Table:
        stray = table.column("stray").to_numpy()
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        grams = table.column("grams").combine_chunks()
        stops, values = grams.offsets.to_numpy(), grams.values.to_numpy()
        sets = [values[low:high] for low, high in zip(stops[:-1], stops[1:], strict=True)]
        left, right = np.flatnonzero(stray), np.flatnonzero(~stray)
        shared = shared_matrix([sets[at] for at in left], [sets[at] for at in right])
        size = np.diff(stops).astype(np.float64)
        union = size[left][:, None] + size[right] - shared
        one, other = np.nonzero((shared > 0) & (shared * 100 >= union * percent) & (root[left][:, None] != root[right]))
        kept = spanning(root[left[one]], root[right[other]])
        ends_of = np.stack([node[left[one[kept]]], node[right[other[kept]]]])
        return pa.table({"a": pa.array(ends_of.min(axis=0), pa.int64()), "b": pa.array(ends_of.max(axis=0), pa.int64())})

    return strays.unionByName(others).groupBy("bucket", "of_strays", "of_all").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, recall: float = RECALL,
                    most_values: int = MOST_VALUES) -> DataFrame:
    """Every row's ``n_shingles``, its ``component_id`` and whether it is ``kept``.

    A word is what stands between blanks, tabs and line ends, with A-Z lower-cased. Two
    documents are linked if ``percent`` of the union of their sets of ``width``-word
    windows is shared; candidates come from min-max hashing, every link is confirmed on
    the whole sets. ``component_id`` is the smallest id that links lead to.

    Equal sets are folded first, so a group of copies is one node. Small buckets are
    compared pair by pair, large ones through a leader and then, where that leaves more
    than one group, block against block (``links_of_strays``); whatever shares a band and is linked
    ends in one component.

    A text without words, null or empty, has no shingles and no links; fewer words than
    ``width`` are one shingle. Rows that share an id are one document, linked if any of their
    texts is. Rows with a null id keep a null component and are kept; they link nothing.
    Other columns are not read; an empty table gives no rows.
    """
    bands, rows = choose_bands(percent / 100, recall, most_values)
    keys = [f"k{band}" for band in range(bands)]
    same = ["n_shingles", "digest_a", "digest_b"]
    sketched = stored(sketches(docs, bands, rows, width), "sketches")
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    copies = stored(
        usable.groupBy(*same).agg(F.min("doc_id").alias("node"), *(F.max(key).alias(key) for key in keys)), "copies"
    )
    spread = copies.select(
        "node", F.col("n_shingles").alias("weight"), F.posexplode(F.array(*keys)).alias("band", "key")
    )
    weights = copies.groupBy("node").agg(F.max("n_shingles").alias("weight"))

    def fits(left, right):
        return F.least(left, right) * 100 >= F.greatest(left, right) * percent

    buckets = buckets_of(spread)
    pairs = stored(first_pairs(buckets, weights, fits), "pairs")
    nodes = stored(ends(pairs), "nodes")
    sets = stored(shingle_table(docs, nodes, nodes.count(), width), "sets")
    links = stored(confirmed(pairs, sets, percent).unionByName(_shared_ids(usable, copies, same)).distinct(), "links")
    groups = connected(links, "components")
    more = links_of_strays(docs, buckets.members, groups, percent, width)
    if more is not None:
        links = stored(links.unionByName(more), "links")
        groups = connected(links, "components")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    known = copies.join(groups, "node", "left").select(
        *(F.col(name).alias(f"_{name}") for name in same), F.coalesce("root", "node").alias("component"), salts
    )
    matched = F.pmod(F.xxhash64("doc_id", F.col("place")), F.lit(SALTS)) == F.col("salt")
    for name in same:
        matched &= F.col(name) == F.col(f"_{name}")
    placed = sketched.select("doc_id", *same, F.monotonically_increasing_id().alias("place"))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.join(known, matched, "left").select("doc_id", "n_shingles", found.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _shared_ids(usable: DataFrame, copies: DataFrame, same: list[str]) -> DataFrame:
    """Links between the different texts of rows that share an id."""
    texts = usable.groupBy("doc_id").agg(F.max("digest_a").alias("high"), F.min("digest_a").alias("low")).where("low < high")
    several = stored(texts.select("doc_id"), "several")
    if not several.head(1):
        return copies.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    rows = usable.select("doc_id", *same).join(several, "doc_id").distinct().join(copies.select(*same, "node"), same)
    least = Window.partitionBy("doc_id")
    return rows.select(F.min("node").over(least).alias("a"), F.col("node").alias("b")).where("a < b").distinct()
