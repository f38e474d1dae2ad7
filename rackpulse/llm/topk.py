"""Exact top-k search by inner product, with block bounds."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Vectors of a block, blocks of a shard, queries of a group: what one task holds is
# one shard and one group of queries.
BLOCK, SHARD_BLOCKS, QUERY_GROUP = 128, 32, 4096


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, and no component null or not finite as an integer."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) >= float(1 << 52)))
    return vector.isNotNull() & ~bad


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def _matrix(vectors: list, width: int | None = None) -> np.ndarray:
    """Rows of equal length; shorter vectors end in zeros."""
    width = max([0, *map(len, vectors)]) if width is None else width
    out = np.zeros((len(vectors), width), np.int64)
    for row, vector in enumerate(vectors):
        out[row, :len(vector)] = vector[:width]
    return out


def products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every sum stays below 2**53."""
    if not queries.size or not block.size:
        return np.zeros((len(queries), len(block)), np.int64)
    if int(np.abs(queries).max()) * int(np.abs(block).max()) * block.shape[1] < 1 << 53:
        return (queries.astype(np.float64) @ block.T.astype(np.float64)).astype(np.int64)
    return queries @ block.T


class Shard:
    """Blocks of a range of documents: forward index, and per term the extremes in the block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK) -> None:
        # Documents with the same heaviest term stand together, which tightens the bounds.
        if vectors.size:
            top = np.abs(vectors).argmax(axis=1)
            order = np.lexsort((ids, np.sign(vectors[np.arange(len(ids)), top]), top))
        else:
            order = np.argsort(ids)
        self.blocks = [(ids[part], vectors[part]) for part in np.split(order, range(block, len(order), block))]
        self.high = np.stack([part.max(axis=0) for _, part in self.blocks])
        self.low = np.stack([part.min(axis=0) for _, part in self.blocks])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """Per query its best (score, -id) of the shard, without its own id.

        Blocks are taken in the order of the largest score they could hold, the sum of
        the term maxima, until that falls below the k-th score found.
        """
        bounds = products(np.maximum(queries, 0), self.high) + products(np.minimum(queries, 0), self.low)
        best = []
        for row, (query, mine) in enumerate(zip(queries, own, strict=True)):
            found: list[tuple[int, int]] = []
            for number in np.argsort(-bounds[row], kind="stable").tolist():
                if len(found) == k and bounds[row, number] < found[0][0]:
                    break
                ids, part = self.blocks[number]
                score = products(query[None], part)[0]
                good = ids != mine
                if len(found) == k:
                    good &= score >= found[0][0]
                for pair in zip(score[good].tolist(), (-ids[good]).tolist(), strict=True):
                    if len(found) < k:
                        heapq.heappush(found, pair)
                    elif pair > found[0]:
                        heapq.heapreplace(found, pair)
            best.append(found)
        return best


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the best ``k`` for every query.

    Queries are the rows whose id is divisible by ``every``. Shards of the document
    range meet groups of queries, each pair in a task of its own; a shard's best k per
    query go into the final ranking, which Spark cuts before its shuffle.

    Rows with a null id or an unusable vector take no part. An id that repeats names
    several candidates; as a query it is answered once, by its smallest vector. Equal
    scores go by the smaller id. Shorter vectors count as ending in zeros. Further
    columns are not read; an empty table gives no rows.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), scaled(F.col("embedding"), scale).alias("vector")
    )
    size = BLOCK * SHARD_BLOCKS
    shape = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    shards = max(1, -(-shape[0] // size))
    width = shape[1] or 0
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    groups = max(1, -(-asked.count() // QUERY_GROUP))
    # Every shard meets every group of queries; a shard cuts its documents into ranges.
    documents = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn(
        "group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    )
    queries = asked.withColumn("group", F.pmod(F.hash("vec_id"), F.lit(groups)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            shard = Shard(left.column("vec_id").to_numpy(), _matrix(left.column("vector").to_pylist(), width))
            asking = right.column("vec_id").to_numpy()
            found = shard.search(_matrix(right.column("vector").to_pylist(), width), asking, k)
            for query, best in zip(asking.tolist(), found, strict=True):
                out["query_id"] += [query] * len(best)
                out["vec_id"] += [-pair[1] for pair in best]
                out["score"] += [pair[0] for pair in best]
        return pa.table({name: pa.array(column, pa.int64()) for name, column in out.items()})

    local = documents.groupBy("shard", "group").cogroup(queries.groupBy("shard", "group")).applyInArrow(
        run, "query_id bigint, vec_id bigint, score bigint"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
