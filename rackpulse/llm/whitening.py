"""Whitening of embeddings by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import stored

# An entry c of a vector counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
# Further directions that are iterated along, degree of the filter, and most filters.
GUARDS, DEGREE, ROUNDS = 16, 10, 100
# Residuals, as parts of the largest eigenvalue: wanted, and still accepted where they shrink no more.
WANTED, ACCEPTED = 1e-14, 1e-11
# Smaller eigenvalues, as parts of the largest, are no variance but rounding.
ZERO = 1e-13

_BLOCK = 1 << 20
_WIDEST = float(1 << 62)
_KINDS = [np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8")]
BLOCKS = "dim int, row_count bigint, width int, ids array<bigint>, entries binary"
ROWS = "vec_id bigint, deviation decimal(38,0), whitened array<double>"


def entry_blocks(vectors: DataFrame) -> DataFrame:
    """The whole entries of all usable vectors, some thousand vectors of one length to a row.

    ``entries`` holds ``floor(64 c)`` of a block, vector by vector, in the narrowest
    integers that hold them; a pass over the table then copies bytes only.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            entries = lists.values
            gaps = np.concatenate([[0], np.cumsum(np.asarray(entries.is_null()))])
            flat = np.floor(np.asarray(entries.fill_null(0.0)) * SCALE)
            gaps += np.concatenate([[0], np.cumsum(~(np.abs(flat) < _WIDEST))])
            low = lists.offsets.to_numpy()[:-1]
            whole = np.asarray(lists.is_valid()) & (sizes > 0) & (gaps[low + sizes] == gaps[low])
            for dim in np.unique(sizes[whole]).tolist():
                chosen = np.flatnonzero(whole & (sizes == dim))
                most = max(1, _BLOCK // dim)
                for at in range(0, len(chosen), most):
                    part = chosen[at:at + most]
                    held = flat[low[part][:, None] + np.arange(dim)]
                    widest = np.abs(held).max()
                    kind = next(kind for kind in _KINDS if widest <= np.iinfo(kind).max)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([dim], pa.int32()), pa.array([len(part)], pa.int64()), pa.array([kind.itemsize], pa.int32()),
                        pa.array([batch.column(0).take(pa.array(part)).to_pylist()], pa.list_(pa.int64())),
                        pa.array([held.astype(kind).tobytes()], pa.binary()),
                    ], ["dim", "row_count", "width", "ids", "entries"])

    rows = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, BLOCKS)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and entries (as 64-bit integers) of each block."""
    for dim, width, ids, raw in zip(*(batch.column(name) for name in ("dim", "width", "ids", "entries")), strict=True):
        kind = np.dtype(f"<i{width.as_py()}")
        yield ids.values, np.frombuffer(raw.as_py(), kind).astype(np.int64).reshape(-1, dim.as_py())


class Centre(NamedTuple):
    """The mean of all entries as whole parts and exact rests: ``whole + rest / count``."""

    count: int
    whole: np.ndarray
    rest: np.ndarray

    def scaled(self, entries: np.ndarray) -> np.ndarray:
        """``count * x - S``, exact: 64-bit integers, or Python's where those are too short."""
        apart = entries - self.whole
        if apart.size and max(abs(int(apart.min())), abs(int(apart.max()))) >= (1 << 62) // self.count:
            return apart.astype(object) * self.count - self.rest.astype(object)
        return apart * self.count - self.rest

    def centred(self, entries: np.ndarray) -> np.ndarray:
        return (self.scaled(entries) / self.count).astype(np.float64)

    def deviations(self, entries: np.ndarray) -> pa.Array:
        """The exact sum of squares of ``scaled`` of every row."""
        apart = self.scaled(entries)
        widest = max((abs(int(value)) for value in (apart.min(), apart.max())), default=0)
        if apart.dtype != object and widest * widest * apart.shape[1] < 1 << 63:
            return pa.array((apart * apart).sum(axis=1)).cast(pa.decimal128(38, 0))
        return pa.array([Decimal(sum(value * value for value in row)) for row in apart.tolist()], pa.decimal128(38, 0))


def _summed(blocks: DataFrame, part: Callable[[np.ndarray], np.ndarray], rows: int, columns: int) -> np.ndarray:
    """``part`` of all blocks, added up: tasks add up their own, Spark the tasks' rows.

    What reaches the driver has the dimension's size, whatever the number of vectors.
    """
    names = [f"c{place}" for place in range(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, columns))
        for batch in batches:
            for _, entries in _matrices(batch):
                total += part(entries)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(rows, dtype=np.int32)), *(pa.array(column) for column in total.T.copy())], ["place", *names]
        )

    schema = ", ".join(["place int", *(f"{name} double" for name in names)])
    sums = blocks.mapInArrow(run, schema).groupBy("place").agg(*(F.sum(name).alias(name) for name in names))
    out = np.zeros((rows, columns))
    for row in sums.collect():
        out[row["place"]] = row[1:]
    return out


def find_centre(blocks: DataFrame, dim: int, count: int) -> Centre:
    """Exact sums: tasks add upper and lower halves of the entries, Spark adds the tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            for _, entries in _matrices(batch):
                high += (entries >> 32).sum(axis=0)
                low += (entries & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(dim, dtype=np.int32)), pa.array(high), pa.array(low)], ["place", "high", "low"]
        )

    sums = blocks.mapInArrow(run, "place int, high bigint, low bigint").groupBy("place").agg(
        *(F.sum(F.col(name).cast("decimal(38,0)")).alias(name) for name in ("high", "low"))
    )
    whole, rest = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
    for row in sums.collect():
        whole[row["place"]], rest[row["place"]] = divmod((int(row["high"]) << 32) + int(row["low"]), count)
    return Centre(count, whole, rest)


def filtered(multiply: Callable[[np.ndarray], np.ndarray], start: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the covariance applied to ``start``.

    It stays below one on the spectrum between 0 and ``cut`` and grows fast above; the
    recurrence is scaled by its value at ``top`` to keep the numbers near one.
    """
    middle = half = cut / 2
    scale = half / (top - middle)
    first = scale
    before, now = start, (multiply(start) - middle * start) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (multiply(now) - middle * now) * (2 * following / half) - before * (scale * following)
        scale = following
    return now


class Spectrum(NamedTuple):
    """Leading eigenvalues with unit eigenvectors in columns, and the largest residual, as a part of the first value."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float


def leading(multiply: Callable[[np.ndarray], np.ndarray], dim: int, count: int = COMPONENTS, guards: int = GUARDS,
            degree: int = DEGREE, rounds: int = ROUNDS) -> Spectrum:
    """The ``count`` leading eigenpairs of the covariance behind ``multiply``.

    Each round projects (Rayleigh-Ritz), measures the residuals of the wanted pairs, and
    filters the block against the spectrum below its smallest Ritz value. It ends when
    the residuals are at rounding: below ``WANTED``, or below ``ACCEPTED`` and no longer
    shrinking. If they never are, it raises.
    """
    count = min(count, dim)
    block = np.linalg.qr(np.random.default_rng(20260301).normal(size=(dim, min(dim, count + guards))))[0]
    last, slow = np.inf, 0
    for _ in range(rounds):
        image = multiply(block)
        inner = block.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(values)[::-1]
        values, turn = values[order], turn[:, order]
        block, image = block @ turn, image @ turn
        if values[0] <= 0:
            return Spectrum(np.zeros(0), np.zeros((dim, 0)), 0.0)
        apart = np.linalg.norm(image - block * values, axis=0)[:count].max() / values[0]
        slow = slow + 1 if apart > last / 2 else 0
        if apart <= WANTED or (apart <= ACCEPTED and slow >= 2):
            return Spectrum(values[:count], block[:, :count], float(apart))
        last = min(last, apart)
        # The bound must lie above zero where the vectors have no variance in some direction.
        cut = max(values[-1], values[0] * 1e-3)
        block = np.linalg.qr(filtered(multiply, block, cut, values[0], degree))[0]
    raise ArithmeticError(f"residual {last} after {rounds} rounds")


class Whitening(NamedTuple):
    """What was fitted: ``directions`` are the eigenvectors over the roots of their values."""

    centre: Centre
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(blocks: DataFrame, dim: int, count: int, components: int = COMPONENTS) -> Whitening:
    """Fit on all blocks; every pass over them is one job that centres before it multiplies."""
    centre = find_centre(blocks, dim, count)

    def multiply(block: np.ndarray) -> np.ndarray:
        def part(entries: np.ndarray) -> np.ndarray:
            held = centre.centred(entries)
            return held.T @ (held @ block)
        return _summed(blocks, part, dim, block.shape[1]) / count

    found = leading(multiply, dim, components)
    solid = found.values > ZERO * found.values[0] if len(found.values) else np.zeros(0, bool)
    values, vectors = found.values[solid], found.vectors[:, solid]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    directions = vectors / np.sqrt(values)

    def moments(entries: np.ndarray) -> np.ndarray:
        held = centre.centred(entries)
        wide = np.column_stack([held @ directions, np.ones(len(held))])
        out = np.zeros((len(values) + 2, len(values) + 1))
        out[:-1] = wide.T @ wide
        out[-1, 0] = np.square(held).sum()
        return out

    sums = _summed(blocks, moments, len(values) + 2, len(values) + 1) / count
    mean = sums[-2, :-1]
    spread = sums[:-2, :-1] - np.outer(mean, mean)
    error = float(np.abs(spread - np.eye(len(values))).max()) if len(values) else 0.0
    return Whitening(centre, values, directions, values / sums[-1, 0] if len(values) else values, error)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """Every usable row of ``vectors`` (``vec_id``, ``embedding``) whitened, and the fit.

    ``deviation`` is the exact sum over the dimensions of ``(n x - S)**2``, ``whitened``
    the centred vector on each component over the root of the component's variance.

    Rows whose vector is null or empty, or holds null, non-finite or entries of 2**56 and
    more (they do not fit a long), take no part; nor do vectors of another length than most (of
    equally common lengths the larger counts). A null ``vec_id`` stays null, repeated rows
    count each. Components without variance are left out, so equal vectors have none.
    Other columns are not read. Without usable rows there is no fit and the table is empty.
    """
    spark = vectors.sparkSession
    blocks = stored(entry_blocks(vectors), "entries")
    known = blocks.groupBy("dim").agg(F.sum("row_count").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    if known is None:
        return spark.createDataFrame([], ROWS), None
    dim, count = known
    blocks = blocks.where(F.col("dim") == dim)
    fitted = fit(blocks, dim, count, components)
    centre, directions = fitted.centre, fitted.directions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, entries in _matrices(batch):
                turned = centre.centred(entries) @ directions
                ends = pa.array(np.arange(len(entries) + 1, dtype=np.int32) * turned.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [ids, centre.deviations(entries), pa.ListArray.from_arrays(ends, pa.array(turned.reshape(-1)))],
                    ["vec_id", "deviation", "whitened"],
                )

    return blocks.mapInArrow(run, ROWS), fitted


def whitened_rows(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per usable vector and component, with the shares of variance and the error of the whole.

    A ``deviation`` beyond a long is null. Odd rows as in ``whiten``.
    """
    rows, fitted = whiten(vectors, components)
    count, explained, error = (fitted.centre.count, fitted.explained, fitted.identity_error) if fitted else (0, [], 0.0)
    shares = F.array(*(F.lit(float(share)) for share in explained)).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(count).cast("bigint").alias("n"),
        F.expr("try_cast(deviation AS bigint)").alias("deviation"), "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
