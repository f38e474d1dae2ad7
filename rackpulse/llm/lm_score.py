"""Scoring documents by masked pseudo-likelihood under a small bidirectional network."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import stored, word_hashes


class Shape(NamedTuple):
    """Size of the network. The classes are ``groups`` times ``groups``."""

    groups: int = 32
    hashed: int = 64
    window: int = 2
    width: int = 16
    hidden: int = 32

    @property
    def classes(self) -> int:
        return self.groups * self.groups

    @property
    def common(self) -> int:
        """Words with a class of their own; the rest share ``hashed`` classes."""
        return self.classes - self.hashed


def grown(words: int) -> Shape:
    """The network for a corpus of so many distinct words: its classes follow their square root."""
    groups = max(Shape().groups, math.ceil(math.sqrt(1.6 * math.sqrt(words))))
    return Shape(groups=groups, hashed=groups * groups // 16)


class Training(NamedTuple):
    """Rounds over the corpus; in each, every ``stride``-th token of all documents is predicted: by default every one."""

    rounds: int = 2
    stride: int = 1
    batch: int = 4096
    rate: float = 0.01


_FLUSH = 2_000_000
_STEP = 1 << 12


def parameter_shapes(shape: Shape) -> dict[str, tuple[int, ...]]:
    seen = 2 * shape.window * shape.width
    return {
        "embed": (shape.classes + 1, shape.width), "w1": (seen, shape.hidden), "b1": (shape.hidden,),
        "wg": (shape.hidden, shape.groups), "bg": (shape.groups,),
        "ww": (shape.groups, shape.hidden, shape.groups), "bw": (shape.groups, shape.groups),
    }


def unpack(flat: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """Views of one flat vector, by parameter name."""
    out, at = {}, 0
    for name, dims in parameter_shapes(shape).items():
        size = int(np.prod(dims))
        out[name] = flat[at:at + size].reshape(dims)
        at += size
    return out


def initial(shape: Shape, counts: np.ndarray) -> np.ndarray:
    """Small random weights; the output biases are the log frequencies of the classes."""
    sizes = {name: int(np.prod(dims)) for name, dims in parameter_shapes(shape).items()}
    flat = np.random.default_rng(11).normal(0, 0.1, sum(sizes.values())).astype(np.float32)
    net = unpack(flat, shape)
    share = ((counts + 1.0) / (counts.sum() + len(counts))).reshape(shape.groups, shape.groups)
    net["b1"][:] = 0
    net["bg"][:] = np.log(share.sum(axis=1))
    net["bw"][:] = np.log(share)
    return flat


def context_places(shape: Shape) -> np.ndarray:
    """Offsets of the words on both sides; the word itself is left out."""
    return np.concatenate([np.arange(-shape.window, 0), np.arange(1, shape.window + 1)])


def contexts(classes: np.ndarray, first: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    """Classes around the tokens at ``at``; the padding class beyond the ends of their text."""
    # Each text is padded on its left, and the last one on its right too.
    place = np.arange(len(classes)) + np.repeat(shape.window * np.arange(1, len(first)), np.diff(first))
    padded = np.full(len(classes) + shape.window * len(first), shape.classes, np.int32)
    padded[place] = classes
    # Taken side by side: far faster than an index of all places at once.
    middle = place.take(at)
    return np.stack([padded.take(middle + offset) for offset in context_places(shape)], axis=1)


class Pass(NamedTuple):
    """One way through the network for tokens in the order of their groups, a column each.

    ``hidden`` has a last row of ones, so biases are weights of it; the scores of the
    groups and of the words in the token's group are below their largest, which is 0.
    """

    order: np.ndarray
    group: np.ndarray
    word: np.ndarray
    edges: np.ndarray
    inputs: np.ndarray
    hidden: np.ndarray
    outer: np.ndarray
    inner: np.ndarray


def _columns(rows: int, size: int, kind: np.dtype) -> np.ndarray:
    """An array whose rows lie a little further apart than ``size``: with a power of two they share few cache lines."""
    return np.empty((rows, size + 16), kind)[:, :size]


def _tanh(values: np.ndarray, out: np.ndarray) -> None:
    """The hyperbolic tangent by one exponential, in place; ``values`` are overwritten."""
    values *= -2
    with np.errstate(over="ignore"):  # infinity gives -1
        np.exp(values, out=values)
    values += 1
    np.divide(2, values, out=out)
    out -= 1


def forward(net: dict[str, np.ndarray], seen: np.ndarray, target: np.ndarray, shape: Shape) -> Pass:
    group, word = np.divmod(target, shape.groups)
    order = np.argsort(group.astype(np.uint16), kind="stable")
    group, word = group[order], word[order]
    edges = np.searchsorted(group, np.arange(shape.groups + 1))
    inputs = net["embed"].take(seen.take(order, axis=0), axis=0).reshape(len(target), -1)
    size, kind = len(target), net["w1"].dtype
    hidden = _columns(shape.hidden + 1, size, kind)
    hidden[-1] = 1
    before = _columns(shape.hidden, size, kind)
    np.matmul(net["w1"].T, inputs.T, out=before)
    before += net["b1"][:, None]
    _tanh(before, hidden[:-1])
    outer, inner = _columns(shape.groups, size, kind), _columns(shape.groups, size, kind)
    np.matmul(np.vstack([net["wg"], net["bg"]]).T, hidden, out=outer)
    weights = np.concatenate([net["ww"], net["bw"][:, None]], axis=1)
    spans = edges.tolist()
    for number, (low, high) in enumerate(zip(spans[:-1], spans[1:], strict=True)):
        if low < high:
            np.matmul(weights[number].T, hidden[:, low:high], out=inner[:, low:high])
    for scores in (outer, inner):
        scores -= scores.max(axis=0)
    return Pass(order, group, word, edges, inputs, hidden, outer, inner)


def log_probs(net: dict[str, np.ndarray], seen: np.ndarray, target: np.ndarray, shape: Shape) -> np.ndarray:
    """Log-probability of each target given its context: that of its group, then of the word in it."""
    held = forward(net, seen, target, shape)
    every = np.arange(len(target))
    out = np.empty(len(target), held.hidden.dtype)
    out[held.order] = (
        held.outer[held.group, every] - np.log(np.exp(held.outer).sum(axis=0))
        + held.inner[held.word, every] - np.log(np.exp(held.inner).sum(axis=0))
    )
    return out


def gradients(net: dict[str, np.ndarray], seen: np.ndarray, target: np.ndarray, shape: Shape) -> np.ndarray:
    """Gradient of the mean negative log-probability, flat."""
    size = len(target)
    flat = np.zeros(sum(int(np.prod(dims)) for dims in parameter_shapes(shape).values()), np.float32)
    grad = unpack(flat, shape)
    held = forward(net, seen, target, shape)
    hidden, outer, inner = held.hidden, held.outer, held.inner
    for scores, own in ((outer, held.group), (inner, held.word)):
        np.exp(scores, out=scores)
        scores *= 1 / (size * scores.sum(axis=0))
        scores[own, np.arange(size)] -= scores.dtype.type(1 / size)
    both = hidden @ outer.T
    grad["wg"][:], grad["bg"][:] = both[:-1], both[-1]
    kind = hidden.dtype
    back, more = _columns(shape.hidden, size, kind), _columns(shape.hidden, size, kind)
    np.matmul(net["wg"], outer, out=back)
    spans = held.edges.tolist()
    for number, (low, high) in enumerate(zip(spans[:-1], spans[1:], strict=True)):
        if low < high:
            part = inner[:, low:high]
            both = hidden[:, low:high] @ part.T
            grad["ww"][number], grad["bw"][number] = both[:-1], both[-1]
            np.matmul(net["ww"][number], part, out=more[:, low:high])
    back += more
    np.multiply(hidden[:-1], hidden[:-1], out=more)
    np.subtract(1, more, out=more)
    back *= more
    grad["w1"][:] = held.inputs.T @ back.T
    grad["b1"][:] = back.sum(axis=1)
    into = _columns(len(net["w1"]), size, kind)
    np.matmul(net["w1"], back, out=into)
    places = seen.take(held.order, axis=0).T.reshape(-1).astype(np.intp)
    for column in range(shape.width):
        grad["embed"][:, column] = np.bincount(places, into[column::shape.width].reshape(-1), shape.classes + 1)
    return flat


class Adam:
    """Running means of gradients for one parameter vector."""

    def __init__(self, size: int, rate: float) -> None:
        self.mean, self.square = np.zeros(size, np.float32), np.zeros(size, np.float32)
        self.rate, self.steps = rate, 0

    def step(self, flat: np.ndarray, grad: np.ndarray) -> None:
        self.steps += 1
        self.mean += np.float32(0.1) * (grad - self.mean)
        self.square += np.float32(0.001) * (grad * grad - self.square)
        scale = self.rate * np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        flat -= np.float32(scale) * self.mean / (np.sqrt(self.square) + np.float32(1e-8))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for low in range(0, whole.num_rows, rows):
            yield whole.slice(low, rows)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (a hash) and how often it stands in all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            word, place = np.unique(np.concatenate(words), return_inverse=True)
            return word, np.bincount(place, np.concatenate(counts), len(word)).astype(np.int64)

        for batch in _parts(batches):
            word, count = np.unique(word_hashes(batch.column(1).to_pylist())[0], return_counts=True)
            words.append(word)
            counts.append(count)
            held += len(word)
            if held > _FLUSH:
                word, count = merged()
                words, counts, held = [word], [count], len(word)
                if held > _FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "held"])
                    words, counts, held = [], [], 0
        if words:
            word, count = merged()
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["word", "held"])

    return _texts(docs).mapInArrow(run, "word bigint, held bigint").groupBy("word").agg(F.sum("held").alias("held"))


class Vocabulary:
    """The most frequent words, each a class by its rank; others are hashed to the last classes."""

    def __init__(self, words: np.ndarray, shape: Shape) -> None:
        order = np.argsort(words)
        self.words, self.rank, self.shape = words[order], order, shape
        # By their first bits most words are told from those with a class without a search.
        self.begin = np.zeros(1 << 20, bool)
        self.begin[self.words >> np.uint64(44)] = True

    def classes(self, words: np.ndarray) -> np.ndarray:
        """The class of each word; ``hashed_class`` says the same of the words without their own."""
        other = (self.shape.common + (words >> np.uint64(40)) % np.uint64(self.shape.hashed)).astype(np.int64)
        if not len(self.words):
            return other
        like = np.flatnonzero(self.begin.take((words >> np.uint64(44)).astype(np.intp)))
        asked = words.take(like)
        place = np.minimum(np.searchsorted(self.words, asked), len(self.words) - 1)
        same = self.words.take(place) == asked
        other[like[same]] = self.rank[place[same]]
        return other


def hashed_class(shape: Shape):
    """Column with the shared class of ``word``."""
    return F.lit(shape.common) + F.shiftrightunsigned("word", 40) % shape.hashed


class Model(NamedTuple):
    """The network, about 50 numbers a class, and how often each class was seen (None: not known)."""

    vocabulary: Vocabulary
    flat: np.ndarray
    shape: Shape
    held: np.ndarray | None = None


def targets(number: int, words: int, how: Training) -> np.ndarray:
    """The places predicted in a round, out of ``words``; mixed, as neighbouring tokens would make like batches."""
    return np.random.default_rng(words).permutation(np.arange(number % how.stride, words, how.stride))


def train(docs: DataFrame, shape: Shape | None = None, how: Training = Training()) -> Model:
    """The network fitted on all documents; without ``shape`` its size follows the corpus."""
    return fit(docs, stored(word_counts(docs), "words"), shape, how)


def fit(docs: DataFrame, counts: DataFrame, shape: Shape | None, how: Training) -> Model:
    """Fit the network on all documents.

    A round starts every partition from the same network; each fits it to its own
    documents, and the mean of the results, weighed by the tokens used, starts the next
    round. The sums run as a grouping by parameter, so the driver sees one network a
    round. By default every round predicts every token of all documents.
    """
    shape = shape or grown(counts.count())
    top = counts.orderBy(F.desc("held"), "word").limit(shape.common).collect()
    vocabulary = Vocabulary(np.array([row["word"] for row in top], np.int64).view(np.uint64), shape)
    held = np.zeros(shape.classes)
    held[:len(top)] = [row["held"] for row in top]
    for row in counts.groupBy(hashed_class(shape).alias("class")).agg(F.sum("held").alias("held")).collect():
        held[row["class"]] = row["held"]
    # The words with a class of their own do not count for the shared ones.
    own = Vocabulary(np.empty(0, np.uint64), shape).classes(np.array([row["word"] for row in top], np.int64).view(np.uint64))
    held[shape.common:] -= np.bincount(own, held[:len(top)], shape.classes)[shape.common:]
    flat = initial(shape, held)
    for number in range(how.rounds):
        flat = _round(docs, Model(vocabulary, flat, shape), how, number)
    return Model(vocabulary, flat, shape, held)


def _round(docs: DataFrame, model: Model, how: Training, number: int) -> np.ndarray:
    vocabulary, start, shape, _ = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = start.copy()
        net, adam, used = unpack(flat, shape), Adam(len(flat), how.rate / (1 + number)), 0
        seen, target, waiting = [], [], 0
        for batch in _parts(batches):
            words, first = word_hashes(batch.column(1).to_pylist())
            classes = vocabulary.classes(words)
            at = targets(number, len(words), how)
            seen.append(contexts(classes, first, at, shape))
            target.append(classes[at])
            waiting += len(at)
            if waiting < how.batch:
                continue
            seen, target = [np.concatenate(seen)], [np.concatenate(target)]
            whole = waiting // how.batch * how.batch
            for low in range(0, whole, how.batch):
                part = slice(low, low + how.batch)
                adam.step(flat, gradients(net, seen[0][part], target[0][part], shape))
            used += whole
            seen, target, waiting = [seen[0][whole:]], [target[0][whole:]], waiting - whole
        if waiting:
            adam.step(flat, gradients(net, np.concatenate(seen), np.concatenate(target), shape))
            used += waiting
        if used:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * used),
                 pa.array(np.full(len(flat), used, np.int64))], ["place", "value", "used"],
            )

    parts = _texts(docs).mapInArrow(run, "place int, value double, used bigint")
    mean = parts.groupBy("place").agg((F.sum("value") / F.sum("used")).alias("value")).toPandas()
    flat = start.copy()
    flat[mean["place"].to_numpy()] = mean["value"].to_numpy()
    return flat


def coded(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and classes of all words, and where each text's words begin."""
    words, first = word_hashes(texts)
    return words, model.vocabulary.classes(words), first


def score_texts(texts: list[str | None], model: Model, known: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed log-probability of each text's classes; ``known`` is what ``coded`` gave."""
    _, flat, shape, _ = model
    net = unpack(flat, shape)
    words, classes, first = known or coded(texts, model)
    logs = np.zeros(len(words) + 1)
    seen = contexts(classes, first, np.arange(len(words)), shape)
    for low in range(0, len(words), _STEP):
        part = slice(low, low + _STEP)
        logs[1:][part] = log_probs(net, seen[part], classes[part], shape)
    return np.diff(first), np.diff(np.cumsum(logs)[first])


def shared_words(texts: list[str | None], model: Model, known: tuple | None = None
                 ) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per text its words without a class of their own, their uses, and the summed log of their classes' counts."""
    words, classes, first = known or coded(texts, model)
    shared = classes >= model.shape.common
    logs = np.zeros(len(words) + 1)
    logs[1:][shared] = np.log(model.held[classes[shared]])
    found = [
        np.unique(words[low:high][shared[low:high]], return_counts=True)
        for low, high in zip(first[:-1], first[1:], strict=True)
    ]
    return [word for word, _ in found], [uses for _, uses in found], np.diff(np.cumsum(logs)[first])


def _list(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(kind.to_pandas_dtype()), kind))


def score(docs: DataFrame, shape: Shape | None = None, how: Training = Training()) -> DataFrame:
    """Per row of ``docs``: tokens, summed and mean log-probability of every token given both sides.

    Tokens are lower-cased words. The class of each is predicted from the two words on
    either side, by a network trained on the same corpus. A word that shares its class
    has in it the share of its count, which a join with the counts of all words brings.
    A null or empty text has no tokens, sum 0 and a null mean; null ids are kept; equal
    rows score alike; further columns are not read; an empty table gives no rows.
    """
    counts = stored(word_counts(docs), "words")
    model = fit(docs, counts, shape, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in _parts(batches):
            texts = batch.column(1).to_pylist()
            known = coded(texts, model)
            tokens, logs = score_texts(texts, model, known)
            words, uses, apart = shared_words(texts, model, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.arange(row, row + len(texts))), pa.array(tokens), pa.array(logs - apart),
                 _list([some.view(np.int64) for some in words], pa.int64()), _list(uses, pa.int32())],
                ["doc_id", "row", "n_tokens", "log_prob", "words", "uses"],
            )
            row += len(texts)

    scored = stored(_texts(docs).mapInArrow(
        run, "doc_id bigint, row bigint, n_tokens bigint, log_prob double, words array<bigint>, uses array<int>"
    ), "scored")
    # The log of a count of one is nothing.
    shares = counts.where("held > 1").select("word", F.log("held").alias("share"))
    terms = (
        scored.select("row", F.explode(F.arrays_zip("words", "uses")).alias("of"))
        .select("row", F.col("of.words").alias("word"), F.col("of.uses").alias("uses"))
        .join(shares, "word").groupBy("row").agg(F.sum(F.col("uses") * F.col("share")).alias("more"))
    )
    total = F.col("log_prob") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return scored.select("doc_id", "row", "n_tokens", "log_prob").join(terms, "row", "left").select(
        "doc_id", "n_tokens", total.alias("log_prob"), mean.alias("mean_log_prob")
    )
