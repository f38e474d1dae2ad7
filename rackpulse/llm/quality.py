"""Quality rules: repetition counts, and divergence from how a language usually looks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import stored

WINDOW = 8
LEAST_WORDS = 20
# Words that stand in this share of a language's documents may become common words.
COMMON_SHARE = 0.1
COMMON_WORDS = 64
# A language has a reference of its own from this share of all documents on, so there
# are at most 1 / LANGUAGE_SHARE references.
LANGUAGE_SHARE = 0.001
# Shorter texts say too little about a distribution.
CLASS_LEAST_CHARS, WORD_LEAST_WORDS = 200, 60
CLASS_MOST, WORD_MOST = 0.33, 0.5

_SYMBOLS = b"#*$%&|<>"
_STRIP = b".,;:!?\"'()[]{}"
# Classes of bytes: lower case, upper case, digit, blank, line break, sentence mark, symbol, other.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(mark) for mark in ".,;:!?'\"()-"]] = 5
_CLASS[[ord(mark) for mark in "#*$%&|<>@^~_=+/\\[]{}`"]] = 6
CLASSES = 8
_CHUNK_WORDS = 4_000_000


def _common(word: bytes) -> bytes:
    return word.strip(_STRIP).lower()


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.split()
    chars = len(text) - np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80)
    blanks = len(text) - len(text.translate(None, b" \t\n\v\f\r"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), int(chars) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that stand in the text twice or more."""
    windows = len(words) - WINDOW + 1
    if windows < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(word, len(number)) for word in words), np.uint64, len(words))
    # Windows are told apart exactly: pairs of numbers are numbered anew, three times.
    step = 1
    while step < WINDOW:
        joined = ids[:-step] * np.uint64(len(words) + 1) + ids[step:]
        step *= 2
        if step < WINDOW:
            ids = np.unique(joined, return_inverse=True)[1].astype(np.uint64)
    order = np.argsort(joined)
    same = joined[order[1:]] == joined[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(windows, bool)
    found[order[1:][same]] = found[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int32)
    at = np.flatnonzero(found)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def class_shares(text: bytes) -> np.ndarray:
    """Shares of the byte classes."""
    return np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=CLASSES) / max(len(text), 1)


def word_shares(words: list[bytes], places: dict[bytes, int], bins: int) -> np.ndarray:
    """Shares of the common words; the last bin has all others."""
    counts = np.zeros(bins)
    for word, count in Counter(words).items():
        counts[places.get(_common(word), bins - 1)] += count
    return counts / max(len(words), 1)


def divergence(one: np.ndarray, other: np.ndarray) -> float:
    """Jensen-Shannon distance in base 2: 0 for equal, 1 for disjoint distributions."""
    middle = (one + other) / 2

    def against(part: np.ndarray) -> float:
        held = part > 0
        return float(np.sum(part[held] * np.log2(part[held] / middle[held])))

    return float(np.sqrt(max(0.0, (against(one) + against(other)) / 2)))


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang")
    )


def _raw(batch: pa.RecordBatch) -> list[bytes]:
    return [text or b"" for text in batch.column("text").cast(pa.binary()).to_pylist()]


def common_words(docs: DataFrame, share: float = COMMON_SHARE, most: int = COMMON_WORDS,
                 language_share: float = LANGUAGE_SHARE) -> dict[str, list[bytes]]:
    """Per large enough language the words that most of its documents hold.

    A chunk passes on the counts of all its words, so the sums are the numbers of documents
    over the whole corpus, however its rows lie in chunks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        rows: Counter = Counter()
        words = 0

        def flush() -> pa.RecordBatch:
            out = [(lang, None, count) for lang, count in rows.items()] + [
                (lang, word, count) for lang, held in found.items() for word, count in held.items()
            ]
            return pa.RecordBatch.from_arrays([
                pa.array([row[0] for row in out], pa.string()), pa.array([row[1] for row in out], pa.binary()),
                pa.array([row[2] for row in out], pa.int64()),
            ], ["lang", "word", "held"])

        for batch in batches:
            for text, lang in zip(_raw(batch), batch.column("lang").to_pylist(), strict=True):
                if lang is None:
                    continue
                own = set(map(_common, set(text.split())))
                own.discard(b"")
                rows[lang] += 1
                found.setdefault(lang, Counter()).update(own)
                words += len(own)
                if words >= _CHUNK_WORDS:
                    yield flush()
                    found, rows, words = {}, Counter(), 0
        yield flush()

    counted = _texts(docs).mapInArrow(run, "lang string, word binary, held bigint")
    sums = stored(counted.groupBy("lang", "word").agg(F.sum("held").alias("held")), "common")
    rows = sums.where("word is null").select("lang", F.col("held").alias("docs"))
    total = rows.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    large = rows.where(F.col("docs") >= language_share * total)
    ranked = (
        # At most 1 / language_share rows: the counts are not dealt by language.
        sums.where("word is not null").join(F.broadcast(large), "lang").where(F.col("held") >= share * F.col("docs"))
        .groupBy("lang")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("held")).alias("rank"), "word"))), 1, most).alias("best"))
    )
    return {row["lang"]: [bytes(best["word"]) for best in row["best"]] for row in ranked.collect()}


def references(docs: DataFrame, words: dict[str, list[bytes]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language the mean class and common-word shares of its documents that are long enough."""
    places = {lang: {word: place for place, word in enumerate(held)} for lang, held in words.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros(CLASSES + len(held) + 3) for lang, held in words.items()}
        for batch in batches:
            for text, lang in zip(_raw(batch), batch.column("lang").to_pylist(), strict=True):
                if lang not in sums:
                    continue
                into, split = sums[lang], text.split()
                if len(text) >= CLASS_LEAST_CHARS:
                    into[:CLASSES] += class_shares(text)
                    into[-2] += 1
                if len(split) >= WORD_LEAST_WORDS:
                    into[CLASSES:-2] += word_shares(split, places[lang], len(words[lang]) + 1)
                    into[-1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([held.tolist() for held in sums.values()], pa.list_(pa.float64()))],
            ["lang", "sums"],
        )

    parts = _texts(docs).mapInArrow(run, "lang string, sums array<double>")
    summed = parts.select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("held"))
    out = {lang: np.zeros(CLASSES + len(held) + 3) for lang, held in words.items()}
    for row in summed.collect():
        out[row["lang"]][row["pos"]] = row["held"]
    return {
        lang: (held[:CLASSES] / max(held[-2], 1), held[CLASSES:-2] / max(held[-1], 1)) for lang, held in out.items()
    }


RESULT = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, class_distance double, word_distance double, base_failed boolean, kept boolean")


def verdict_columns(texts: list[bytes], langs: list[str | None], words, refs) -> list[tuple]:
    """The result columns after ``doc_id`` for some texts."""
    places = {lang: {word: place for place, word in enumerate(held)} for lang, held in words.items()}
    rows = []
    for text, lang in zip(texts, langs, strict=True):
        counts = base_counts(text)
        failed = counts[0] < LEAST_WORDS or 100 * counts[4] > 30 * counts[0]
        by_class = by_word = None
        if lang in refs:
            if len(text) >= CLASS_LEAST_CHARS:
                by_class = divergence(class_shares(text), refs[lang][0])
            if counts[0] >= WORD_LEAST_WORDS:
                by_word = divergence(word_shares(text.split(), places[lang], len(words[lang]) + 1), refs[lang][1])
        odd = (by_class is not None and by_class > CLASS_MOST) or (by_word is not None and by_word > WORD_MOST)
        rows.append((*counts, by_class, by_word, failed, not failed and not odd))
    return rows


def judge(docs: DataFrame) -> DataFrame:
    """Counts, distances and verdict per row of ``docs``.

    Each document's distribution of byte classes and of common words is held against
    the mean of its language by Jensen-Shannon distance. Texts below the length
    guards, and texts without a language or in one too rare for a reference, are
    judged by the base rules alone. The references come from all documents; they are
    at most 1000 languages of 73 numbers, which is what the driver sees.

    A null text counts as empty and fails, as it has fewer than 20 words; null ids
    are kept; equal rows are judged each; further columns are not read; an empty
    table gives no rows.
    """
    words = common_words(docs)
    refs = references(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = verdict_columns(_raw(batch), batch.column("lang").to_pylist(), words, refs)
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            columns = [pa.array([row[place] for row in rows], kind) for place, kind in enumerate(kinds)]
            names = [part.split()[0] for part in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    return _texts(docs).mapInArrow(run, RESULT)


def good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns."""
    words = common_words(docs)
    refs = references(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").cast(pa.string()).to_pylist() if "lang" in batch.schema.names else [None] * len(batch)
            kept = [row[-1] for row in verdict_columns(_raw(batch), langs, words, refs)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
