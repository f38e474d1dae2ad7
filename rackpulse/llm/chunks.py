"""Substring deduplication by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import stored

# Sizes in bytes: no chunk is shorter (but for a text's last one) or longer, and past the
# shortest a cut comes after 2**MASK_BITS bytes on average.
LEAST, MASK_BITS, MOST = 24, 5, 256
# Repeated chunks that follow each other make a passage from this many words on. A
# passage of 50 words loses its ends to chunks that reach beyond it.
PASSAGE_WORDS = 20

_WINDOW = 16
_GEAR = np.random.default_rng(97).integers(0, 1 << 16, 256, dtype=np.uint16)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = 2 h + gear[byte], in 16 bits.

    Sixteen bits keep the last sixteen bytes only, so the hash is a sum over them and
    is built by doubling the window.
    """
    held = _GEAR[raw]
    width = 1
    while width < _WINDOW:
        longer = held.copy()
        longer[width:] += held[:-width] << np.uint16(width)
        held, width = longer, 2 * width
    return held


def cut_points(raw: np.ndarray, least: int = LEAST, bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """The ends of the chunks of one text."""
    ends: list[int] = []
    begin, size = 0, len(raw)
    starts_char = (raw & 0xC0) != 0x80
    for at in (np.flatnonzero(gear_hashes(raw) >> np.uint16(16 - bits) == 0) + 1).tolist() + [size]:
        # A cut moves on to the next character.
        while at < size and not starts_char[at]:
            at += 1
        while at - begin > most:
            cut = begin + most
            while cut < size and not starts_char[cut]:
                cut += 1
            ends.append(cut)
            begin = cut
        if at - begin >= least or (at == size and at > begin):
            ends.append(at)
            begin = at
    return ends


def _documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, text, and the key of the document: its id, or a hash of its text where that is null."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text")).alias("doc"),
        F.col("text").cast("string").alias("text"),
    )


def digests(text: bytes, ends: list[int]) -> np.ndarray:
    """64-bit digests of the chunks of a text."""
    found = b"".join(xxhash.xxh3_64_digest(text[a:b]) for a, b in zip([0, *ends], ends))
    return np.frombuffer(found, np.int64)


def chunked(docs: DataFrame) -> DataFrame:
    """``digest`` and ``doc`` of every different chunk of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                found = []
                for text in batch.column("text").cast(pa.binary()).to_pylist():
                    found.append(np.unique(digests(text or b"", cut_points(np.frombuffer(text or b"", np.uint8)))))
                owner = np.repeat(np.arange(len(found)), np.array([len(held) for held in found], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found)), batch.column("doc").take(pa.array(owner))], ["digest", "doc"]
                )

    return _documents(docs).mapInArrow(run, "digest bigint, doc bigint")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """Per document (``doc``) the chunks that other documents hold too.

    ``chunks`` is an array of digest and ``own``: whether the document is the first of
    those that hold it. Two numbers per chunk go through the shuffles. Counting combines
    before them; a chunk that many documents share is split in the join.
    """
    found = stored(chunked(docs), "chunks")
    shared = found.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where(
        F.col("first") < F.col("last")
    ).select("digest", "first")
    chunk = F.struct("digest", (F.col("doc") == F.col("first")).alias("own"))
    return found.join(shared, "digest").groupBy("doc").agg(F.collect_set(chunk).alias("chunks"))


def placed_chunks(text: bytes, chunks: list[dict]) -> list[dict]:
    """The chunks of a text that stand elsewhere too, with their bytes and words.

    ``later`` says whether the chunk stood before, in an earlier document or in this one.
    """
    raw = np.frombuffer(text, np.uint8)
    ends = cut_points(raw)
    if not ends:
        return []
    held = digests(text, ends)
    different, first, uses = np.unique(held, return_index=True, return_counts=True)
    several = set(different[uses > 1].tolist())
    first = dict(zip(different.tolist(), first.tolist(), strict=True))
    elsewhere = {chunk["digest"]: chunk["own"] for chunk in chunks}
    blank = _BLANK[raw]
    begins = np.cumsum(~blank & np.concatenate([[True], blank[:-1]]))
    words = np.diff(begins[np.array(ends) - 1], prepend=0).tolist()
    return [
        {"number": number, "start": start, "stop": stop, "words": words[number],
         "later": not elsewhere.get(digest, True) or first[digest] != number}
        for number, (start, stop, digest) in enumerate(zip([0, *ends[:-1]], ends, held.tolist(), strict=True))
        if digest in elsewhere or digest in several
    ]


def passages(chunks: list[dict], least_words: int, later: bool) -> list[dict]:
    """Runs of neighbouring chunks, with ``later`` only of those that stood before."""
    runs: list[dict] = []
    last = None
    for chunk in chunks:
        if later and not chunk["later"]:
            continue
        if last is not None and chunk["number"] == last + 1:
            runs[-1]["stop"] = chunk["stop"]
            runs[-1]["words"] += chunk["words"]
        else:
            runs.append({"start": chunk["start"], "stop": chunk["stop"], "words": chunk["words"]})
        last = chunk["number"]
    return [run for run in runs if run["words"] >= least_words]


RESULT = ("doc_id bigint, n_bytes bigint, n_repeated bigint, shared_bytes bigint, later_bytes bigint, "
          "shared array<struct<start bigint, stop bigint, words bigint>>, "
          "later array<struct<start bigint, stop bigint, words bigint>>, text string")
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())]))


def dedup_substrings(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """Per row of ``docs`` its repeated passages and its text without those that stood before.

    ``shared`` are the byte spans of passages that stand elsewhere too, ``later`` those
    that stood before, in the order of id and place; ``text`` lacks the latter.
    ``n_repeated`` counts the chunks that stand elsewhere. Cuts depend on the sixteen
    bytes before them, so after an insertion the chunks soon agree again. Chunks are told
    apart by 64 bits; a passage is at least three of them, so chance makes none.

    A null text gives an empty one without passages. A row with a null id is kept and
    ordered by a hash of its text. Rows with the same id, or with a null id and the same
    text, are one document: what only they share stays. Further columns are not read; an
    empty table gives no rows.
    """
    rows = _documents(docs).alias("d")
    found = repeated_chunks(docs).alias("c")
    joined = rows.join(found, "doc", "left").select(
        F.col("d.doc_id").alias("doc_id"), F.col("d.text").alias("text"), F.col("c.chunks").alias("chunks")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                out: list[tuple] = []
                texts = batch.column(1).cast(pa.binary()).to_pylist()
                for text, chunks in zip(texts, batch.column(2).to_pylist(), strict=True):
                    text = text or b""
                    chunks = placed_chunks(text, chunks or [])
                    shared, later = passages(chunks, passage_words, False), passages(chunks, passage_words, True)
                    kept, at = [], 0
                    for span in later:
                        kept.append(text[at:span["start"]])
                        at = span["stop"]
                    kept.append(text[at:])
                    out.append((
                        len(text), len(chunks), sum(span["stop"] - span["start"] for span in shared),
                        sum(span["stop"] - span["start"] for span in later), shared, later, b"".join(kept).decode(),
                    ))
                kinds = [pa.int64()] * 4 + [_RUNS, _RUNS, pa.string()]
                columns = [pa.array([row[place] for row in out], kind) for place, kind in enumerate(kinds)]
                names = ["doc_id", "n_bytes", "n_repeated", "shared_bytes", "later_bytes", "shared", "later", "text"]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return joined.mapInArrow(run, RESULT)
