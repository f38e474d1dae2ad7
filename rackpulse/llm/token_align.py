"""Alignment of two tokenizers over the same texts, by as-of joins of byte offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import small_side, spread, stored
from rackpulse.llm.packing import Encoder

# Fixed value: the mark that stands for a blank in the pieces.
BLANK = "▁"
# A pair table beyond the broadcast bound is joined by a shuffle, every id pair in so many parts.
SALTS = 16

_SLICE = 1 << 20
DETAIL = ("doc_id bigint, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>, "
          "over_a array<int>, over_b array<int>, cut_a array<int>, cut_b array<int>")


class PlainEncoder(Encoder):
    """Ids of whole texts where the special string is text like any other."""

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u2")


class Bytes(NamedTuple):
    """The bytes of every token of a vocabulary, one after another."""

    flat: np.ndarray
    starts: np.ndarray
    widths: np.ndarray

    @staticmethod
    def of(tokens: list[bytes]) -> Bytes:
        widths = np.array([len(token) for token in tokens], np.int64)
        return Bytes(np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(widths) - widths, widths)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.starts[ids], self.widths[ids])]


class Pair:
    """Two tokenizers: ``a`` over byte-level ranks, ``b`` over pieces that mark blanks."""

    def __init__(self, tokenizer: str, ranks: str, pieces: str) -> None:
        import sentencepiece

        self.first = PlainEncoder(tokenizer, ranks)
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a = Bytes.of([self._byte_level(token) for token in range(len(self.first.widths))])
        self.b = Bytes.of([self._piece(token) for token in range(self.second.get_piece_size())])

    def _byte_level(self, token: int) -> bytes:
        try:
            return self.first.encoding.decode_single_token_bytes(token)
        except KeyError:
            return b""

    def _piece(self, token: int) -> bytes:
        piece = self.second.id_to_piece(token)
        if self.second.is_byte(token):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(BLANK, " ").encode()

    def align(self, texts: list[str | None]) -> Iterator[Aligned]:
        """The texts in slices of some MB, each as one ``Aligned``."""
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < _SLICE):
                part.append(texts[at] or "")
                size += len(part[-1])
                at += 1
            yield self._slice(part)

    def _slice(self, texts: list[str]) -> Aligned:
        raw = [(" " + text).encode() for text in texts]
        a = [ids[:-1] for ids in self.first.encode([" " + text for text in texts])]
        b = [np.array(ids, np.int64) for ids in self.second.encode(texts, num_threads=1)]
        for place, text in enumerate(texts):
            if not text or not (self._spells(self.a, a[place], raw[place]) and self._spells(self.b, b[place], raw[place])):
                a[place], b[place] = a[place][:0], b[place][:0]
        return Aligned.of(self._tokens(a, self.a), self._tokens(b, self.b), len(texts))

    @staticmethod
    def _spells(table: Bytes, ids: np.ndarray, raw: bytes) -> bool:
        return int(table.widths[ids].sum()) == len(raw) and table.joined(ids).tobytes() == raw

    @staticmethod
    def _tokens(ids: list[np.ndarray], table: Bytes) -> pd.DataFrame:
        """A row per token: document, id, byte range in its document and in the slice."""
        counts = np.array([len(held) for held in ids], np.int64)
        flat = np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64)
        ends = np.cumsum(table.widths[flat])
        return pd.DataFrame({
            "doc": np.repeat(np.arange(len(ids)), counts), "id": flat, "at": ends - table.widths[flat], "end": ends,
        })


class Aligned(NamedTuple):
    """The tokens of some documents on both sides and how they meet.

    ``overlaps`` has the places of all pairs of tokens that share a byte, ``cuts``
    those of the pairs that end together, both in text order.
    """

    a: pd.DataFrame
    b: pd.DataFrame
    overlaps: pd.DataFrame
    cuts: pd.DataFrame
    docs: int

    @staticmethod
    def of(a: pd.DataFrame, b: pd.DataFrame, docs: int) -> Aligned:
        """Join both sides as of each token's start, keyed by document.

        Both sides cover the same bytes of every document, so a start always lies in
        one token of the other side: the last one that starts at or before it.
        """
        left = a[["doc", "at", "end"]].assign(a=np.arange(len(a)))
        right = b[["doc", "at", "end"]].assign(b=np.arange(len(b)))
        covering_b = pd.merge_asof(left, right.rename(columns={"end": "end_b"}), on="at", by="doc")
        covering_a = pd.merge_asof(right, left.rename(columns={"end": "end_a"}).assign(at_a=left["at"]), on="at", by="doc")
        # Tokens that start together are found from both sides; they are taken once.
        later = covering_a[covering_a["at_a"] < covering_a["at"]]
        overlaps = pd.concat([
            covering_b[["doc", "a", "b", "end", "end_b"]],
            later[["doc", "a", "b", "end_a", "end"]].set_axis(["doc", "a", "b", "end", "end_b"], axis=1),
        ]).sort_values(["a", "b"], ignore_index=True)
        cuts = overlaps[overlaps["end"] == overlaps["end_b"]]
        return Aligned(a, b, overlaps[["doc", "a", "b"]], cuts[["doc", "a", "b"]], docs)

    def counts(self, of: pd.DataFrame) -> np.ndarray:
        return np.bincount(of["doc"], minlength=self.docs)

    def group_digests(self, text_a: list[str], text_b: list[str]) -> list[str]:
        """SHA-256 of each document's groups, ``ids of a|ids of b`` joined by ``;``.

        ``text_a`` and ``text_b`` hold every id with a comma, then with the mark that
        ends its side of a group: ``|`` or ``;``.
        """
        at_a, at_b = self.cuts["a"].to_numpy(), self.cuts["b"].to_numpy()
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[at_a] = last_b[at_b] = 1
        # A group lists its tokens of a, then those of b.
        before_a, before_b = np.concatenate([[0], at_a + 1]), np.concatenate([[0], at_b + 1])
        place_a = np.arange(len(self.a)) + before_b[np.cumsum(last_a) - last_a]
        place_b = np.arange(len(self.b)) + before_a[np.cumsum(last_b) - last_b + 1] if len(self.b) else np.empty(0, np.int64)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        size_a, size_b = len(text_a) // 2, len(text_b) // 2
        order[place_a] = self.a["id"].to_numpy() + size_a * last_a
        order[place_b] = self.b["id"].to_numpy() + size_b * last_b + len(text_a)
        marks = text_a + text_b
        pieces = [marks[number] for number in order.tolist()]
        ends = np.cumsum(self.counts(self.a) + self.counts(self.b))
        out, low = [], 0
        for high in ends.tolist():
            joined = "".join(pieces[low:high])[:-1]
            out.append(hashlib.sha256(joined.encode()).hexdigest() if joined else "")
            low = high
        return out


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))


def _mapped(docs: DataFrame, files: dict[str, str], make: Callable[[Pair], Callable[[Aligned], list[pa.Array]]],
            schema: str, names: list[str]) -> DataFrame:
    """``docs`` slice by slice through ``make``'s function, each row behind its ``doc_id``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(**files)
        columns = make(pair)
        for batch in batches:
            at = 0
            for aligned in pair.align(batch.column(1).to_pylist()):
                keys = batch.column(0).slice(at, aligned.docs)
                yield pa.RecordBatch.from_arrays([keys, *columns(aligned)], names)
                at += aligned.docs

    return _rows(docs).mapInArrow(run, schema)


def align(docs: DataFrame, tokenizer: str, ranks: str, pieces: str) -> DataFrame:
    """Every row of ``docs`` with the tokens of both sides and how they meet.

    ``a_ids``, ``b_ids`` and the byte offsets ``a_ends``, ``b_ends`` where they end in a
    blank and the text; ``over_a``, ``over_b``: places of all pairs that share a byte;
    ``cut_a``, ``cut_b``: places of the pairs that end together, where the groups end.

    A null or empty text, and one that either side does not spell byte by byte, has no
    tokens. Rows with equal or null ids are aligned one by one; other columns are not
    read; an empty table gives no rows. Texts are taken whole, some MB at a time.
    """
    def make(pair: Pair):
        def columns(held: Aligned) -> list[pa.Array]:
            of_a, of_b = held.counts(held.a), held.counts(held.b)
            first_a, first_b = (np.cumsum(count) - count for count in (of_a, of_b))
            # Offsets and places count from the start of their own document.
            base = np.zeros(held.docs, np.int64)
            base[of_a > 0] = held.a["at"].to_numpy()[first_a[of_a > 0]]
            return [
                _lists(held.a["id"], of_a, pa.int32()), _lists(held.b["id"], of_b, pa.int32()),
                *(_lists(side["end"].to_numpy() - base[side["doc"]], count, pa.int32())
                  for side, count in ((held.a, of_a), (held.b, of_b))),
                *(_lists(met[side].to_numpy() - first[met["doc"]], held.counts(met), pa.int32())
                  for met in (held.overlaps, held.cuts) for side, first in (("a", first_a), ("b", first_b))),
            ]
        return columns

    names = ["doc_id", "a_ids", "b_ids", "a_ends", "b_ends", "over_a", "over_b", "cut_a", "cut_b"]
    return _mapped(docs, {"tokenizer": tokenizer, "ranks": ranks, "pieces": pieces}, make, DETAIL, names)


def aligned_pairs(docs: DataFrame, tokenizer: str, ranks: str, pieces: str) -> DataFrame:
    """Every row of ``docs`` with counts, a digest of its groups, and its linked id pairs.

    ``pairs`` holds each id pair (``a * 2**32 + b``) that ends together somewhere in the
    text once, ``uses`` how often. Odd rows as in ``align``.
    """
    def make(pair: Pair):
        text_a = [f"{token}{mark}" for mark in ",|" for token in range(len(pair.a.widths))]
        text_b = [f"{token}{mark}" for mark in ",;" for token in range(len(pair.b.widths))]

        def columns(held: Aligned) -> list[pa.Array]:
            doc = held.cuts["doc"].to_numpy()
            both = held.a["id"].to_numpy()[held.cuts["a"]] << 32 | held.b["id"].to_numpy()[held.cuts["b"]]
            order = np.lexsort((both, doc))
            doc, both = doc[order], both[order]
            first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(both, prepend=-1) != 0))
            kinds, links = np.bincount(doc[first], minlength=held.docs), held.counts(held.cuts)
            return [
                pa.array(held.counts(held.a), pa.int64()), pa.array(held.counts(held.b), pa.int64()),
                pa.array(links, pa.int64()), pa.array(held.group_digests(text_a, text_b)),
                _lists(both[first], kinds, pa.int64()), _lists(np.diff(first, append=len(both)), kinds, pa.int32()),
            ]
        return columns

    schema = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, "
              "pairs array<bigint>, uses array<int>")
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "uses"]
    return _mapped(docs, {"tokenizer": tokenizer, "ranks": ranks, "pieces": pieces}, make, schema, names)


def _exploded(aligned: DataFrame, *keep: str) -> DataFrame:
    both = F.explode(F.arrays_zip("pairs", "uses")).alias("both")
    return aligned.select(*keep, both).select(*keep, F.col("both.pairs").alias("pair"), F.col("both.uses").alias("uses"))


def pair_table(aligned: DataFrame) -> DataFrame:
    """``pair``, how many links of all texts hold it, and whether no other a has more with its b."""
    counts = stored(_exploded(aligned).groupBy("pair").agg(F.sum("uses").cast("bigint").alias("count")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b_id.alias("b_id")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b_id", b_id).join(highest, "b_id").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")
    )


def with_pair_counts(docs: DataFrame, tokenizer: str, ranks: str, pieces: str) -> DataFrame:
    """A row per row of ``docs``: the counts of ``aligned_pairs`` and what all texts say of its links.

    ``n_links`` counts the pairs of tokens that end together, which are as many as the
    groups; ``n_best`` those whose id pair is the most frequent of its b id, ties
    included; ``count_sum`` adds up how often the pairs are linked in all texts. The
    pair table grows with the vocabularies; beyond the broadcast bound both sides are
    shuffled by salted pair, so a pair that every text holds is spread. Odd rows as in
    ``align``.
    """
    numbered = aligned_pairs(docs, tokenizer, ranks, pieces).withColumn("row", F.monotonically_increasing_id())
    aligned = stored(numbered, "aligned")
    table = stored(pair_table(aligned), "pair_table")
    known = table.count()
    links = _exploded(aligned, "row")
    side = small_side(table, known)
    on = ["pair"]
    if side is table:
        links = links.withColumn("salt", F.pmod("row", F.lit(SALTS)))
        salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
        side, on = table.withColumn("salt", F.explode(salts)), ["pair", "salt"]
    found = links.join(side, on).groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("uses")).otherwise(0)).alias("n_best"),
        F.sum(F.col("uses") * F.col("count")).alias("count_sum"),
    )
    zero = F.lit(0).cast("bigint")
    return aligned.drop("pairs", "uses").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce(F.col("n_best"), zero).alias("n_best"), F.coalesce(F.col("count_sum"), zero).alias("count_sum"), "groups_sha256",
    )
