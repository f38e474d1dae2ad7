"""Packing documents into training windows together with their lexical neighbours."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rackpulse.llm.common import byte_hashes, give_back, parts_of, spread

PIECES = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, ids binary")
END = 0
_SPECIAL = "<|endoftext|>"
# White space beyond ASCII; a text that holds any is encoded in one go.
_WIDE_SPACE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_SLICE = 1 << 20


class Encoder:
    """Token ids of whole texts, with each distinct word of a slice encoded once.

    A blank between two other characters always begins a token of this kind of
    vocabulary, so texts are cut there. The distinct pieces of some MB of text are
    encoded together and cut by their byte lengths. Texts with white space beyond
    ASCII are encoded in one go, and texts that hold the special string by the
    tokenizer file itself.
    """

    def __init__(self, tokenizer: str, ranks: str) -> None:
        import public_tokenizers
        import tiktoken

        table = {}
        with open(ranks, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                table[base64.b64decode(token)] = int(rank)
        self.encoding = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.widths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.widths[rank] = len(token)
        self.tokenizer_path, self.tokenizer = tokenizer, None

    def _whole(self, text: str) -> np.ndarray:
        if _SPECIAL not in text:
            return np.array(self.encoding.encode_ordinary(text), "<u2")
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.tokenizer_path)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")

    def _pieces(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, each of which begins with a blank, and their numbers."""
        lengths = np.diff(starts, append=len(raw))
        alike = byte_hashes(raw, starts, lengths)
        order = np.argsort(alike)
        changed = np.concatenate([[True], alike[order[1:]] != alike[order[:-1]]])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(changed) - 1
        one = order[changed]
        held = raw[spread(starts[one], lengths[one])].tobytes().decode()
        ids = np.array(self.encoding.encode_ordinary(held), "<u2")
        cuts = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(lengths[one])) + 1
        begin = np.concatenate([[0], cuts[:-1]])
        numbers = (cuts - begin)[which]
        return ids[spread(begin[which], numbers)], numbers

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, with the separator at the end."""
        end = np.array([END], "<u2")
        at = 0
        while at < len(texts):
            part, size = [], 0
            while at < len(texts) and (not part or size < _SLICE):
                part.append(texts[at] or "")
                size += len(part[-1])
                at += 1
            plain = [not (_SPECIAL in text or any(space in text for space in _WIDE_SPACE)) for text in part]
            coded = [text.encode() if good else b"" for text, good in zip(part, plain, strict=True)]
            ends = np.cumsum([len(text) for text in coded])
            raw = np.frombuffer(b"".join(coded), np.uint8)
            cut = np.flatnonzero(raw == 32)
            cut = cut[(cut > 0) & (cut < len(raw) - 1)]
            cut = cut[~_SPACE[raw[cut - 1]] & ~_SPACE[raw[cut + 1]]]
            # A blank at either end of its text is no cut either.
            owner = np.searchsorted(ends, cut, side="right")
            begins = ends - [len(text) for text in coded]
            inner = (cut > begins[owner]) & (cut < ends[owner] - 1)
            cut, owner = cut[inner], owner[inner]
            count = np.bincount(owner, minlength=len(part))
            last = np.cumsum(count)
            # What stands before the first cut of a text is encoded by itself.
            heads = np.where(count > 0, cut[np.minimum(last - count, max(len(cut) - 1, 0))] if len(cut) else 0, ends)
            bounds = np.stack([heads, ends], 1).reshape(-1)
            keep = np.zeros(len(raw) + 1, np.int8)
            np.add.at(keep, bounds[0::2], 1)
            np.add.at(keep, bounds[1::2], -1)
            inside = np.cumsum(keep[:-1]).astype(bool)
            moved = np.cumsum(inside) - 1
            ids, numbers = self._pieces(raw[inside], moved[cut]) if len(cut) else (np.empty(0, "<u2"), count[:0])
            upto = np.concatenate([[0], np.cumsum(numbers)])
            for number, text in enumerate(part):
                if not plain[number]:
                    yield np.concatenate([self._whole(text), end])
                    continue
                low, high = upto[last[number] - count[number]], upto[last[number]]
                head = raw[begins[number]:heads[number]].tobytes().decode()
                yield np.concatenate([self._whole(head), ids[low:high], end])


class Index:
    """BM25 postings of one shard over token ids."""

    def __init__(self, documents: list[np.ndarray], k1: float = 1.2, b: float = 0.75) -> None:
        length = np.array([len(ids) for ids in documents], np.int64)
        self.size = len(documents)
        kind = np.uint32 if self.size <= 1 << 16 else np.uint64
        # Arrays as long as the shard go as soon as they are used: a task's peak is here.
        pairs = np.empty(int(length.sum()), kind)
        at = 0
        for number, ids in enumerate(documents):
            pairs[at:at + len(ids)] = ids
            pairs[at:at + len(ids)] |= kind(number << 16)
            at += len(ids)
        pairs.sort()
        first = np.ones(len(pairs), bool)
        np.not_equal(pairs[1:], pairs[:-1], out=first[1:])
        once = np.flatnonzero(first)
        pairs = pairs[first]
        del first
        count = np.diff(once, append=int(length.sum())).astype(np.float32)
        del once
        self.terms = pairs.astype(np.uint16)
        owner = (pairs >> kind(16)).astype(np.int32)
        del pairs
        self.begin = np.searchsorted(owner, np.arange(self.size + 1))
        held = np.bincount(self.terms, minlength=1 << 16)
        idf = np.log1p((self.size - held + 0.5) / (held + 0.5)).astype(np.float32)
        norm = (k1 * (1 - b + b * length / max(length.mean(), 1))).astype(np.float32)
        self.weights = idf[self.terms] * count * (k1 + 1) / (count + norm[owner])
        del count
        order = np.argsort(self.terms, kind="stable").astype(np.uint32)
        self.owner, self.scores = owner[order], self.weights[order]
        self.post = np.concatenate([[0], np.cumsum(held)])

    def neighbours(self, number: int, free: np.ndarray, terms: int, most: int) -> np.ndarray:
        """Up to ``most`` free documents by their score for the seed's heaviest terms."""
        low, high = self.begin[number], self.begin[number + 1]
        own, weight = self.terms[low:high], self.weights[low:high]
        if len(own) > terms:
            own = own[np.lexsort((own, -weight))[:terms]]
        spans = [slice(self.post[term], self.post[term + 1]) for term in own]
        score = np.bincount(
            np.concatenate([self.owner[span] for span in spans]),
            np.concatenate([self.scores[span] for span in spans]), self.size,
        )
        found = np.flatnonzero((score > 0) & free)
        if len(found) > most:
            found = found[np.argpartition(-score[found], most)[:most]]
        return found[np.lexsort((found, -score[found]))]


def pack_shard(documents: list[np.ndarray], window: int, terms: int, most: int
               ) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of one shard as lists of (document, start, length).

    Whole windows of a document stand alone. What is left of it seeds a window or
    fills one: the seed's neighbours are appended by score until the window is full,
    and what does not fit of the last one seeds the next window. When the shard has
    nothing left, the open window is cut into power-of-two sequences, so no sequence
    needs padding.
    """
    rest = np.array([len(ids) for ids in documents], np.int64)
    place = np.zeros(len(documents), np.int64)
    for number in range(len(documents)):
        while rest[number] >= window:
            yield [(number, int(place[number]), window)]
            place[number] += window
            rest[number] -= window
    index = Index(documents)
    free = rest > 0
    waiting, following = 0, -1

    def take(number: int, room: int) -> tuple[int, int, int]:
        length = int(min(rest[number], room))
        piece = (number, int(place[number]), length)
        place[number] += length
        rest[number] -= length
        free[number] = rest[number] > 0
        return piece

    while True:
        while waiting < len(documents) and not free[waiting]:
            waiting += 1
        seed = following if following >= 0 and free[following] else waiting
        if seed >= len(documents):
            return
        following = -1
        sequence = [take(seed, window)]
        room = window - sequence[0][2]
        while room:
            found = index.neighbours(seed, free, terms, most)
            if not len(found):
                while waiting < len(documents) and not free[waiting]:
                    waiting += 1
                if waiting == len(documents):
                    break
                found = np.array([waiting])
            for number in found.tolist():
                sequence.append(take(number, room))
                room -= sequence[-1][2]
                if not room:
                    following = number if free[number] else -1
                    break
        if not room:
            yield sequence
            continue
        filled = window - room
        for size in (1 << bit for bit in reversed(range(filled.bit_length()))):
            if not filled & size:
                continue
            short, left = [], size
            while left:
                number, start, length = sequence.pop(0)
                used = min(length, left)
                short.append((number, start, used))
                left -= used
                if used < length:
                    sequence.insert(0, (number, start + used, length - used))
            yield short


def pack(docs: DataFrame, tokenizer: str, ranks: str, window: int = 1024, shard_tokens: int = 8_000_000,
         terms: int = 12, most: int = 64) -> DataFrame:
    """Pieces of all documents, with their ids, in sequences of ``window`` ids.

    A shard is the next ``shard_tokens`` ids of an input partition, with a BM25 index
    of its own; there is no shuffle, and a task holds one shard at a time. A task that
    runs again gives the same sequences, as their numbers come from the partition.
    ``tokenizer`` and ``ranks`` name the same vocabulary in two file formats.

    A null or empty text is the separator alone; a null ``doc_id`` stays null; equal
    rows are packed once each; other columns are not read; an empty table gives no
    rows. A text of any length is cut into as many pieces as it needs.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encoder = Encoder(tokenizer, ranks)
        sequence_id = TaskContext.get().partitionId() << 34
        keys: list[int | None] = []
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence_id, keys, held
            rows: list[tuple] = []
            size = 0
            for sequence in pack_shard(held, window, terms, most):
                offset = 0
                for number, start, length in sequence:
                    ids = held[number][start:start + length].astype("<u4").tobytes()
                    rows.append((keys[number], start, length, len(held[number]), sequence_id, offset, ids))
                    offset += length
                    size += length
                sequence_id += 1
                if size >= 1 << 20:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)
            keys, held = [], []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names)

        tokens = 0
        for piece in parts_of(batches):
            texts = piece.column(1).to_pylist()
            for key, ids in zip(piece.column(0).to_pylist(), encoder.encode(texts), strict=True):
                if held and tokens + len(ids) > shard_tokens:
                    yield from flush()
                    tokens = 0
                keys.append(key)
                held.append(ids)
                tokens += len(ids)
        if held:
            yield from flush()
        give_back()

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, PIECES)
