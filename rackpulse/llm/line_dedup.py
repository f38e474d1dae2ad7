"""Fuzzy line deduplication: SimHash, block join, edit similarity, connected groups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackpulse.llm.common import (
    buckets_of, give_back, linked_groups, mix64, parts_of, sized_words, small_side, spread, stored,
)

EDIT_SIMILARITY = 0.9
# The features of a line are its words, those of a line with fewer words its runs of bytes.
GRAM_WORDS, GRAM = 8, 3
# SimHashes up to that distance are sure to share a block choice, farther ones may do so
# too. Six blocks make 20 keys of about 32 bits; more blocks make longer keys, which fewer
# lines share by chance.
BITS, MOST_DISTANCE, BLOCKS = 64, 3, 6

_U64 = np.uint64
# Everything but letters, digits and non-ASCII characters becomes a blank.
_BLANKS = bytes(
    byte if byte >= 0x80 or 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A else 0x20 for byte in range(256)
)


def block_keys(blocks: int, distance: int = MOST_DISTANCE, bits: int = BITS) -> list[int]:
    """Bit masks of all choices of ``blocks - distance`` out of ``blocks`` bit ranges.

    Two hashes that differ in at most ``distance`` bits differ in at most as many
    blocks, so they agree on at least one mask.
    """
    edges = [round(bits * place / blocks) for place in range(blocks + 1)]
    whole = [((1 << high) - 1) ^ ((1 << low) - 1) for low, high in zip(edges, edges[1:], strict=False)]
    return [sum(choice) for choice in combinations(whole, blocks - distance)]


def numbered(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The words' hashes, those of a line's second, third, ... use of a word changed.

    Else a word that fills most of a line would decide all of its bits.
    """
    line = np.repeat(np.arange(len(counts), dtype=_U64), counts)
    marks = words ^ mix64(line + _U64(1))
    held = np.sort(marks)
    twice = held[1:][held[1:] == held[:-1]]
    if not len(twice):
        return words
    # Words that share their last bits with a repeated one are numbered too, in vain.
    seen = np.zeros(1 << 20, bool)
    seen[twice & _U64(0xFFFFF)] = True
    some = np.flatnonzero(seen[marks & _U64(0xFFFFF)])
    order = np.argsort(marks[some], kind="stable")
    ordered = marks[some[order]]
    first = np.ones(len(some), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    at = np.arange(len(some))
    use = np.empty(len(some), np.int64)
    use[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    out, some, use = words.copy(), some[use > 0], use[use > 0]
    out[some] = mix64(words[some] + use.astype(_U64) * _U64(0x9E3779B97F4A7C15))
    return out


def bit_counts(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each run's words have each bit set: one row of 64 numbers per run, none empty.

    Eight counters of a byte lie in one number, so a run is summed 255 words at a time.
    """
    parts = -(-counts // 255)
    first = np.cumsum(parts) - parts
    place = np.arange(int(parts.sum())) - np.repeat(first, parts)
    starts = np.repeat(np.cumsum(counts) - counts, parts) + 255 * place
    out = np.empty((len(starts), 8, 8), np.int32)
    for bit in range(8):
        sums = np.add.reduceat((words >> _U64(bit)) & _U64(0x0101010101010101), starts)
        out[:, :, bit] = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(out.reshape(-1, 64), first, axis=0)


def simhashes(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit SimHash per run of ``counts`` words; each use of a word is a feature."""
    words = numbered(words, counts)
    out = np.zeros(len(counts), _U64)
    filled = np.flatnonzero(counts)
    starts = np.cumsum(counts) - counts
    for low in range(0, len(filled), 4096):
        some = filled[low:low + 4096]
        part = words[starts[some[0]]:starts[some[-1]] + counts[some[-1]]]
        signs = bit_counts(part, counts[some]) * 2 > counts[some, None]
        out[some] = np.packbits(signs, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def gram_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``GRAM`` bytes of some normalised lines, and their number per line.

    A blank stands before and behind a line, so each line that is not empty has some.
    """
    held = [b" " + line.encode() + b" " for line in lines]
    counts = np.array([len(line) - GRAM + 1 for line in held], np.int64)
    raw = np.frombuffer(b"".join(held), np.uint8).astype(_U64)
    rolled = np.zeros(max(0, len(raw) - GRAM + 1), _U64)
    for step in range(GRAM):
        rolled = (rolled << _U64(8)) | raw[step:step + len(rolled)]
    starts = np.cumsum(counts + GRAM - 1) - counts - GRAM + 1
    return mix64(rolled + _U64(1))[spread(starts, counts)], counts


def line_hashes(lines: list[str], words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SimHash of each line, given the hashes and numbers of its words."""
    out = np.zeros(len(counts), _U64)
    few = (counts > 0) & (counts < GRAM_WORDS)
    many = counts >= GRAM_WORDS
    out[many] = simhashes(words[np.repeat(many, counts)], counts[many])
    if few.any():
        out[few] = simhashes(*gram_hashes([normalised(lines[at]) for at in np.flatnonzero(few)]))
    return out


def _split(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """All lines of some texts, and the number of lines of each."""
    lines = [(text or "").split("\n") for text in texts]
    return [line for part in lines for line in part], np.array([len(part) for part in lines], np.int64)


def _line_keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each line's word sequence; 0 for a line without words."""
    keys = np.zeros(len(counts), _U64)
    filled = np.flatnonzero(counts)
    if len(filled):
        starts = (np.cumsum(counts) - counts)[filled]
        place = np.arange(len(words), dtype=np.int64) - np.repeat(starts, counts[filled])
        keys[filled] = mix64(np.add.reduceat(mix64(words + place.astype(_U64) * _U64(0x9E3779B97F4A7C15)), starts))
    return keys


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_key"),
        F.col("text").cast("string").alias("text"),
    )


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line with a word: its place, the hash of its words, its SimHash."""
    schema = "doc_id bigint, text_key bigint, line bigint, node bigint, chars bigint, simhash bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 250):
                batch = whole.slice(low, 250)
                lines, per_text = _split(batch.column(2).to_pylist())
                words, first, sizes = sized_words(lines)
                counts = np.diff(first)
                upto = np.concatenate([[0], np.cumsum(sizes)])[first]
                chars = np.diff(upto) + counts - 1
                keep = counts > 0
                owner = np.repeat(np.arange(len(per_text)), per_text)
                place = np.arange(len(lines)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
                taken = pa.array(owner[keep])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(taken), batch.column(1).take(taken), pa.array(place[keep]),
                    pa.array(_line_keys(words, counts)[keep].view(np.int64)),
                    pa.array(chars[keep]), pa.array(line_hashes(lines, words, counts)[keep].view(np.int64)),
                ], ["doc_id", "text_key", "line", "node", "chars", "simhash"])
        give_back()

    return _rows(docs).mapInArrow(run, schema)


def line_texts(docs: DataFrame, places: DataFrame, count: int) -> DataFrame:
    """``node`` and its normalised text, read at the given places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 250):
                batch = whole.slice(low, 250)
                texts = batch.column("text").to_pylist()
                nodes, out = [], []
                for text, lines in zip(texts, batch.column("lines").to_pylist(), strict=True):
                    split = text.split("\n")
                    for number in lines:
                        nodes.append(number["node"])
                        out.append(normalised(split[number["line"]]))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.string())], ["node", "text"])
        give_back()

    asked = places.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("node", "line")).alias("lines"))
    rows = _rows(docs).alias("d").join(
        small_side(asked, count).alias("p"),
        F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_key") == F.col("p.text_key")),
    ).select("d.text", "p.lines")
    return rows.mapInArrow(run, "node bigint, text string").dropDuplicates(["node"])


def normalised(line: str) -> str:
    """Lower-cased words with one blank between them."""
    return b" ".join(line.lower().encode().translate(_BLANKS).split()).decode()


def alignment_cost(one: list[str], other: list[str], look: int = 4) -> int:
    """Edits of one way to turn the first words into the second: a bound from above.

    Goes through both, and past a difference to the nearest pair of equal words.
    """
    steps = sorted(((x, y) for x in range(look + 1) for y in range(look + 1)), key=sum)[1:]
    i = j = cost = 0
    while i < len(one) and j < len(other):
        if one[i] == other[j]:
            i += 1
            j += 1
            continue
        step = (len(one) - i, len(other) - j)
        for skip, other_skip in steps:
            if i + skip < len(one) and j + other_skip < len(other) and one[i + skip] == other[j + other_skip]:
                step = (skip, other_skip)
                break
        cost += max(sum(map(len, one[i:i + step[0]])) + step[0], sum(map(len, other[j:j + step[1]])) + step[1])
        i, j = i + step[0], j + step[1]
    return cost + max(sum(map(len, one[i:])) + len(one) - i, sum(map(len, other[j:])) + len(other) - j)


def unlike_middles(one: str, other: str) -> tuple[str, str]:
    """What is left of two texts without their common beginning and end; the edit distance is the same."""
    shorter = min(len(one), len(other))
    low = len(commonprefix([one, other]))
    high = len(commonprefix([one[::-1][:shorter - low], other[::-1][:shorter - low]]))
    return one[low:len(one) - high], other[low:len(other) - high]


def edits_fit(one: str, other: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: Myers' bit vectors, a column of the distance table per step.

    Bit ``i`` of ``up`` and ``down`` says whether the distance grows or falls by one
    from row ``i`` to the next; ``last`` is the distance in the last row.
    """
    if len(one) > len(other):
        one, other = other, one
    if not one or len(other) - len(one) > most:
        return len(other) <= most
    places: dict[str, int] = {}
    for place, char in enumerate(one):
        places[char] = places.get(char, 0) | 1 << place
    whole, top = (1 << len(one)) - 1, 1 << len(one) - 1
    up, down, last, left = whole, 0, len(one), len(other)
    for char in other:
        equal = places.get(char, 0)
        across = ((equal & up) + up ^ up) | equal
        right, back = down | whole & ~(across | up), up & across
        left -= 1
        if right & top:
            last += 1
        elif back & top:
            last -= 1
        # Each further step lowers it by one at most.
        if last - left > most:
            return False
        right = right << 1 | 1
        steep = equal | down
        up, down = whole & (back << 1 | ~(steep | right)), whole & right & steep
    return last <= most


def within(one: str, other: str, most: int) -> bool | None:
    """Whether the edit distance is at most ``most``, if two bounds tell; else None."""
    if abs(len(one) - len(other)) > most:
        return False
    if alignment_cost(one.split(" "), other.split(" ")) <= most:
        return True
    # An edit takes at most two pairs of neighbouring characters away and adds at most two.
    left, right = Counter(zip(one, one[1:])), Counter(zip(other, other[1:]))
    if max((left - right).total(), (right - left).total()) > 2 * most:
        return False
    return None


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose texts have at least that edit similarity: 1 - distance / longer length.

    Most pairs are settled by a bound on their distance; the exact distance is
    computed for the others.
    """
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def close(one: str, other: str) -> bool:
        most = int(max(len(one), len(other)) * (1 - similarity) + 1e-9)
        one, other = unlike_middles(one, other)
        told = within(one, other, most)
        return edits_fit(one, other, most) if told is None else told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            texts = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([close(*pair) for pair in texts], pa.bool_()))
        give_back()

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a bigint, b bigint")


def repeated_lines(docs: DataFrame, similarity: float = EDIT_SIMILARITY, blocks: int = BLOCKS) -> DataFrame:
    """The lines to remove: per document (``doc_id``, ``text_key``) an array ``gone`` of line numbers.

    Lines are compared by their lower-cased words. Equal lines are one node. Nodes long
    enough for an edit (10 characters at 0.9) whose SimHashes agree on a choice of blocks
    are candidates, and edit similarity alone decides on them; of each connected group the
    first occurrence in the order of document and line stays. Buckets work as in the
    n-gram join.
    """
    found = stored(occurrences(docs), "lines")
    place = F.struct("doc_id", "text_key", "line")
    nodes = stored(
        found.groupBy("node", "chars", "simhash").agg(F.min(place).alias("place"), F.count("*").alias("uses")), "nodes"
    )
    fuzzy = nodes.where(F.col("chars") * (1 - similarity) > 1 - 1e-9)
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in block_keys(blocks)]
    keys = F.array(*(F.col("simhash").bitwiseAND(F.lit(mask)) for mask in signed))
    weight = F.struct("chars").alias("weight")

    def fits(left, right):
        return F.least(left["chars"], right["chars"]) >= F.greatest(left["chars"], right["chars"]) * similarity

    def check(pairs: DataFrame, ends: DataFrame) -> DataFrame:
        wanted = stored(nodes.join(ends, "node", "left_semi").select("node", "place.*"), "places")
        return verified(pairs, stored(line_texts(docs, wanted, wanted.count()), "texts"), similarity)

    rows = fuzzy.select("node", weight, F.posexplode(keys).alias("band", "key"))
    _, groups = linked_groups(buckets_of(rows, fuzzy.count() * len(signed)), fuzzy.select("node", weight), fits, check, "groups")
    grouped = nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = grouped.groupBy("root").agg(F.min("place").alias("keep"), F.sum("uses").alias("uses")).where("uses > 1")
    kept = stored(grouped.select("node", "root").join(first, "root").select("node", "keep"), "kept")
    gone = found.join(kept, "node").where(place != F.col("keep"))
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def without_lines(docs: DataFrame, count_as: str | None = None, **options) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines; ``count_as`` names a column for their number.

    ``n_chars``, where there is such a column, is counted again. Lines without a letter,
    a digit or a non-ASCII character always stay. A null text stays null.
    Null ids order before all others. Rows with the same id and text are one document
    and stay alike. A document may lose all its lines: its text is then empty. Further
    columns pass through; an empty table gives no rows.
    """
    gone = stored(repeated_lines(docs, **options), "gone")
    numbers = gone.agg(F.sum(F.size("gone") + 2)).first()[0] or 0
    joined = docs.alias("d").join(
        small_side(gone, numbers).alias("g"),
        F.col("d.doc_id").cast("bigint").eqNullSafe(F.col("g.doc_id"))
        & (F.xxhash64(F.col("d.text")) == F.col("g.text_key")),
        "left",
    )
    text, lost = F.col("d.text"), F.col("g.gone")
    left = F.filter(F.split(text, "\n", -1), lambda line, number: ~F.array_contains(lost, number.cast("bigint")))
    shorter = F.when(lost.isNull(), text).otherwise(F.array_join(left, "\n"))
    out = {name: F.col(f"d.`{name}`") for name in docs.columns} | {"text": shorter}
    if "n_chars" in out:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(lost.isNull(), F.col("d.n_chars")).otherwise(F.length(shorter).cast(kind))
    if count_as:
        out[count_as] = F.coalesce(F.size(lost), F.lit(0)).cast("bigint")
    return joined.select(*(column.alias(name) for name, column in out.items()))
