"""License scans: base phrases, and template texts matched by a suffix automaton."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Texts of well-known notices, by the label they stand for.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions: The above copyright notice and this permission notice shall be included in all "
            "copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2."),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl", "under the terms of the GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc0-1.0", "CC0 1.0 Universal public domain dedication"),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("reserved", "Copyright. All rights reserved. No part may be reproduced without written permission."),
)
# Matches of at least this many words are chained; a chain may skip as many words of the
# text as MOST_GAP; it counts if it covers this share of its template.
LEAST_MATCH, MOST_GAP, LEAST_COVER = 4, 8, 0.8

# Letters, digits and bytes beyond ASCII make words; all else is a blank.
_BLANKS = bytes(
    byte if byte >= 0x80 or 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A else 0x20 for byte in range(256)
)

RESULT = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, spans array<struct<label string, start bigint, stop bigint, cover double>>")
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())]))


def license_words(text: str | bytes) -> list[bytes]:
    """Words in which only A-Z are lower-cased."""
    raw = text.encode() if isinstance(text, str) else text
    return raw.lower().translate(_BLANKS).split()


class Automaton:
    """Suffix automaton of several word sequences, with the places where each state ends."""

    def __init__(self, sequences: list[list[bytes]]) -> None:
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]
        for which, words in enumerate(sequences):
            state = 0
            for place, word in enumerate(words):
                state = self._extend(state, self.number.setdefault(word, len(self.number)), ends)
                ends[state].add((which, place))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                ends[self.link[state]] |= ends[state]
        self.ends = [sorted(held) for held in ends]
        self.sizes = [len(words) for words in sequences]

    def _new(self, length: int, after: dict[int, int], link: int, ends: list) -> int:
        self.next.append(dict(after))
        self.link.append(link)
        self.length.append(length)
        ends.append(set())
        return len(self.length) - 1

    def _split(self, state: int, symbol: int, ends: list) -> int:
        """The state for exactly ``length[state] + 1`` words along ``symbol``."""
        target = self.next[state][symbol]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._new(self.length[state] + 1, self.next[target], self.link[target], ends)
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int, ends: list) -> int:
        if symbol in self.next[last]:
            return self._split(last, symbol, ends)
        made = self._new(self.length[last] + 1, {}, 0, ends)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = made
            last = self.link[last]
        if last >= 0:
            self.link[made] = self._split(last, symbol, ends)
        return made

    def matches(self, symbols: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(stop, length, state) of the matches that the next word does not extend."""
        state = length = 0
        for place, symbol in enumerate(symbols):
            if symbol not in self.next[state]:
                if length >= least:
                    yield place, length, state
                while state and symbol not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
        if length >= least:
            yield len(symbols), length, state


def automaton(templates=TEMPLATES) -> Automaton:
    return Automaton([license_words(text) for _, text in templates])


def template_spans(words: list[bytes], machine: Automaton, least: int = LEAST_MATCH, gap: int = MOST_GAP
                   ) -> list[tuple[int, int, int, float]]:
    """(template, start, stop, cover) of the chains of long matches, best cover per template and place.

    A chain goes forward in the text, by at most ``gap`` words at a time, and forward in
    the template; its cover is the share of the template's words that it matches.
    """
    known = np.fromiter((machine.number.get(word, -1) for word in words), np.int64, len(words))
    edges = np.flatnonzero(np.diff((known >= 0).view(np.int8), prepend=0, append=0))
    segments: dict[int, list[tuple[int, int, int]]] = {}
    for low, high in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
        if high - low < least:
            continue
        for stop, length, state in machine.matches(known[low:high].tolist(), least):
            for which, end in machine.ends[state]:
                segments.setdefault(which, []).append((low + stop - length, end - length + 1, length))
    spans = []
    for which, found in segments.items():
        chains: list[list[int]] = []  # text start, text stop, template stop, covered
        stops: list[tuple[int, int]] = []  # text stop and number of each chain, sorted
        for start, at, length in sorted(found):
            grown = None
            for _, number in reversed(stops[bisect_left(stops, (start - gap, 0)):]):
                chain = chains[number]
                skip = max(0, chain[1] - start, chain[2] - at)
                if skip < length and start + skip - chain[1] <= gap:
                    held = [chain[0], start + length, at + length, chain[3] + length - skip]
                    if grown is None or held[3] > grown[3]:
                        grown = held
            alone = [start, start + length, at + length, length]
            chains.append(grown if grown and grown[3] > length else alone)
            insort(stops, (chains[-1][1], len(chains) - 1))
        best: dict[int, list[int]] = {}
        for chain in chains:
            if chain[0] not in best or chain[3] > best[chain[0]][3]:
                best[chain[0]] = chain
        spans += [(which, chain[0], chain[1], chain[3] / machine.sizes[which]) for chain in best.values()]
    return sorted(spans, key=lambda span: (span[1], span[2], span[0]))


def scan_text(text: bytes, machine: Automaton, templates=TEMPLATES, cover: float = LEAST_COVER) -> tuple:
    """The result columns after ``doc_id`` for one text."""
    words = license_words(text)
    joined = b" " + b" ".join(words) + b" "
    places, found = [], set()
    for phrase, label in BASE.items():
        sought = b" " + phrase.encode() + b" "
        at = joined.find(sought)
        counted = word = 0  # words before the place ``counted``
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            places.append(word)
            found.add(label)
            at = joined.find(sought, at + 1)
    spans = template_spans(words, machine)
    good = [
        {"label": templates[which][0], "start": start, "stop": stop, "cover": share}
        for which, start, stop, share in spans if share >= cover
    ]
    labels = found | {span["label"] for span in good}
    score = min(1.0, max((share for *_, share in spans), default=0.0))
    return (
        len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found)),
        ",".join(sorted(labels)), score, good,
    )


def scan(docs: DataFrame, templates=TEMPLATES, cover: float = LEAST_COVER) -> DataFrame:
    """Base phrases, labels and template spans per row of ``docs``.

    Each text streams once through the suffix automaton of all template words, which
    gives the longest template substring ending at each word. Matches of four words or
    more are chained; a template whose chain covers enough of it gives its label.
    ``score`` is the best cover. The automaton has at most two states per template word.

    A null text counts as empty; null ids are kept; equal rows are scanned each;
    further columns are not read; an empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _SPAN]
        machine = automaton(templates)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            rows = [scan_text(text or b"", machine, templates, cover) for text in texts]
            columns = [pa.array([row[place] for row in rows], kind) for place, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, RESULT)
