import random
import re

import corpus
from rackpulse.llm.licenses import BASE, TEMPLATES, Automaton, automaton, license_words, scan, scan_text

MACHINE = automaton()
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    places, labels = [], set()
    for phrase, label in BASE.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def odd_texts():
    rng = random.Random(21)
    parts = ["CC BY", "cc", "by", "-", "cc-by", "General Public License", "general", "All rights\nreserved", "É", "ccé", "  ", "x9"]
    return [" ".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "cc by cc by"]


def test_base_columns():
    for text in odd_texts():
        got = scan_text(text.encode(), MACHINE)
        assert got[:5] == base(text)
        assert set(filter(None, got[4].split(","))) <= set(got[5].split(",")) and 0 <= got[6] <= 1


def test_matching_statistics():
    rng = random.Random(22)
    for _ in range(60):
        sequences = [[rng.choice(b"abc"[:2 + _ % 2]) for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        machine = Automaton(sequences)
        text = [rng.choice(b"abc") for _ in range(40)]
        known = [machine.number.get(t, -1) for t in text]

        def inside(part):
            return [(w, e + len(part) - 1) for w, s in enumerate(sequences) for e in range(len(s) - len(part) + 1)
                    if s[e:e + len(part)] == part]

        longest = [max(n for n in range(i + 1) if n == 0 or inside(text[i - n:i])) for i in range(41)]
        want = {(i, longest[i]) for i in range(1, 41) if longest[i] >= 2 and (i == 40 or longest[i + 1] <= longest[i])}
        got = list(machine.matches(known, 2))
        assert {(stop, length) for stop, length, _ in got} == want
        for stop, length, state in got:
            assert machine.ends[state] == sorted(inside(text[stop - length:stop]))


def test_every_template_is_found():
    rng = random.Random(23)
    for label, text in TEMPLATES:
        before, after = corpus.text(rng, 3), corpus.text(rng, 3)
        got = scan_text(f"{before}\n{text}\n{after}".encode(), MACHINE)
        assert label in got[5].split(",") and got[6] == 1.0
        span = max(got[7], key=lambda s: s["cover"])
        assert span["start"] >= len(license_words(before))
    words = license_words(TEMPLATES[0][1])
    words[30:33] = [b"changed"]
    assert "mit" in scan_text(b" ".join(words), MACHINE)[5].split(",")
    assert scan_text(corpus.text(rng, 30).encode(), MACHINE)[5:7] == ("", 0.0)


def test_odd_rows(spark):
    docs = corpus.clashing(corpus.odd_documents(spark))
    got = sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in scan(docs).collect())
    assert got == sorted(repr((r.doc_id, *base(r.text))) for r in docs.collect())
    assert scan(docs.limit(0)).count() == 0


def test_very_many_phrases_in_one_text():
    got = scan_text(b"cc by " * 300_000, MACHINE)
    assert got[:5] == (600_000, 300_000, 0, 599_998, "cc-by")
