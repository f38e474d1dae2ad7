import random

import corpus
import numpy as np
from rackpulse.llm.chunks import LEAST, MOST, chunked, cut_points, dedup_substrings, gear_hashes, _GEAR


def test_gear_hash_is_rolling():
    raw = np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8)
    h, want = 0, []
    for byte in raw.tolist():
        h = (2 * h + int(_GEAR[byte])) % (1 << 16)
        want.append(h)
    assert gear_hashes(raw).tolist() == want


def test_chunks_tile_the_text_and_resist_shifts():
    rng = random.Random(2)
    text = "é ".join(corpus.text(rng, 40).split(" ")).encode()
    ends = cut_points(np.frombuffer(text, np.uint8))
    assert ends[-1] == len(text) and all(LEAST <= b - a <= MOST + 4 for a, b in zip([0, *ends], ends[:-1]))
    for a, b in zip([0, *ends], ends):
        text[a:b].decode()
    moved = b"inserted " + text
    other = cut_points(np.frombuffer(moved, np.uint8))
    pieces = {text[a:b] for a, b in zip([0, *ends], ends)}
    again = {moved[a:b] for a, b in zip([0, *other], other)}
    assert len(pieces - again) <= 5
    assert cut_points(np.frombuffer(b"", np.uint8)) == [] and cut_points(np.frombuffer(b"a", np.uint8)) == [1]


def expected(texts, least=20):
    """Passages by plain dictionaries over the chunks."""
    chunks = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        ends = cut_points(np.frombuffer(raw, np.uint8))
        chunks.append([(a, b, raw[a:b]) for a, b in zip([0, *ends], ends)])
    uses = {}
    for i, row in enumerate(chunks):
        for k, (_, _, piece) in enumerate(row):
            uses.setdefault(piece, []).append((i, k))
    out = []
    for i, row in enumerate(chunks):
        raw = (texts[i] or "").encode()
        starts = [p for p in range(len(raw)) if raw[p] not in b" \t\n\v\f\r" and (p == 0 or raw[p - 1] in b" \t\n\v\f\r")]
        found = {}
        for name, good in (("shared", lambda k, piece: len(uses[piece]) > 1),
                           ("later", lambda k, piece: uses[piece][0] != (i, k))):
            runs = []
            for k, (a, b, piece) in enumerate(row):
                if good(k, piece):
                    if runs and runs[-1][2] == k - 1:
                        runs[-1][1:] = [b, k]
                    else:
                        runs.append([a, b, k])
            found[name] = [(a, b) for a, b, _ in runs if sum(a <= p < b for p in starts) >= least]
        out.append(found)
    return out


def test_against_dictionaries(spark):
    rng = random.Random(7)
    passage = " ".join(f"p{rng.randrange(10**5)}" for _ in range(60))
    texts = [corpus.text(rng, 5, 10**6) for _ in range(30)]
    for i in (3, 8, 20):
        at = rng.randrange(len(texts[i]))
        texts[i] = texts[i][:at] + " " + passage + " " + texts[i][at:]
    texts += [texts[0]] * 12 + ["ab " * 400, ""]
    want = expected(texts)
    for row in dedup_substrings(corpus.documents(spark, texts)).collect():
        found = want[row.doc_id]
        assert [(s.start, s.stop) for s in row.shared] == found["shared"]
        assert [(s.start, s.stop) for s in row.later] == found["later"]
        raw, at, kept = texts[row.doc_id].encode(), 0, b""
        for a, b in found["later"]:
            kept += raw[at:a]
            at = b
        assert row.text.encode() == kept + raw[at:]
    assert all(want[i]["shared"] for i in (3, 8, 20)) and not want[5]["shared"]


def test_odd_rows(spark):
    docs = corpus.clashing(corpus.odd_documents(spark))
    got = dedup_substrings(docs).collect()
    assert len(got) == docs.count()
    texts = {(r.doc_id, r.n_bytes): r.text for r in got}
    assert texts[1, 0] == "" and texts[2, 0] == ""
    assert next(r for r in got if r.doc_id == 4).later_bytes > 0
    assert not any(r.later_bytes for r in got if r.doc_id in (5, 7, 8))
    assert dedup_substrings(docs.limit(0)).count() == 0 and chunked(docs.limit(0)).count() == 0
