import random
import tracemalloc

import corpus
import numpy as np
from rackpulse.llm.packing import Encoder, Index, pack, pack_shard
from rackpulse.llm.queries import vocabulary


def checked(docs, **options):
    """All packing rules over the pieces of ``docs``; the pieces by document."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary()["tokenizer"])
    pieces = pack(docs, **vocabulary(), **options).collect()
    by_doc, by_sequence = {}, {}
    for piece in pieces:
        assert len(piece.ids) == 4 * piece.length > 0
        by_doc.setdefault((piece.doc_id, piece.doc_tokens), []).append((piece.start, bytes(piece.ids)))
        by_sequence.setdefault(piece.sequence_id, []).append((piece.offset, piece.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    wanted = sorted(
        np.array(tokenizer.encode(row.text or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        for row in docs.collect()
    )
    return pieces, by_doc, wanted


def test_every_id_lies_in_one_piece(spark):
    rng = random.Random(5)
    docs = corpus.documents(spark, [corpus.text(rng, rng.randrange(1, 60)) for _ in range(60)])
    _, by_doc, wanted = checked(docs, shard_tokens=4000)
    assert sorted(b"".join(ids for _, ids in sorted(parts)) for parts in by_doc.values()) == wanted


def test_odd_rows(spark):
    docs = corpus.odd_documents(spark)
    pieces, _, wanted = checked(corpus.clashing(docs))
    assert sum(piece.length for piece in pieces) * 4 == sum(map(len, wanted))
    assert pack(docs.limit(0), **vocabulary()).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    files = vocabulary()
    tokenizer, encoder, rng = Tokenizer.from_file(files["tokenizer"]), Encoder(**files), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "the", "É", "12", "'s", "!", "<|endoftext|>", "\xa0", "　", "\x1c", "世", " of", " x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(15))) for _ in range(1500)] + [None, "", " ", "a ", " a"]
    for group in (texts, texts[:1], []):
        for value, ids in zip(group, encoder.encode(group), strict=True):
            assert ids.tolist() == tokenizer.encode(value or "", add_special_tokens=False).ids + [0]


def test_neighbours_follow_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 50, 40).astype(np.uint16) for _ in range(30)]
    index, k1, b = Index(docs), 1.2, 0.75
    free = np.ones(30, bool)
    free[0] = False
    held = {t: sum(t in d for d in docs) for t in range(50)}

    def weight(term, doc):
        count = int((docs[doc] == term).sum())
        idf = np.log1p((30 - held[term] + 0.5) / (held[term] + 0.5))
        return idf * count * (k1 + 1) / (count + k1)  # all texts are of mean length

    terms = sorted(set(docs[0].tolist()), key=lambda t: (-np.float32(weight(t, 0)), t))[:5]
    best = sorted(range(1, 30), key=lambda d: -sum(weight(t, d) for t in terms))
    found = index.neighbours(0, free, 5, 4).tolist()
    assert found[0] == best[0] and set(found) <= set(best[:6])
    assert b == 0.75


def test_index_holds_few_arrays_at_once():
    rng = np.random.default_rng(3)
    docs = [np.minimum(rng.zipf(1.3, 500), 40_000).astype(np.uint16) for _ in range(2000)]
    tracemalloc.start()
    Index(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * sum(map(len, docs))


def test_windows_hold_neighbours():
    near = [np.array([7, 8, 9, 10] * 25, np.uint16), np.array([7, 8, 9, 11] * 25, np.uint16)]
    far = [np.arange(100 * i, 100 * i + 100, dtype=np.uint16) + 1000 for i in range(8)]
    first = next(pack_shard([near[0], *far, near[1]], 128, 12, 64))
    assert [number for number, *_ in first] == [0, 9]
