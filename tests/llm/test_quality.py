import random
import re

import corpus
from rackpulse.llm import quality
from rackpulse.llm.quality import base_counts, common_words, divergence, good, judge
import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_base_counts():
    rng = random.Random(4)
    parts = ["a", "b", "é", "\n", " ", "\t", "#", "|", "\x0b", "\xa0", "\x1c", "世 ", "the ", "x y "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(120))) for _ in range(400)]
    texts += ["a b " * 30, "", "one", corpus.text(rng) * 2]
    for text in texts:
        assert base_counts(text.encode()) == counted(text)


def test_divergence():
    one, other = np.array([1.0, 0]), np.array([0, 1.0])
    assert divergence(one, one) == 0 and divergence(one, other) == 1


def corpus_with_junk(spark):
    rng = random.Random(6)
    common = ["the", "of", "and", "to", "in", "is", "that", "it"]

    def prose():
        return " ".join(rng.choice(common) if rng.random() < 0.5 else f"word{rng.randrange(900)}" for _ in range(150))

    junk = [" ".join(f"QX{rng.randrange(10**6)}!!" for _ in range(150)) for _ in range(8)]
    return corpus.documents(spark, [prose() for _ in range(120)] + junk)


def test_verdicts(spark):
    kept = {r.doc_id: r.kept for r in judge(corpus_with_junk(spark)).collect()}
    assert all(kept[i] for i in range(120)) and not any(kept[i] for i in range(120, 128))


def test_odd_rows(spark):
    docs = corpus.clashing(corpus.odd_documents(spark))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted(repr((r.doc_id, *(r[n] for n in names))) for r in judge(docs).collect())
    assert got == sorted(repr((r.doc_id, *counted(r.text))) for r in docs.collect())
    for row in judge(docs).collect():
        assert row.base_failed == (row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words)
        assert not (row.base_failed and row.kept)
    assert judge(docs.limit(0)).count() == 0
    assert good(docs).columns == docs.columns
    assert good(docs).count() == judge(docs).where("kept").count()
    # Without a language only the base rules judge.
    assert good(docs.select("doc_id", "text")).count() == judge(docs).where("not base_failed").count()


def test_common_words_do_not_depend_on_chunks(spark, monkeypatch):
    """A word that is rare in one chunk is counted there too."""
    monkeypatch.setattr(quality, "_CHUNK_WORDS", 60)  # the first twenty texts fill a chunk
    texts = [f"wide low x{n}" for n in range(20)] + ["wide y"] + [f"z{n}" for n in range(19)]
    docs = spark.createDataFrame([(n, text, "en") for n, text in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1)
    assert common_words(docs, most=1) == {"en": [b"wide"]}
