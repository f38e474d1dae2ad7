import random
import re

import numpy as np
import pytest
from corpus import clashing, documents, jaccard, odd_documents, roots
from rackpulse.llm import minmax_dedup
from rackpulse.llm.minmax_dedup import choose_bands, near_duplicates, shared_matrix, shingles, signature, similarity, spanning


def lower(value):
    return re.sub("[A-Z]", lambda found: found.group().lower(), value or "")


def windows(value):
    words = re.findall("[^\x20\x09-\x0d]+", lower(value))
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def expected(rows):
    """doc_id, size of the set, component and kept of every row, all pairs compared."""
    held = [(i, windows(value)) for i, value in rows]
    edges = [
        (i, j) for at, (i, one) in enumerate(held) for j, other in held[:at]
        if i is not None and j is not None and one and other and 100 * len(one & other) >= 85 * len(one | other)
    ]
    root = roots([i for i, _ in held if i is not None], edges)
    return sorted(((i, len(one), root.get(i), i == root.get(i)) for i, one in held), key=repr)


def result(docs):
    return sorted((tuple(row) for row in near_duplicates(docs).collect()), key=repr)


def words(rng, count):
    return [f"w{rng.randrange(5000)}" for _ in range(count)]


def changed(rng, base, times):
    out = list(base)
    for _ in range(times):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**9)}"
    return " ".join(out)


def corpus(rng):
    """Near copies on both sides of the limit, chains of them, copies, and texts of their own."""
    texts = [" ".join(words(rng, rng.randrange(1, 60))) for _ in range(80)]
    for size in (7, 20, 60, 120, 250):
        base = words(rng, size)
        texts += [changed(rng, base, rng.randrange(0, 1 + size // 30)) for _ in range(12)]
    chain = words(rng, 90)
    for step in range(25):
        chain = chain[2:] + words(rng, 2)
        texts.append(" ".join(chain))
    texts += [texts[0].upper(), "\t" + texts[1].replace(" ", "\n"), "Ärger ÄRGER x", "ärger ärger x"]
    rng.shuffle(texts)
    return texts


def test_against_all_pairs(spark):
    texts = corpus(random.Random(61))
    docs = documents(spark, texts).repartition(5)
    want = expected(list(enumerate(texts)))
    assert result(docs) == want
    assert any(i != root for i, _, root, _ in want)


@pytest.mark.parametrize("block", [4, 256])
def test_large_group_around_the_limit(spark, monkeypatch, block):
    """Most pairs of the group are no link; what links it lies outside the leaders' pairs."""
    monkeypatch.setattr(minmax_dedup, "BLOCK", block)
    rng = random.Random(62)
    base = words(rng, 100)
    texts = [changed(rng, base, rng.choice([1, 2, 3, 4])) for _ in range(90)]
    seen = []
    whole = minmax_dedup.links_of_strays

    def watched(*args):
        found = whole(*args)
        seen.append(0 if found is None else found.count())
        return found

    monkeypatch.setattr(minmax_dedup, "links_of_strays", watched)
    want = expected(list(enumerate(texts)))
    assert len({root for _, _, root, _ in want}) > 1
    assert result(documents(spark, texts)) == want
    assert seen and seen[0] > 0


@pytest.mark.parametrize("shape", ["odd", "clashing", "empty"])
def test_odd_tables(spark, shape):
    docs = odd_documents(spark)
    if shape == "clashing":
        docs = clashing(docs).selectExpr("*", "1 AS root", "2 AS bucket", "3 AS place", "4 AS salt", "5 AS component_id")
    if shape == "empty":
        docs = docs.limit(0)
    want = expected([(row.doc_id, row.text) for row in docs.collect()])
    assert result(docs) == [(i, n, root, kept if i is not None else True) for i, n, root, kept in want]


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = ("red green blue " * 9, "one two three four", "five six seven eight nine")
    docs = spark.createDataFrame([(1, b), (5, a), (5, b), (7, a), (7, c), (9, c), (8, "alone")], "doc_id bigint, text string")
    assert {(row.doc_id, row.component_id) for row in near_duplicates(docs).collect()} == {(1, 1), (5, 1), (7, 1), (9, 1), (8, 8)}


def test_half_the_evaluations_and_no_bias():
    bands, rows = choose_bands()
    assert bands % 2 == 0 and 1 - (1 - 0.85 ** rows) ** bands >= 0.99999
    rng = random.Random(63)
    text = words(rng, 120)
    one, other = shingles([" ".join(text), changed(rng, text, 4)])
    truth = jaccard(set(one.tolist()), set(other.tolist()))
    first, second = signature(one, 4000), signature(other, 4000)
    assert first.shape == (2, 4000)
    assert abs(similarity(first, second) - truth) < 0.02
    # Two values of a function err less together than one of them does.
    both = (first == second).mean(axis=0).var()
    assert both < (first[0] == second[0]).var() * 0.7


def test_matrix_and_tree():
    rng = np.random.default_rng(64)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 30)).astype(np.uint64)) for _ in range(17)]
    got = shared_matrix(sets[:9], sets[9:])
    assert got.tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in sets[9:]] for a in sets[:9]]
    assert spanning(np.array([1, 2, 1, 4]), np.array([2, 3, 3, 3])).tolist() == [0, 1, 3]
