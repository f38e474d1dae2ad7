import collections
import math
import random
import re
import sys

import corpus
import numpy as np
from rackpulse.llm import common, lm_score
from rackpulse.llm.common import word_hashes
from rackpulse.llm.lm_score import Model, Shape, Training, Vocabulary, contexts, gradients, initial, log_probs, unpack

SMALL = Shape(groups=4, hashed=4, window=2, width=3, hidden=5)


def network(seed=1):
    rng = np.random.default_rng(seed)
    flat = initial(SMALL, rng.integers(1, 50, SMALL.classes)).astype(np.float64)
    return flat + rng.normal(0, 0.3, len(flat))


def plain_log_prob(flat, seen, target):
    net = unpack(flat, SMALL)
    x = [v for c in seen for v in net["embed"][c]]
    h = [math.tanh(sum(x[i] * net["w1"][i, j] for i in range(len(x))) + net["b1"][j]) for j in range(SMALL.hidden)]

    def logs(w, b):
        z = [sum(h[i] * w[i, j] for i in range(SMALL.hidden)) + b[j] for j in range(SMALL.groups)]
        return [v - math.log(sum(map(math.exp, z))) for v in z]

    g, w = divmod(target, SMALL.groups)
    return logs(net["wg"], net["bg"])[g] + logs(net["ww"][g], net["bw"][g])[w]


def test_scores_against_plain_python():
    flat, texts = network(), ["a b c d a", "", "b", None, "c c a"]
    words, first = word_hashes(texts)
    model = Model(Vocabulary(np.unique(words)[:3], SMALL), flat, SMALL)
    tokens, logs = lm_score.score_texts(texts, model)
    classes = model.vocabulary.classes(words)
    assert tokens.tolist() == [5, 0, 1, 0, 3]
    for number, (low, high) in enumerate(zip(first[:-1], first[1:])):
        total = 0.0
        for at in range(low, high):
            around = [classes[p] if low <= p < high else SMALL.classes for p in (at - 2, at - 1, at + 1, at + 2)]
            total += plain_log_prob(flat, around, classes[at])
        assert abs(total - logs[number]) < 1e-9


def test_probabilities_sum_to_one():
    flat = network(2)
    seen = np.tile([[1, 5, 16, 3]], (SMALL.classes, 1))
    assert abs(np.exp(log_probs(unpack(flat, SMALL), seen, np.arange(SMALL.classes), SMALL)).sum() - 1) < 1e-9


def test_gradient():
    rng = np.random.default_rng(3)
    flat, seen, target = network(3), rng.integers(0, 17, (40, 4)), rng.integers(0, 16, 40)
    grad = gradients(unpack(flat, SMALL), seen, target, SMALL)
    for place in rng.choice(len(flat), 40, replace=False):
        step = np.zeros(len(flat))
        step[place] = 1e-5
        up, down = (-log_probs(unpack(flat + s, SMALL), seen, target, SMALL).mean() for s in (step, -step))
        assert abs((up - down) / 2e-5 - grad[place]) < 1e-4


def test_passes_go_over_all_groups_at_once():
    """Only products are made group by group: exponentials over whole batches are far faster."""
    rng = np.random.default_rng(4)
    shape = Shape()
    net = unpack(initial(shape, np.ones(shape.classes)), shape)
    seen, target = rng.integers(0, shape.classes + 1, (300, 4)), rng.integers(0, shape.classes, 300)
    calls = []
    sys.setprofile(lambda _, event, what: calls.append(event))
    try:
        gradients(net, seen, target, shape)
    finally:
        sys.setprofile(None)
    assert len(calls) < 800


def test_contexts_stay_inside_the_text():
    got = contexts(np.arange(5), np.array([0, 2, 2, 5]), np.arange(5), SMALL)
    assert got.tolist() == [[16, 16, 1, 16], [16, 0, 16, 16], [16, 16, 3, 4], [16, 2, 4, 16], [2, 3, 16, 16]]


def grammar(rng, words=80):
    """Word k is followed by k + 1 most of the time."""
    out, at = [], rng.randrange(50)
    for _ in range(words):
        out.append(f"v{at}")
        at = (at + 1) % 50 if rng.random() < 0.9 else rng.randrange(50)
    return " ".join(out)


def test_held_out_texts_beat_word_frequencies_and_shuffled_texts(spark):
    rng = random.Random(51)
    shape = Shape(groups=8, hashed=8, width=8, hidden=16)
    docs = corpus.documents(spark, [grammar(rng) for _ in range(400)])
    model = lm_score.train(docs, shape, Training(rounds=3, stride=1, batch=128))
    held = [grammar(rng) for _ in range(40)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    n, logs = lm_score.score_texts(held, model)
    _, other = lm_score.score_texts(mixed, model)
    assert logs.sum() / n.sum() > -0.7 * math.log(50)
    assert (logs > other).all()


def test_every_token_is_predicted_by_default():
    how = Training()
    for words in (0, 1, 7, 1001):
        for number in range(how.rounds):
            assert sorted(lm_score.targets(number, words, how)) == list(range(words))


def test_words_of_a_class_have_their_share_of_it(spark):
    rng = random.Random(52)
    texts = [" ".join(f"r{min(rng.randrange(1, 60), rng.randrange(1, 60))}" for _ in range(30)) for _ in range(20)]
    docs, how = corpus.documents(spark, texts), Training(rounds=1, batch=64)
    model = lm_score.train(docs, SMALL, how)
    counts = collections.Counter(word for text in texts for word in text.split())
    words, first = word_hashes(texts)
    classes = model.vocabulary.classes(words)
    held = np.bincount(classes, minlength=SMALL.classes)
    assert held.tolist() == model.held.tolist()
    _, logs = lm_score.score_texts(texts, model)
    got = {r.doc_id: r.log_prob for r in lm_score.score(docs, SMALL, how).collect()}
    for number, text in enumerate(texts):
        of = classes[first[number]:first[number + 1]]
        share = sum(math.log(counts[word] / held[k]) for word, k in zip(text.split(), of))
        assert share < 0 and abs(logs[number] + share - got[number]) < 1e-3


def test_classes_grow_with_the_words():
    assert lm_score.grown(0) == lm_score.grown(1000) == Shape()
    sizes = [lm_score.grown(10 ** power).common for power in (5, 6, 7, 8)]
    assert sizes == sorted(set(sizes))


def test_odd_rows(spark):
    docs = corpus.clashing(corpus.odd_documents(spark))
    got = lm_score.score(docs).collect()
    assert len(got) == docs.count()
    for row in got:
        assert (row.mean_log_prob is None) == (row.n_tokens == 0)
        assert row.log_prob <= 0 and math.isfinite(row.log_prob)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2, 6)} == {0}
    assert lm_score.score(docs.limit(0)).count() == 0


def test_words_without_a_class_are_told_apart_without_a_search(monkeypatch):
    rng = np.random.default_rng(9)
    words = rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2)
    words[5] = words[3] + np.uint64(1)  # begins like a word with a class
    vocabulary, asked, search = Vocabulary(words[:4], SMALL), [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda held, some: asked.append(len(some)) or search(held, some))
    got = vocabulary.classes(words)
    assert got[:4].tolist() == [0, 1, 2, 3] and (got[4:] >= SMALL.common).all()
    assert asked[0] < 50


def test_words_are_hashed_two_bytes_at_once(monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab9É世 .\n\0Z") for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += [None, "", "a", "x" * 63, "x" * 64, "x" * 65, " " + "é" * 32 + " y", "é" * 3000, "end"]
    words = [word for text in texts for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())]
    factor, sums = 0x9E3779B97F4A7C15, []
    for word in words:
        sums.append(sum((byte + 1) * pow(factor, place % 4096 + 1, 1 << 64) for place, byte in enumerate(word)) % (1 << 64))
    one_by_one, whole = [], common.byte_hashes
    monkeypatch.setattr(common, "byte_hashes", lambda raw, *spans: one_by_one.append(len(raw)) or whole(raw, *spans))
    hashes, first = word_hashes(texts)
    assert hashes.tolist() == common.mix64(np.array(sums, np.uint64)).tolist()
    assert len(first) == len(texts) + 1 and first[-1] == len(words)
    assert sum(one_by_one) == sum(len(word) for word in words if len(word) > 64)
