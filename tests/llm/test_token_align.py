import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from corpus import clashing, documents, odd_documents, text
from rackpulse.llm import token_align
from rackpulse.llm.queries import vocabulary
from rackpulse.llm.token_align import align, with_pair_counts

FILES = {**vocabulary(), "pieces": public_tokenizers.path("piece_bpe_32k.model")}


def byte_letters():
    """The printable letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(byte): byte for byte in plain}
    rest = [byte for byte in range(256) if byte not in plain]
    return table | {chr(256 + place): byte for place, byte in enumerate(rest)}


def tokens_of(value):
    """(id, bytes) on both sides by the tokenizers' own libraries, or two empty lists."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(FILES["tokenizer"])
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=FILES["pieces"])
    if not value:
        return [], []
    letters = byte_letters()
    a = [(i, bytes(letters[c] for c in first.id_to_token(i)))
         for i in first.encode(" " + value, add_special_tokens=False).ids]
    b = []
    for i in second.encode(value):
        piece = second.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + value).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    return a, b


def spans(tokens):
    at, out = 0, []
    for number, held in tokens:
        out.append((number, at, at + len(held)))
        at += len(held)
    return out


def expected(texts):
    """Rows by plain loops over all pairs of tokens."""
    links, rows = {}, []
    for place, value in enumerate(texts):
        a, b = (spans(side) for side in tokens_of(value))
        links[place] = [(x, y) for x, _, e in a for y, _, f in b if e == f]
        groups, left, right = [], [], []
        ends = {e for *_, e in a} & {e for *_, e in b}
        events = sorted([(e, 0, x) for x, _, e in a] + [(e, 1, x) for x, _, e in b])
        for end in sorted(ends):
            while events and events[0][0] <= end:
                _, side, number = events.pop(0)
                (right if side else left).append(str(number))
            groups.append(",".join(left) + "|" + ",".join(right))
            left, right = [], []
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append([len(a), len(b), len(groups), len(links[place]), sha])
    count = Counter(pair for held in links.values() for pair in held)
    best = {}
    for (_, y), uses in count.items():
        best[y] = max(best.get(y, 0), uses)
    return [
        (n_a, n_b, groups, n_links, sum(count[p] == best[p[1]] for p in links[place]), sum(count[p] for p in links[place]), sha)
        for place, (n_a, n_b, groups, n_links, sha) in enumerate(rows)
    ]


def result(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(((r.doc_id, *(r[n] for n in names)) for r in df.collect()), key=repr)


TEXTS = [
    "Straßenbahn   und\tübermäßig\n\n lange Wörter", "plain words, plain words; and more!", "", None,
    "mark ▁ inside", "tail ", " head", "中文 日本語 \U0001f600 mixed", "<|endoftext|> is text <s> </s> <unk> <0x41>",
    "a b c  d", "x" * 3000, "tab\ttab\r\nline sep", "é nfd ﬁ ligature Ａ wide", "\x00 zero \x07",
]


def test_against_plain_loops(spark):
    rng = random.Random(9)
    texts = TEXTS + [text(rng, 3) for _ in range(6)] + ["plain words, plain words; and more!"] * 3
    docs = documents(spark, texts).repartition(3)
    want = sorted(((i, *row) for i, row in enumerate(expected(texts))), key=repr)
    assert result(with_pair_counts(docs, **FILES)) == want
    assert any(row[1] == 0 and texts[row[0]] for row in want), "a text that one side does not spell"


def test_shuffled_pairs_give_the_same(spark, monkeypatch):
    docs = documents(spark, TEXTS)
    want = result(with_pair_counts(docs, **FILES))
    monkeypatch.setattr(token_align, "small_side", lambda side, rows: side)
    assert result(with_pair_counts(docs, **FILES)) == want


def test_overlaps_are_all_pairs_that_share_a_byte(spark):
    rng = random.Random(10)
    texts = TEXTS + [text(rng, 2)]
    for row in align(documents(spark, texts), **FILES).collect():
        a, b = (spans(side) for side in tokens_of(texts[row.doc_id]))
        assert (row.a_ids, row.b_ids) == ([x for x, *_ in a], [y for y, *_ in b])
        assert (row.a_ends, row.b_ends) == ([e for *_, e in a], [e for *_, e in b])
        met = [(i, j) for i, (_, s, e) in enumerate(a) for j, (_, t, f) in enumerate(b) if s < f and t < e]
        assert sorted(zip(row.over_a, row.over_b)) == met
        assert list(zip(row.cut_a, row.cut_b)) == [(i, j) for i, j in met if a[i][2] == b[j][2]]


@pytest.mark.parametrize("shape", ["odd", "clashing", "empty"])
def test_odd_tables(spark, shape):
    docs = odd_documents(spark)
    if shape == "clashing":
        docs = clashing(docs).selectExpr("*", "1 AS pair", "2 AS uses", "3 AS a_ids")
    if shape == "empty":
        docs = docs.limit(0)
    got = result(with_pair_counts(docs, **FILES))
    if shape == "empty":
        assert got == []
        return
    assert len(got) == docs.count()
    by_id = {}
    for row in got:
        by_id.setdefault(row[0], set()).add(row[1:])
    assert by_id[1] == by_id[2] == {(0, 0, 0, 0, 0, 0, "")} and len(by_id[3]) == 1 and by_id[3] == by_id[4]
    assert min(row[0] for row in by_id[5]) > 30_000
