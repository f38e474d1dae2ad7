"""Small corpora for the tests, made from a seed."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# A column of every name that the operators use inside.
CLASH = ["node", "key", "gone", "line", "draw", "size", "row", "part", "words", "shard", "tokens", "kept", "band"]


def sentence(rng, words=12, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words)).capitalize() + "."


def text(rng, sentences=6, vocabulary=400):
    return "\n".join(sentence(rng, rng.randrange(8, 16), vocabulary) for _ in range(sentences))


def documents(spark, texts, sources=("a", "b")):
    rows = [(i, t, "en", sources[i % len(sources)], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows."""
    rng = random.Random(3)
    long = " ".join(f"x{rng.randrange(10**6)}" for _ in range(30_000))
    same = text(rng)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, same, "en", "a", 5), (3, same, "en", "b", 5),
        (3, same, "en", "b", 5), (4, same, "en", None, 5), (5, long, "en", "a", len(long)), (6, " \n\t ", "en", "a", 4),
        (7, "one two", "de", "b", 7), (None, None, "en", "b", None), (8, "\x00 zero\x00 a <|endoftext|> b", "fr", "b", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(docs):
    for name in CLASH:
        docs = docs.selectExpr("*", f"'x' AS `{name}`")
    return docs


def plain_words(value):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (value or "").lower())


def shingles(value, width=5):
    words = plain_words(value)
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(one, other):
    return len(one & other) / len(one | other) if one and other else 0.0


def roots(nodes, edges):
    """Smallest connected node of each, one after another."""
    root = {node: node for node in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root
