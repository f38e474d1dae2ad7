import math

import numpy as np
from rackpulse.llm.topk import Shard, products, top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(rows):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = set()
    for query, q in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in good if i != query)
        out |= {(query, rank, i, -score) for rank, (score, i) in enumerate(scored[:10], 1)}
    return out


def answer(df):
    return {(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(41)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.2, 8))], 1) for i in range(1500)]
    rows += [(2000 + i, rows[5][1], 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert answer(df) == expected([(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], 1), (100, None, 1), (None, [1.0, 1.0], 1), (200, [nan, 1.0], 1), (1, [inf, 0.0], 1),
        (2, [None, 1.0], 1), (3, [0.5, -0.5], None), (4, [0.5, -0.5], 1), (5, [1.0], 1), (6, [], 1), (300, [-1.0, 0.25], 1),
        (300, [-1.0, 0.25], 1), (7, [1e6, 1e6], 1), (400, [1e9, -1e9], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.selectExpr("*", "1 AS vector", "2 AS shard", "3 AS `group`", "4 AS score")
    assert answer(wide) == expected([(i, v) for i, v, _ in rows])
    assert top_k(df.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(42)
    centers = rng.integers(-400, 400, (16, 6))
    vectors = np.repeat(centers, 200, axis=0) + rng.integers(-3, 4, (3200, 6))
    shard = Shard(np.arange(3200), vectors)
    query = centers[:1] * 2
    bound = products(np.maximum(query, 0), shard.high) + products(np.minimum(query, 0), shard.low)
    for number, (_, part) in enumerate(shard.blocks):
        assert products(query, part).max() <= bound[0, number]
    found = shard.search(query, np.array([-1]), 10)[0]
    best = sorted(zip((-products(query, vectors)[0]).tolist(), range(3200)))[:10]
    assert sorted((-s, -i) for s, i in found) == best
    kth = min(found)[0]
    assert (bound[0] >= kth).sum() < len(shard.blocks) / 2


def test_large_products_stay_exact():
    big = np.array([[(1 << 31) - 1, 1 << 30]])
    assert products(big, big).tolist() == [[((1 << 31) - 1) ** 2 + (1 << 60)]]
