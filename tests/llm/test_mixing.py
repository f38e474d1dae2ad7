import hashlib
import random
import re

import corpus
import pytest
from rackpulse.llm.mixing import SHAPES, first_words, integrals, mix, plan_mix, progress_at
from pyspark.sql import functions as F


def water(sizes):
    """Targets by the rule, resharing until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {name: (1.0, 2.0, 3.0)[i % 3] for i, name in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[n] for n in capped)
        open_weight = sum(weight[n] for n in names if n not in capped)
        target = {n: 3.0 * sizes[n] if n in capped else left * weight[n] / open_weight for n in names}
        above = {n for n in names if n not in capped and target[n] > 3 * sizes[n]}
        if not above:
            return target
        capped |= above


def expected(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", row.text or "")) for row in rows]
    sizes = {}
    for row, n in zip(rows, size):
        sizes[row.source] = sizes.get(row.source, 0) + n
    target = water(sizes)
    out = []
    for source in sizes:
        mine = []
        for row, n in zip(rows, size):
            if row.source == source:
                value = " ".join(str(x) for x in (row.doc_id, row.text) if x is not None)
                mine.append((hashlib.md5(value.encode()).hexdigest(), n, row.doc_id))
        goal, at, taken = round(target[source]), 0, [0] * len(mine)
        mine.sort(key=lambda m: (m[0], -1 if m[2] is None else m[2], m[1]))
        for _ in range(3):
            for i, (_, n, _) in enumerate(mine):
                taken[i] += max(0, min(goal - at, n))
                at += n
        out += [(doc, n, sizes[source], t) for (_, n, doc), t in zip(mine, taken)]
    return sorted(out, key=repr), target


@pytest.mark.parametrize("sources", [("a",), ("a", "b"), ("a", "b", "c", "d", None), tuple("abcdefgh")])
def test_against_plain_python(spark, sources):
    rng = random.Random(len(sources))
    docs = corpus.documents(spark, [corpus.text(rng, rng.randrange(0, 9)) for _ in range(50)], sources)
    got = plan_mix(docs).collect()
    want, target = expected(docs.collect())
    assert sorted(((r.doc_id, r.size, r.source_size, r.taken) for r in got), key=repr) == want
    assert sum(r.taken for r in got) == pytest.approx(sum(target.values()), abs=len(target))
    assert all(r.taken <= 3 * r.size for r in got)
    assert {round(r.target, 6) for r in got} == {round(t, 6) for t in target.values()}


def test_odd_rows_and_reruns(spark):
    docs = corpus.clashing(corpus.odd_documents(spark))
    got = plan_mix(docs)
    want, _ = expected(docs.collect())
    assert sorted(((r.doc_id, r.size, r.source_size, r.taken) for r in got.collect()), key=repr) == want
    assert plan_mix(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
    again = plan_mix(docs.repartition(7))
    assert sorted(map(repr, again.collect())) == sorted(map(repr, got.collect()))


def test_mixed_rows(spark):
    docs = corpus.clashing(corpus.odd_documents(spark))
    mixed = mix(docs)
    assert mixed.columns == docs.columns
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    assert mixed.agg(F.sum(words)).first()[0] == plan_mix(docs).agg(F.sum("taken")).first()[0]


def test_positions_invert_the_schedules(spark):
    shares = [i / 50 for i in range(51)]
    rows = spark.createDataFrame([(s, k) for s in shares for k in range(3)], "s double, k int")
    for row in rows.withColumn("t", progress_at(F.col("s"), F.col("k"))).collect():
        area = total = 0.0
        for (low, left), (high, right) in zip(SHAPES[row.k], SHAPES[row.k][1:]):
            total += (left + right) / 2 * (high - low)
            upto = min(max(row.t, low), high)
            area += (left + left + (right - left) * (upto - low) / (high - low)) / 2 * (upto - low)
        assert area / total == pytest.approx(row.s, abs=1e-9)
    assert len(integrals(SHAPES)) == 3


def test_sources_follow_their_schedule(spark):
    rng = random.Random(8)
    docs = corpus.documents(spark, [corpus.text(rng) for _ in range(300)], ("a", "b", "c"))
    mean = dict(
        plan_mix(docs).select("source_size", F.explode("parts").alias("p")).groupBy("source_size")
        .agg(F.avg("p.position")).collect()
    )
    sizes = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    assert mean[sizes["a"]] < mean[sizes["b"]] < mean[sizes["c"]]


def test_no_python_in_the_plan(spark, capsys):
    mix(corpus.odd_documents(spark)).explain()
    shown = capsys.readouterr().out
    assert "Python" not in shown and "Pandas" not in shown and "Arrow" not in shown


def test_first_words(spark):
    row = spark.range(1).select(first_words(F.lit(" a  b\nc d"), F.lit(3)).alias("t")).first()
    assert row.t == "a b c"
