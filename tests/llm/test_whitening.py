import math
from fractions import Fraction

import numpy as np
import pytest
from rackpulse.llm import whitening
from rackpulse.llm.whitening import filtered, leading, whiten, whitened_rows

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def usable(rows):
    return [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]


def expected(rows, most=32):
    """Means and deviations in whole numbers, eigenvectors by a dense solver."""
    good = usable(rows)
    n, dim = len(good), len(good[0][1])
    sums = [sum(v[d] for _, v in good) for d in range(dim)]
    deviation = [sum((n * v[d] - sums[d]) ** 2 for d in range(dim)) for _, v in good]
    centred = np.array([[float(Fraction(n * v[d] - sums[d], n)) for d in range(dim)] for _, v in good])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:most]
    order = order[values[order] > 1e-12 * values.max()]
    return good, deviation, centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


def check(df, rows, digits=1e-8):
    good, deviation, turned, share = expected(rows)
    held, fitted = whiten(df)
    got = {}
    for row in held.collect():
        got.setdefault((row.vec_id, int(row.deviation)), []).append(row.whitened)
    want = {}
    for (number, _), apart, line in zip(good, deviation, turned):
        want.setdefault((number, apart), []).append(line)
    assert got.keys() == want.keys() and all(len(got[k]) == len(want[k]) for k in got)
    ours, theirs = (np.array([line for k in sorted(want, key=repr) for line in side[k]]) for side in (got, want))
    sign = np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours * sign - theirs).max() < digits
    assert np.allclose(fitted.explained, share, rtol=1e-9)
    assert fitted.identity_error < 1e-9


def test_against_dense_solver(spark):
    rng = np.random.default_rng(51)
    turn = np.linalg.qr(rng.normal(size=(70, 70)))[0]
    data = rng.normal(size=(900, 70)) * np.linspace(6, 0.4, 70) @ turn + rng.normal(size=70) * 3
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(data)]
    check(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5), rows)


def test_close_eigenvalues_are_told_apart(spark):
    rng = np.random.default_rng(52)
    data = rng.normal(size=(4000, 48)) * 2
    rows = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(data)]
    check(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), rows, 1e-6)


def test_odd_rows(spark):
    nan, inf, rng = float("nan"), float("inf"), np.random.default_rng(53)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=5))]) for i in range(40)]
    odd = [(50, None), (51, []), (52, [1.0, None, 0.0, 0.0, 0.0]), (53, [nan] * 5), (54, [0.0, inf, 0.0, 0.0, 0.0]),
           (55, [-inf, 0.0, 0.0, 0.0, 0.0]), (None, [0.5, -0.25, 0.125, 3.0, -4.0]), *rows[:3], *rows[:2]]
    other = [(60, [1.0, 2.0]), (61, [1.0] * 9)]
    df = spark.createDataFrame([(i, v, None) for i, v in rows + odd + other], SCHEMA)
    wide = df.selectExpr("*", "1 AS dim", "2 AS entries", "3 AS whitened", "4 AS place")
    check(wide, rows + odd)
    out = whitened_rows(wide).collect()
    assert len(out) == (40 + 6) * 5 and {row.n for row in out} == {46} and {row.component for row in out} == {1, 2, 3, 4, 5}
    assert whitened_rows(df.limit(0)).count() == 0
    assert whitened_rows(df.where("vec_id > 49 and vec_id < 56")).count() == 0


def test_directions_without_variance_are_left_out(spark):
    flat = [(i, [1.5, 2.5, float(i % 7), 2.0 * (i % 7)]) for i in range(30)]
    check(spark.createDataFrame([(i, v, 0) for i, v in flat], SCHEMA), flat)
    same = spark.createDataFrame([(i, [1.5, 2.5], 0) for i in range(9)], SCHEMA)
    assert whitened_rows(same).count() == 0


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2.0 ** 40 * (i % 5)), float(i), float(-(i ** 2))]) for i in range(50)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    _, deviation, _, _ = expected(rows)
    held, _ = whiten(df)
    assert sorted(int(r.deviation) for r in held.collect()) == sorted(deviation)
    assert {r.deviation for r in whitened_rows(df).collect()} == {d if d < 1 << 63 else None for d in deviation}


def test_filter_damps_the_unwanted_part():
    values = np.linspace(0, 1, 200)
    start = np.ones((200, 1))
    out = np.abs(filtered(lambda block: values[:, None] * block, start, 0.5, 1.0, 12))[:, 0]
    assert out[-1] == pytest.approx(1) and out[values <= 0.5].max() < 1e-7
    assert (np.diff(out[values > 0.55]) > 0).all()


def test_uncertified_results_are_refused(monkeypatch):
    monkeypatch.setattr(whitening, "ACCEPTED", 0.0)
    values = np.linspace(1, 1.001, 300)[::-1]
    with pytest.raises(ArithmeticError):
        leading(lambda block: values[:, None] * block, 300, 4, 2, 2, rounds=2)
