"""Hard negatives against plain Python over all pairs of rows."""

import math
import random

import pytest

from narrata.llm import negatives as op

SCHEMA = "vec_id long, embedding array<float>, label int, score long, x string, place int"


def brute(rows, every=50, many_positives=5, many=3):
    """Rows (vec_id, embedding, label) as the operator mines them."""
    fine = []
    for i, e, label in rows:
        if i is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        fine.append((i, [math.floor(256 * x) for x in e], label))
    out = []
    for n, (i, a, label) in enumerate(fine):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a, b)), j, other) for m, (j, b, other) in enumerate(fine) if m != n and len(a) == len(b)]
        scored.sort()
        for p, j, _ in [x for x in scored if x[2] == label][:many_positives]:
            found = [(q, k) for q, k, other in scored if other != label and 50 * -p <= 100 * -q <= 95 * -p][:many]
            out += [(i, j, r + 1, k, -p, -q) for r, (q, k) in enumerate(found)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    # few distinct values, so that scores tie
    some = [(i, [rng.choice([0.0, 0.25, 0.5, -0.25, 0.013]) for _ in range(8)], rng.randrange(4)) for i in range(700)]
    odd = [(None, [0.5] * 8, 1), (50, None, 1), (100, [0.5] * 7 + [None], 1), (150, [float("nan")] * 8, 1), (200, [float("inf")] * 8, 2), (250, [0.5] * 8, None)]
    wide = [(1000 + 50 * i, [0.5, 0.25, 0.1 * i], i % 2) for i in range(6)] + [(2000, [], 1), (2050, [], 2), (2051, [], 1)]
    return some + odd + wide + some[:3] + some[50:52]


def mined(spark, rows, monkeypatch=None, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(4)
    return sorted(tuple(r) for r in op.mine(df, **more).collect())


def test_mined_as_by_all_pairs(spark, rows):
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_in_many_tiles(spark, rows, monkeypatch):
    monkeypatch.setattr(op, "ANCHORS", 4)
    monkeypatch.setattr(op, "COMPONENTS", 1500)
    monkeypatch.setattr(op, "AT_ONCE", 100)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, every=10, many_positives=2, many=7) == brute(rows, 10, 2, 7)


def test_large_components_are_exact(spark):
    rng = random.Random(9)
    for most in (2.0**12, 2.0**20, 2.0**22):
        rows = [(i * 25, [rng.uniform(-most, most) for _ in range(4)], i % 2) for i in range(40)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
        assert sorted(tuple(r) for r in op.mine(df).collect()) == brute(rows)
    # beyond a long: no crash, and its bounds as scores
    rows = [(i * 50, [(-1.0) ** i * 1e30, 1e30], i % 2) for i in range(6)]
    got = op.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(abs(r.positive_score) <= 2**63 for r in got)


def test_limits():
    assert op.limits(100) == (50, 95) and op.limits(0) == (0, 0) and op.limits(101) == (51, 95)
    low, high = op.limits(-100)
    assert low > high


def test_relabelled_and_empty(spark):
    df = spark.createDataFrame([(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None), (None, [1.0], 3)], "vec_id long, embedding array<float>, label int")
    assert sorted(((r.vec_id or 0), r.label) for r in op.relabelled(df).collect() if r.label is not None) == [(0, 3), (7, 0), (8, 9)]
    assert op.mine(df.limit(0)).count() == 0
    assert op.mine(df.filter("vec_id = 8")).count() == 0
