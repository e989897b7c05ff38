"""Hard-negative mining against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from symdiff.llm import negatives

LONG = (1 << 63) - 1
SCHEMA = "vec_id long, embedding array<double>, label int, row string, g int"


def brute_force(rows, positives=5, count=10, low=30, high=90, every=100):
    valid = [(i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    most = int(negatives.MOST)
    valid = [(i, [min(max(x, -most), most) for x in v], y) for i, v, y in valid]
    out = []
    for i, v, y in valid:
        if i % every:
            continue
        scored = sorted((-min(max(sum(p * q for p, q in zip(v, w, strict=True)), -LONG - 1), LONG), j, z) for j, w, z in valid if j != i and len(w) == len(v))
        for ps, j in [(-s, j) for s, j, z in scored if z == y][:positives]:
            hard = [(-s, k) for s, k, z in scored if z != y and low * ps <= -100 * s <= high * ps][:count]
            out += [(i, j, rank, k, ps, s) for rank, (s, k) in enumerate(hard, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = negatives.mine_hard_negatives(df, F.col("vec_id") % 100 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def made(n, seed, values=(0.0, 0.25, 0.5, -0.3, 1.0)):
    """Few values, so many ties."""
    rng = random.Random(seed)
    return [(i, [rng.choice(values) for _ in range(4)], rng.choices(range(5), [9, 4, 1, 1, 1])[0]) for i in range(n)]


@pytest.mark.parametrize(("anchors", "rows"), [(1 << 13, 1 << 13), (2, 50)])
def test_matches_brute_force_in_one_and_many_cells(spark, monkeypatch, anchors, rows):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "ROWS", rows)
    monkeypatch.setattr(negatives, "SCORES", 100)
    table = made(420, 1)
    want = brute_force(table)
    assert run(spark, table) == want and len(want) > 100


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(None, [1.0] * 4, 0), (100, None, 0), (200, [1.0] * 4, None), (7, [nan, 1, 1, 1.0], 0), (8, [inf, 1, 1, 1.0], 1), (9, [None, 1.0, 1.0, 1.0], 1), (10, [], 0), (300, [], 0), (301, [], 1), (400, [1.0], 0), (500, [1e308, 1e308], 3), (501, [1e308, -1e308], 3), (502, [1.0, 0.5], 4), (503, [1e308, 0.0], 4), (504, [0.9e16, 1.0], 3)]
    table = [(i, [x if x is None else float(x) for x in v] if v else v, y) for i, v, y in odd] + made(90, 2) + [(0, [1.0, 1.0, 0.5, 0.25], 1), (3, [1.0, 1.0, 0.5, 0.25], 1), (3, [1.0, 1.0, 0.5, 0.25], 1)]
    assert run(spark, table) == brute_force(table)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1)]) == []


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(3)
    table = [(i, [rng.choice([2.0**24, 2.0**23, -(2.0**24)]) + rng.randrange(9) for _ in range(3)], i % 3) for i in range(120)]
    want = brute_force(table, low=-200, high=300)
    assert run(spark, table, low_percent=-200, high_percent=300) == want and any(r[4] > 2**53 and r[4] % 2 for r in want)
