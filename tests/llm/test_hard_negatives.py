import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlab.llm import hard_negatives as hn

ROWS = "vec_id long, embedding array<float>, label int, score string"


def slow(rows, divisor=5):
    order = lambda i: (i is None, i or 0)
    kept = [(i, [int(np.floor(256 * x)) for x in v], g) for i, v, g, *_ in rows if g is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    length = min((*order(i), len(v)) for i, v, _ in kept)[2]
    kept = [r for r in kept if len(r[1]) == length]
    out = []
    for a, (i, v, g) in enumerate(kept):
        if i is None or i % divisor:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), *order(j), h, j) for b, (j, w, h) in enumerate(kept) if b != a)
        for s, _, _, _, p in [r for r in scored if r[3] == g][:5]:
            fits = [r for r in scored if r[3] != g and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out += [(i, p, n, r[4], -s, -r[0]) for n, r in enumerate(fits[:3], 1)]
    return sorted(out, key=str)


def got(rows, spark, divisor=5, **more):
    frame = spark.createDataFrame(rows, ROWS).repartition(6)
    found = hn.mine(frame, F.col("vec_id") % divisor == 0, **more)
    return sorted([tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in found.collect()], key=str)


def vectors(n, length=8, seed=1, step=None, labels=4):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(6)]
    rows = []
    for i in range(n):
        v = [x + rng.gauss(0, 0.4) for x in rng.choice(middle)]
        rows.append((i, [round(x / step) * step if step else float(np.float32(x)) for x in v], rng.randrange(labels), "x"))
    return rows


@pytest.mark.parametrize("step,block_rows", [(None, 8192), (None, 40), (0.5, 40), (1.0, 8)])
def test_equals_the_slow_version(spark, monkeypatch, step, block_rows):
    monkeypatch.setattr(hn, "LEAF", 4)
    monkeypatch.setattr(hn, "MET", 30)
    rows = vectors(260, step=step, length=4)
    rows += rows[10:60:5] + [(None, rows[3][1], 1, "n"), (910, None, 1, "n"), (915, rows[0][1], None, "n"), (920, [None] * 4, 1, "n"), (925, [float("nan")] * 4, 1, "n"), (930, [1.0], 1, "n"), (935, [0.0] * 4, 1, "n")]
    assert got(rows, spark, block_rows=block_rows) == slow(rows)


def test_one_label_one_row_none(spark):
    rows = vectors(30, labels=1)
    assert got(rows, spark) == [] == slow(rows)
    for odd in ([], rows[:1], [(5, [], 1, "n"), (6, [], 2, "n")], [(5, None, 1, "n")]):
        assert got(odd, spark) == [] == slow(odd)


def test_negative_scores_have_no_window(spark):
    rows = [(0, [1.0, 0.0], 1, ""), (1, [-1.0, 0.0], 1, ""), (2, [-0.7, 0.0], 2, ""), (3, [0.0, 1.0], 1, ""), (4, [0.0, -1.0], 2, "")]
    assert got(rows, spark) == slow(rows) == [(0, 3, 1, 4, 0, 0)]


def test_far_values_are_held(spark):
    rows = [(i, [1e30 * (-1) ** i, 1.0, float(i)], i % 2, "") for i in range(12)]
    assert isinstance(got(rows, spark), list)


def test_boxes_bound_and_packing_covers():
    rng = np.random.default_rng(1)
    points, queries = rng.integers(-300, 300, (700, 5)), rng.integers(-300, 300, (40, 5))
    order, starts = hn.packed(points, 16)
    assert sorted(order.tolist()) == list(range(700)) and starts[0] == 0
    scores = hn.exact(queries, points[order])
    for a, b in zip(starts, [*starts[1:], 700]):
        assert 0 < b - a <= 16
        some = points[order[a:b]]
        least, most = hn.interval(queries, some.min(axis=0)[None], some.max(axis=0)[None])
        assert (least[:, 0] <= scores[:, a:b].min(axis=1)).all() and (most[:, 0] >= scores[:, a:b].max(axis=1)).all()


def test_exact_beyond_doubles():
    x = np.array([[hn.MOST, hn.MOST - 1, 3]]), np.array([[hn.MOST, -hn.MOST, 7], [1, 2, 3]])
    assert hn.exact(*x).tolist() == [[sum(int(a) * int(b) for a, b in zip(x[0][0], r)) for r in x[1]]]


def test_search_opens_few_leaves_of_clusters(monkeypatch):
    rng = np.random.default_rng(2)
    middle = rng.integers(-1000, 1000, (40, 6))
    points = (middle[:, None] + rng.integers(-20, 20, (40, 64, 6))).reshape(-1, 6)
    tree = hn.Tree(points, np.arange(len(points)), np.zeros(len(points), np.int64), np.arange(len(points)))
    scored = []
    monkeypatch.setattr(hn, "exact", lambda x, y, f=hn.exact: scored.append(len(y)) or f(x, y))
    one = points[:1]
    tree.search(one, np.zeros(1), np.array([0]), np.array([0]), np.array([hn.LOWEST + 1]), np.array([hn.NO_ID]), np.array([hn.LOWEST]), 5, True)
    looked = sum(n for n in scored if n > hn.FANOUT)
    assert looked < len(points) / 3
