import hashlib
import random

import numpy as np
import pytest

from loomlab.llm import vector_codes as vc

ROWS = "vec_id long, embedding array<float>, label int, code string"


def slow(rows, parts=8, count=16, rounds=6, scale=4096):
    kept = [(i, [int(np.floor(scale * x)) for x in v], g) for i, v, g, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, r[0] or 0)
    if not kept:
        return []
    length = min((*order(r), len(r[1])) for r in kept)[2]
    kept = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (*order(r), r[1]))
    size = length // parts
    if not size or length % parts:
        return []
    out = {k: ["", 0] for k in range(len(kept))}
    final = []
    for p in range(parts):
        points = [r[1][p * size : (p + 1) * size] for r in kept]
        book = [list(x) for x in points[:count]]
        near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
        for _ in range(rounds):
            where = [near(x)[1] for x in points]
            for j in set(where):
                mine = [x for x, w in zip(points, where) if w == j]
                book[j] = [sum(c) // len(mine) for c in zip(*mine)]
        for k, x in enumerate(points):
            square, j = near(x)
            out[k][0] += f"{j:02x}"
            out[k][1] += square
        final += [c for e in book for c in e]
    sums = {}
    for k, r in enumerate(kept):
        sums[r[2]] = sums.get(r[2], 0) + out[k][1]
    sha = hashlib.sha256(",".join(map(str, final)).encode()).hexdigest()
    return sorted([(r[0], out[k][0], out[k][1], sums[r[2]], sha) for k, r in enumerate(kept)], key=str)


def got(found):
    return sorted([tuple(r) for r in found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=str)


def vectors(n, seed=1, length=16, step=None):
    rng = random.Random(seed)
    one = lambda: round(rng.gauss(0, 0.3) / step) * step if step else float(np.float32(rng.gauss(0, 0.2)))
    return [(i, [one() for _ in range(length)], rng.choice([None, 1, 1, 2, 3]), "x") for i in range(n)]


@pytest.mark.parametrize("step", [None, 0.25])  # the second: many ties and copies
def test_codes_equal_the_slow_version(spark, step):
    rows = vectors(300, step=step)
    rows += rows[5:40] + [(None, rows[3][1], None, "n"), (900, None, 1, "n"), (901, [None] + [0.0] * 15, 1, "n"), (902, [float("nan")] * 16, 1, "n"), (903, [float("inf")] * 16, 1, "n"), (904, [1.0], 1, "n"), (905, [], 1, "n")]
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    assert got(vc.compress(frame)) == slow(rows)


def test_few_rows_and_none(spark):
    rows = vectors(5)
    assert got(vc.compress(spark.createDataFrame(rows, ROWS))) == slow(rows)
    for odd in ([], [(1, None, 1, "n")], [(1, [1.0] * 7, 1, "n")], [(1, [], 1, "n")]):
        assert got(vc.compress(spark.createDataFrame(odd, ROWS))) == [] == slow(odd)


def test_far_values_are_held(spark):
    rows = [(i, [1e30 if i % 2 else -1e30] * 8 + [float(i)] * 8, 1, "x") for i in range(20)]
    found = got(vc.compress(spark.createDataFrame(rows, ROWS)))
    assert len(found) == 20 and all(r[2] >= 0 for r in found)


@pytest.mark.parametrize("count,high,length", [(1, 9, 8), (3, 2, 8), (16, 2, 8), (16, 900, 8), (200, 60, 2), (256, 2, 3), (64, 1 << 28, 8)])
def test_tree_equals_looking_at_all(count, high, length):
    rng = np.random.default_rng(count)
    entries = rng.integers(-high, high + 1, (count, length))
    queries = np.concatenate([rng.integers(-high, high + 1, (3000, length)), entries, (entries[:1] + entries[-1:]) // 2])
    tree = vc.build(entries)
    assert sorted(tree.entries()) == list(range(count))
    index, square, looked = vc.nearest(tree, entries, queries)
    every = ((queries[:, None].astype(object) - entries[None]) ** 2).sum(axis=2)
    assert square.tolist() == every.min(axis=1).tolist()
    assert index.tolist() == [int(np.flatnonzero(r == r.min())[0]) for r in every]
    assert looked <= len(queries) * count


def test_tree_leaves_out_far_subtrees():
    rng = np.random.default_rng(0)
    middle = rng.integers(-100_000, 100_000, (8, 8))
    entries = (middle[:, None] + rng.integers(-100, 100, (8, 8, 8))).reshape(64, 8)
    queries = (middle[:, None] + rng.integers(-100, 100, (8, 200, 8))).reshape(-1, 8)
    index, _, looked = vc.nearest(vc.build(entries), entries, queries)
    assert looked < len(queries) * 30 and (index // 8 == np.repeat(np.arange(8), 200)).all()
