"""The closed-form classifier against plain Python sums."""

import hashlib
import math
import random

import pytest

from loomlab.operators import learning


def rows_of(n):
    rng = random.Random(5)
    return [(i, rng.gauss(i % 3, 0.7), rng.choice([None, rng.gauss(-(i % 3), 1.0)]), float(i % 3)) for i in range(n)]


def fold(key, folds):
    return int(int(hashlib.md5(f"0|fold|{key}".encode()).hexdigest()[:13], 16) / 16.0**13 * folds)


def plain_model(rows):
    model = []
    for label in sorted({r[3] for r in rows}):
        mine = [r for r in rows if r[3] == label]
        stats = []
        for i in (1, 2):
            x = [r[i] for r in mine if r[i] is not None]
            mean = sum(x) / len(x)
            stats.append((mean, max(sum(v * v for v in x) / len(x) - mean * mean, 1e-9)))
        model.append((label, math.log(len(mine)), stats))
    return model


def plain_guess(model, row):
    def cost(c):
        return -c[1] + sum(math.log(v) / 2 + (x - m) ** 2 / (2 * v) for x, (m, v) in zip(row[1:3], c[2]) if x is not None)

    return min((cost(c), c[0]) for c in model)[1]


def test_predictions(spark):
    rows = rows_of(300)
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    got = {r["k"]: r["prediction"] for r in learning.gaussian_infer(df, ["a", "b"], learning.gaussian_train(df, ["a", "b"], "y")).collect()}
    model = plain_model(rows)
    assert got == {r[0]: plain_guess(model, r) for r in rows}


@pytest.mark.parametrize("n", [300, 40])
def test_cross_validation(spark, n):
    rows = rows_of(n)
    df = spark.createDataFrame([*rows, (-1, 0.0, 0.0, None)], "k long, a double, b double, y double")
    got = {(r["epoch"], r["metric_name"]): r["value"] for r in learning.cv_train(df, "k", ["a", "b"], "y").collect()}
    want = []
    for i in range(5):
        held = [r for r in rows if fold(r[0], 5) == i]
        model = plain_model([r for r in rows if fold(r[0], 5) != i])
        if held:
            want.append(sum(plain_guess(model, r) == r[3] for r in held) / len(held))
    model = plain_model(rows)
    want.append(sum(plain_guess(model, r) == r[3] for r in rows) / len(rows))
    assert [got[i + 1, "accuracy"] for i in range(len(want))] == pytest.approx(want)
    assert [got[i + 1, "loss"] for i in range(len(want))] == pytest.approx([1 - w for w in want])


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "k long, a double, y double")
    some = spark.createDataFrame([(1, 2.0)], "k long, a double")
    assert learning.cv_train(none, "k", ["a"], "y").count() == 0
    model = learning.gaussian_train(none, ["a"], "y")
    assert [r["prediction"] for r in learning.gaussian_infer(some, ["a"], model).collect()] == [None]


def test_values_far_from_zero_lose_nothing(spark):
    rng = random.Random(8)
    rows = [(i, float(i % 2) * 0.5 + rng.gauss(0, 0.14), float(i % 2)) for i in range(400)]
    found = []
    for offset in (0.0, 1.7e9):
        df = spark.createDataFrame([(i, x + offset, y) for i, x, y in rows], "k long, a double, y double")
        cv = sorted(tuple(r) for r in learning.cv_train(df, "k", ["a"], "y").collect())
        model = learning.gaussian_train(df, ["a"], "y").first()["classes"]
        found.append((cv, {c["label"]: c["stats"][0]["variance"] for c in model}))
    assert found[0][0] == found[1][0] and all(v > 0.9 for _, n, v in found[1][0] if n == "accuracy")
    assert all(found[1][1][k] == pytest.approx(v, rel=1e-4) for k, v in found[0][1].items())
    # straight through the origin's shift: slope and loss of a line do not move either
    trainer = learning.LinearTrainer(["a"], "y")
    lines = []
    for offset in (0.0, 1.7e9):
        df = spark.createDataFrame([("g", x + offset, 3 * x + rng.gauss(0, 1e-3)) for _, x, _ in rows], "g string, a double, y double").repartition(7)
        lines.append({r["metric_name"]: r["value"] for r in learning.user_train(df, ["g"], ["a", "y"], trainer).collect()})
    assert lines[1]["a"] == pytest.approx(3, abs=1e-3) == lines[0]["a"] and lines[1]["rows"] == 400 and lines[1]["loss"] < 1e-5


def test_row_and_batch_functions(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "c")], "k long, t string")
    by_row = learning.row_transform(df, lambda r: {"k": r["k"], "n": len(r["t"])}, "k long, n long")
    by_batch = learning.batch_transform(df, lambda b: b[["k"]].assign(n=b["t"].str.len()), "k long, n long")
    assert sorted(map(tuple, by_row.collect())) == sorted(map(tuple, by_batch.collect())) == [(1, 2), (2, 1)]
