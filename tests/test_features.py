import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlab.functions import transforms as tf
from loomlab.operators import profile
from loomlab.operators.profile import Stats

NAN = float("nan")


def test_profile_reads_nan_as_missing(spark):
    df = spark.createDataFrame([(4.0,), (8.0,), (12.0,), (NAN,), (NAN,)], "val double")
    r = profile.feature_profile(df).first()
    assert (r["mean"], r["std"], r["min"], r["max"], r["null_rate"]) == (8.0, 4.0, 4.0, 12.0, 0.4)


def test_profile_of_missing_and_text_columns(spark):
    df = spark.createDataFrame([(None, "a"), (None, "b")], "x double, s string")
    x, s = profile.feature_profile(df, ["x", "s"]).collect()
    assert x["mean"] is None and x["std"] is None and x["null_rate"] == 1.0
    assert s["kind"] == "categorical" and s["mean"] is None and s["n"] == 2


def test_default_columns_are_the_numeric_ones(spark):
    df = spark.createDataFrame([(1, 0.5, "u"), (2, 1.5, "v")], "depth long, width double, label string")
    assert profile.numeric_columns(df) == ["depth", "width"]
    assert [r["feature"] for r in profile.feature_profile(df, ["width", "depth"]).collect()] == ["width", "depth"]


@pytest.mark.parametrize(
    "kind, stats, given, want",
    [
        ("standard_scaler", Stats(50.0, 4.0, None, None), [42.0, 50.0, 53.0], [-2.0, 0.0, 0.75]),
        ("standard_scaler", Stats(50.0, 0.0, None, None), [42.0, 53.0], [42.0, 53.0]),
        ("standard_scaler", Stats(50.0, None, None, None), [42.0, 53.0], [42.0, 53.0]),
        ("min_max_scaler", Stats(None, None, -2.0, 6.0), [-2.0, 0.0, 6.0], [0.0, 0.25, 1.0]),
        ("min_max_scaler", Stats(None, None, 5.0, 5.0), [5.0], [5.0]),
        ("log_transform", Stats(None, None, None, None), [0.0, 3.0, 7.5], [0.0, math.log(4), math.log(8.5)]),
    ],
)
def test_transforms(spark, kind, stats, given, want):
    df = spark.createDataFrame([(v,) for v in given], "x double")
    out = [r["x"] for r in tf.apply_features(df, [tf.Feature("x", kind, stats), tf.Feature("absent", kind, stats)]).collect()]
    assert out == pytest.approx(want)


def test_log_outside_domain_is_null(spark):
    df = spark.createDataFrame([(-1.0,), (-2.0,)], "x double")
    assert [r[0] for r in df.select(tf.log_scale(F.col("x"))).collect()] == [None, None]


def test_one_hot(spark):
    df = spark.createDataFrame([("oval", 1), ("cube", 2), ("oval", 3), (None, 4)], "shape string, value long")
    out = tf.apply_features(df, [tf.Feature("shape", "one_hot", categories=tuple(tf.categories(df, "shape")))])
    assert out.columns == ["value", "shape_cube", "shape_oval"]
    assert [tuple(r) for r in out.orderBy("value").collect()] == [(1, False, True), (2, True, False), (3, False, True), (4, False, False)]


def test_one_hot_of_many_values_is_sparse(spark):
    df = spark.range(3000).select(F.when(F.col("id") > 0, F.col("id")).alias("code"))
    out = tf.apply_features(df, [tf.Feature("code", "one_hot")])
    assert out.columns == ["code_one_hot"] and out.where("code_one_hot[17]").count() == 1
    assert out.where("size(code_one_hot) = 0").count() == 1


def test_registering_a_feature_twice_applies_it_once(spark):
    df = spark.createDataFrame([(20.0,)], "x double")
    twice = [tf.Feature("x", "standard_scaler", Stats(30.0, 5.0, None, None))] * 2
    assert tf.apply_features(df, twice).first()["x"] == -2.0


def test_dropna_drops_null_and_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, "b"), (None, "c"), (2.0, None)], "x double, s string")
    assert {r["x"] for r in profile.drop_missing(df, ["x"]).collect()} == {1.0, 2.0}


@pytest.mark.parametrize("accuracy", [4096, 8])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=700), np.full(400, 0.25), rng.integers(0, 5, 300), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v), None) for v in values] + [(NAN, None), (None, None)], "x double, e double").repartition(7)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
    got = profile.exact_quantiles(df, ["x", "e"], probs, accuracy)
    assert got["x"] == pytest.approx([float(np.quantile(values, p)) for p in probs])
    assert got["e"] == [None] * len(probs)


def test_describe_reads_three_times(spark):
    seen, n = spark.sparkContext.accumulator(0), 30_000

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(n).selectExpr("id * 1.5 AS x", "sqrt(id) AS y", "CAST(id % 3 AS DOUBLE) AS z").mapInPandas(count, "x double, y double, z double")
    rows = {r["feature"]: r for r in profile.describe(df, ["x", "y", "z"]).collect()}
    assert seen.value == 3 * n
    assert [rows["x"][q] for q in ("q1", "median", "q3")] == [float(v) for v in np.quantile(np.arange(n) * 1.5, [0.25, 0.5, 0.75])]
    assert [rows["y"][q] for q in ("q1", "median", "q3")] == pytest.approx(list(np.quantile(np.sqrt(np.arange(n)), [0.25, 0.5, 0.75])), rel=1e-14)
    assert rows["z"]["median"] == 1.0 and rows["z"]["n"] == n


@pytest.mark.parametrize("bins", [4, 64])
def test_growing_histogram_merges_exactly(spark, bins):
    """50 batches of distinct doubles whose range grows: few rows of state, counts per final bin exact."""
    rng = np.random.default_rng(4)
    state, values = None, []
    for i in range(50):
        batch = rng.normal(size=40) * 3.0**(i / 5) - i
        values.append(batch)
        if i % 10 == 0:  # every batch makes a part; ten are merged at a time, as a stream folds them
            parts = []
        parts.append(profile.doubling_counts(spark.createDataFrame([(float(v),) for v in batch] + [(NAN,), (None,), (float("inf"),)], "v double"), "v", bins))
        if i % 10 == 9:
            for p in parts:
                state = p if state is None else state.unionByName(p)
            state = spark.createDataFrame(profile.merged_counts(state, bins).collect(), "exponent int, bin long, n long, low double, high double")
            assert state.count() <= bins
    every, rows = np.concatenate(values), state.collect()
    width = 2.0 ** rows[0]["exponent"]
    counts = {}
    for v in np.floor(every / width).astype(int).tolist():
        counts[v] = counts.get(v, 0) + 1
    assert {r["bin"]: r["n"] for r in rows} == counts and len({r["exponent"] for r in rows}) == 1
    spans = np.floor(every.max() / (width / 2)) - np.floor(every.min() / (width / 2))
    assert spans >= bins  # no finer grid would do
    assert profile.doubling_counts(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(3.0,), (1.0,)], "x double")
    assert profile.exact_quantiles(df, ["x"])["x"] == [1.5, 2.0, 2.5]


def test_describe_sketch_variant(spark):
    df = spark.range(1001).withColumnRenamed("id", "x")
    r = profile.describe(df, ["x"], exact=False).first()
    assert (r["q1"], r["median"], r["q3"]) == (250.0, 500.0, 750.0)


def test_small_values_keep_their_digits(spark):
    df = spark.createDataFrame([(1e-7,), (3e-7,)], "x double")
    r, d = profile.feature_profile(df).first(), profile.describe(df, ["x"]).first()
    assert r["mean"] == pytest.approx(2e-7) and r["max"] == 3e-7 and d["median"] == pytest.approx(2e-7) and d["std"] > 1e-7


def test_nan_counts_as_missing(spark):
    rows = [(float(i), float(2 * i)) for i in range(16)]
    clean, holed = (spark.createDataFrame(rows + more, "x double, y double") for more in ([], [(NAN, 1.0), (2.0, NAN), (None, NAN)]))
    edges = [[r["edge"] for r in profile.histogram(df, "y").orderBy("bin").collect()] for df in (clean, holed)]
    assert edges[0] == edges[1]
    assert all(r["corr"] == pytest.approx(1.0) for r in profile.correlations(holed, ["x", "y"]).collect())
    grids = [sorted(map(tuple, profile.density_grid(df, "x", "y", 4, 4).collect())) for df in (clean, holed)]
    assert grids[0] == grids[1]


def test_histogram_edges(spark):
    constant = spark.createDataFrame([(7.0,)] * 3, "x double")
    rows = sorted(map(tuple, profile.histogram(constant, "x").collect()))
    assert rows[0] == (0, 7.0, 3) and len(rows) == 15 and sum(r[2] for r in rows) == 3
    spread = spark.createDataFrame([(float(i),) for i in range(16)], "x double")
    counts = [r["n"] for r in profile.histogram(spread, "x").orderBy("bin").collect()]
    assert counts == [1] * 14 + [2]


def test_density_of_constant_axis(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "x double, y double")
    rows = sorted(tuple(r) for r in profile.density_grid(df, "x", "y", 4, 2).collect())
    assert rows == [(0, 0, 1, 1.0), (0, 1, 1, 1.0)]
