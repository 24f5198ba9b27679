"""Chunked windows must equal plain windows whatever the chunk width, grouping or skew."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlab.operators.grouped import latest, page_per_group, top_per_group
from loomlab.operators.ordered import ROWS, _chunked, global_index, position, running


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for k in rng.sample(range(-300, 5000), 900):
        group = None if k % 11 == 0 else ("hot" if k % 3 else f"g{k % 7}")
        data.append((group, k, rng.choice([None, rng.randint(-50, 50)])))
    return spark.createDataFrame(data, "g string, k long, v int").repartition(5)


@pytest.mark.parametrize("width", [1, 7, 64, 10_000])
def test_running_equals_plain_window(rows, width):
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.select(
        "*",
        F.count("v").over(w).alias("c"),
        F.sum("v").over(w).alias("s"),
        F.min("v").over(w).alias("lo"),
        F.max("v").over(w).alias("hi"),
        F.lag("v").over(Window.partitionBy("g").orderBy("k")).alias("prev"),
        F.count("v").over(Window.partitionBy("g")).alias("all"),
    )
    v = F.col("v")
    ours = running(
        rows, ["g"], "k", {"c": ("count", v), "s": ("sum", v), "lo": ("min", v), "hi": ("max", v), "prev": ("previous", v), "all": ("total", v)}, width
    )
    assert sorted(map(str, ours.collect())) == sorted(map(str, plain.collect()))


def test_rows_are_shuffled_once(spark, rows):
    """The windows and the join use one partitioning; the other exchanges carry chunk summaries."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = running(rows.select("g", "k", F.col("v").alias("payload")), ["g"], "k", {"n": ("count", F.lit(1))})
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning(_group" in line]
    assert len(shuffled) == 4 and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("width", [1, 13, 100_000])
def test_positions(rows, width):
    ours = {r["k"]: (r["position"], r["index"]) for r in global_index(position(rows, ["g"], "k", width=width), "k", width=width).collect()}
    by_group = {}
    for i, r in enumerate(sorted(rows.collect(), key=lambda r: r["k"])):
        p = by_group.get(r["g"], 0)
        by_group[r["g"]] = p + 1
        assert ours[r["k"]] == (p, i)


def test_hashed_ids_are_chunked_by_rows(spark):
    """Keys spread over all whole numbers, in one group: few chunks, none much above the wanted rows, right answers."""
    n = 200_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"))
    chunks = _chunked(df, [], "k", None).groupBy("_chunk").count().collect()
    assert 2 <= len(chunks) <= 6 and max(r["count"] for r in chunks) < 2.2 * ROWS  # the two chunks around zero are one
    ours = position(df, [], "k").agg(F.sum("position").alias("s"), F.max("position").alias("m"), F.countDistinct("position").alias("d")).first()
    assert (ours["s"], ours["m"], ours["d"]) == (n * (n - 1) // 2, n - 1, n)


def test_keys_that_bunch_up_make_even_chunks(spark):
    """All keys but a few lie in one ten-thousandth of their range: no chunk is above twice the mean."""
    n, rows = 300_000, 2_000
    spread = spark.range(1000).select((F.col("id") * 10**12).alias("k"))
    df = spark.range(n).select((F.col("id") + 7 * 10**13 + 1).alias("k")).unionByName(spread)
    for wanted in (rows, 20_000):
        counts = [r["count"] for r in _chunked(df, [], "k", None, rows=wanted).groupBy("_chunk").count().collect()]
        assert max(counts) < 2 * wanted and len(counts) < 2.5 * n / wanted
    ours = running(df, [], "k", {"at": ("count", F.lit(1)), "before": ("previous", F.col("k"))}, rows=rows)
    wrong = Window.orderBy("k")
    off = ours.withColumns({"i": F.row_number().over(wrong), "b": F.lag("k").over(wrong)}).where((F.col("i") != F.col("at")) | ~F.col("b").eqNullSafe(F.col("before")))
    assert off.count() == 0


def test_wide_values_take_no_part_in_aggregates(spark):
    df = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("pixels"))
    plan = running(df, [], "id", {"before": ("previous", F.col("pixels"))})._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "max_by" not in plan


def test_measured_width_without_rows(spark):
    assert position(spark.createDataFrame([], "g string, k long"), ["g"], "k").count() == 0
    assert [r["position"] for r in position(spark.createDataFrame([("a", 5)], "g string, k int"), ["g"], "k").collect()] == [0]


def test_struct_extremes_skip_nulls(rows):
    scored = F.when(F.col("v").isNotNull(), F.struct("v", "k"))
    out = running(rows, ["g"], "k", {"best": ("min", scored)}, 16).collect()
    seen = {}
    for r in sorted(out, key=lambda r: r["k"]):
        if r["v"] is not None:
            best = seen.get(r["g"])
            seen[r["g"]] = min(best, (r["v"], r["k"])) if best else (r["v"], r["k"])
        assert (tuple(r["best"]) if r["best"] else None) == seen.get(r["g"])


@pytest.mark.parametrize("k", [3, 1500])
def test_top_per_group(rows, k):
    got = {(r["g"], r["k"]): r["rank"] for r in top_per_group(rows, ["g"], [F.col("k").desc()], k).collect()}
    want, count = {}, {}
    for r in sorted(rows.collect(), key=lambda r: -r["k"]):
        n = count[r["g"]] = count.get(r["g"], 0) + 1
        if n <= k:
            want[r["g"], r["k"]] = n
    assert got == want


@pytest.mark.parametrize("k", [3, 4000])
def test_limit_is_applied_before_the_shuffle(rows, k):
    plan = top_per_group(rows, ["g"], [F.col("k").desc()], k)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_page_and_latest(rows):
    page = page_per_group(rows, ["g"], [F.col("k")], limit=9000, offset=2, cap=5)
    assert page.groupBy("g").count().agg(F.max("count")).first()[0] == 5
    newest = {r["g"]: r["k"] for r in latest(rows, ["g"], ["k"]).collect()}
    want = {}
    for r in rows.collect():
        want[r["g"]] = max(want.get(r["g"], -10**9), r["k"])
    assert newest == want


def test_latest_by_time_hashes_and_keeps_rows_without_time(spark):
    rows = [(1, 5, None), (1, 6, "2024-01-01"), (1, 7, "2024-01-01"), (2, 9, None), (2, 8, None)]
    df = spark.createDataFrame(rows, "g int, id long, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert "SortAggregate" not in latest(df, ["g"], ["at", "id"])._jdf.queryExecution().executedPlan().toString()
    for frame in (df, df.withColumn("t", F.lit("text"))):
        assert sorted((r["g"], r["id"]) for r in latest(frame, ["g"], ["at", "id"]).collect()) == [(1, 7), (2, 9)]
