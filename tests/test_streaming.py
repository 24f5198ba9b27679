"""Streams over several small files must end where the batch query ends."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomlab.session import scratch
from loomlab.streaming import metrics as st

SCHEMA = "id long, job_id long, metric_name string, value double, step int, epoch int, recorded_at timestamp_ntz"


@pytest.fixture(scope="module")
def points():
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        name = rng.choice(["loss", "lr", "learning_rate", "progress", "other"])
        rows.append((i, rng.choice([1, 1, 1, 2, 3]), name, rng.random() * 130, i, rng.choice([None, i // 10]), start + timedelta(seconds=i // 2)))
    return rows


@pytest.fixture
def arriving(spark, points, tmp_path):
    """The points in five files, the later ones first within each."""
    for i in range(5):
        part = spark.createDataFrame(points[i::5][::-1], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_job_state(spark, points, arriving):
    batch = st.job_state(spark.createDataFrame(points, SCHEMA))
    stream = st.upsert_snapshots(spark, st.job_state(arriving()), ["job_id"], scratch(spark, "t"))
    assert rows_of(stream) == rows_of(batch)


@pytest.mark.parametrize("value, progress", [(2.9, 2), (-2.9, -2), (1e12, 2147483647), (float("nan"), 0), (None, None)])
def test_progress_is_truncated_and_bounded(spark, value, progress):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, "progress", value, None, None, at)], SCHEMA)
    assert st.job_state(df).first()["progress"] == progress


def test_streams_without_data(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "empty"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "empty"))
    assert st.completion_stream(spark, stream(), scratch(spark, "e1")).count() == 0
    assert st.upsert_snapshots(spark, st.job_state(stream()), ["job_id"], scratch(spark, "e2")).count() == 0


def test_each_job_completes_once(spark, points, arriving):
    got = st.completion_stream(spark, arriving(), scratch(spark, "c"))
    want = st.completions(spark.createDataFrame(points, SCHEMA))
    assert sorted(r["job_id"] for r in got.collect()) == sorted(r["job_id"] for r in want.collect())


def test_retries_land_once(spark, points, arriving):
    doubled = arriving().withColumn("_again", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_again")
    landed = st.land_once(spark, doubled, scratch(spark, "r"), "id", "recorded_at")
    assert sorted(r["id"] for r in landed.collect()) == list(range(400))


def test_late_rows_land_too(spark, tmp_path):
    """Newest day first, one file per batch, each file sent twice: every point lands once."""
    source, out = str(tmp_path / "late"), scratch(spark, "late")
    for day in range(9, 0, -1):
        for _ in range(2):
            rows = spark.sql(f"SELECT {day} * 100 + id AS id, timestamp_ntz '2024-01-0{day} 00:00:00' AS at FROM range(5)")
            rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, at timestamp_ntz").option("maxFilesPerTrigger", "1").option("latestFirst", "false").parquet(source)
    landed = st.land_once(spark, stream, out, "id", "at")
    assert sorted(r["id"] for r in landed.collect()) == sorted(d * 100 + i for d in range(1, 10) for i in range(5))


def test_late_rows_stay_visible(spark, tmp_path):
    source = str(tmp_path / "w")
    for hours in ([0, 1, 30], [29, 2, None], [31]):
        rows = spark.createDataFrame([("a", h) for h in hours], "k string, h int")
        rows = rows.selectExpr("k", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h) AS at", "CAST(h AS DOUBLE) AS v")
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k string, at timestamp_ntz, v double").option("maxFilesPerTrigger", "1").parquet(source)
    means, late = st.windowed_means(spark, stream, scratch(spark, "w"), ["k"], "at", "v", "1 day", "5 hours")
    got = {str(r["window_start"])[:10]: (r["n"], r["mean"]) for r in means.collect() if r["window_start"]}
    assert got == {"2024-01-01": (2, 0.5), "2024-01-02": (3, 30.0)}
    assert [r["v"] for r in late.collect()] == [2.0]


def test_restart_goes_on_where_it_stopped(spark, points, tmp_path):
    source, out, state = str(tmp_path / "s"), scratch(spark, "o"), scratch(spark, "state")
    for i in range(2):
        spark.createDataFrame(points[i::2], SCHEMA).write.mode("append").parquet(source)
        landed = st.append_to(spark, spark.readStream.schema(SCHEMA).parquet(source), out, state=state)
        assert landed.count() == 200 * (i + 1)


def test_logs(spark):
    df = spark.createDataFrame([(1, None, "info", "a"), (1, 5, "error", "b")], "job_id long, logged_at long, level string, message string")
    assert [r["logged_at"] for r in st.log_lines(df, default_at=F.lit(9)).collect()] == [9, 5]
    assert [r["message"] for r in st.log_lines(df, "error").collect()] == ["b"]


def test_refreshed_summary_covers_all_batches(spark, points, arriving):
    out = st.refresh(
        spark, arriving().select("id", "value"), scratch(spark, "sn"),
        partial=lambda t: t.agg(F.count("id").alias("n"), F.max("value").alias("m")),
        merge=lambda t: t.agg(F.sum("n").alias("n"), F.max("m").alias("m")),
        finish=lambda t: t, length=2,
    )
    assert out.first()["n"] == 400 and out.first()["m"] == max(p[3] for p in points)


def test_old_batches_are_folded(spark, points, tmp_path):
    """Whatever the number of batches, a look at the earlier rows reads one generation of them."""
    for i in range(14):
        spark.createDataFrame(points[i::14], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole = spark.createDataFrame(points, SCHEMA)
    done = st.completion_stream(spark, arriving(), scratch(spark, "g"), length=4)
    assert sorted(r["job_id"] for r in done.collect()) == sorted(r["job_id"] for r in st.completions(whole).collect())
    state = st.upsert_snapshots(spark, st.job_state(arriving()), ["job_id"], scratch(spark, "g"), length=4)
    assert rows_of(state) == rows_of(st.job_state(whole))
    for landed in (done, state):
        folders = {f.rsplit("/", 1)[0] for f in landed.inputFiles()}
        assert len({f.split("generation=")[1].split("/")[0] for f in folders}) == 1 and len(folders) <= 5


def test_notices_go_to_owners(spark):
    at = datetime(2024, 1, 1)
    events = spark.createDataFrame([(1, at, "completed"), (2, at, "completed")], "job_id long, completed_at timestamp_ntz, status string")
    jobs = spark.createDataFrame([(1, 7), (3, 8)], "id long, owner_id long")
    assert [tuple(r) for r in st.completion_notices(events, jobs).collect()] == [(7, 1, "Job 1 completed", at)]


def test_one_late_row_reads_its_day_only(spark, tmp_path, monkeypatch):
    """Many batches stand in a bounded number of folders, and a row dated a year back reads one day."""
    out = scratch(spark, "seg")
    kinds = "id long, at timestamp_ntz"
    landed = st.Segments(spark, out, spark.createDataFrame([], kinds + ", _day string").schema, length=3)
    for batch in range(29):
        if batch in (3, 18, 27):
            landed.before(batch)  # a batch that runs again
        landed.before(batch)
        day = datetime(2024, 1, 1) + timedelta(days=batch // 5)
        landed.add(batch, spark.createDataFrame([(batch, day)], kinds).coalesce(1).withColumn("_day", st.day_of("at")))
        if batch % 9 in (0, 8):
            assert sorted(r["id"] for r in landed.rows().collect()) == list(range(batch + 1))
    assert [len(landed.folders(n)) - 1 for n in (0, 2, 3, 27, 200)] == [0, 2, 1, 1, 6]  # the sum of the digits of n to the base 3
    one = landed.before(29).where(F.col("_day").isin(["2024-01-03"]))
    assert sorted(r["id"] for r in one.collect()) == list(range(10, 15))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "_day" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_windows_fold_their_sums(spark, points, tmp_path):
    for i in range(13):
        spark.createDataFrame(points[i::13], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    means, late = st.windowed_means(spark, stream, scratch(spark, "w"), ["metric_name"], "recorded_at", "value", "1 minute", "1 day", length=4)
    want = spark.createDataFrame(points, SCHEMA).groupBy("metric_name", F.window("recorded_at", "1 minute")["start"].alias("w")).agg(F.avg("value").alias("m"))
    got = {(r["metric_name"], r["window_start"]): r["mean"] for r in means.collect()}
    assert got == pytest.approx({(r["metric_name"], r["w"]): r["m"] for r in want.collect()}) and late.count() == 0
    assert len({f.rsplit("/", 1)[0] for f in means.inputFiles()}) <= 5
