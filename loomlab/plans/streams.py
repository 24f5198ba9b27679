"""Stream queries: each runs its stream over the whole table and returns what it landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlab.operators import profile
from loomlab.plans.io import parsed_objects
from loomlab.plans.registry import JOBS, METRICS, query
from loomlab.session import scratch
from loomlab.streaming import metrics as st
from loomlab.tables import Lab, as_metrics, status_of

NAMES = {"error": "loss", "click": "learning_rate", "view": "lr", "purchase": "progress"}


def named(points):
    """Event types read as the metric names the job state follows."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return points.withColumn("metric_name", F.coalesce(names[F.col("metric_name")], "metric_name"))


def metric_stream(lab: Lab):
    return as_metrics(lab.stream("events"))


STATE = f"""WITH {METRICS}, o AS (SELECT *, {{'t': recorded_at, 'i': id}} AS k FROM metrics)
SELECT job_id, arg_max(value, k) FILTER (metric_name = 'error') AS loss, arg_max(value, k) FILTER (metric_name IN ('click', 'view')) AS learning_rate,
  CAST(trunc(arg_max(value, k) FILTER (metric_name = 'purchase')) AS INTEGER) AS progress, arg_max(epoch, k) AS epoch_current FROM o GROUP BY 1"""


@query("job_state", STATE)
def job_state(lab: Lab):
    return st.job_state(named(lab.metrics()))


@query("job_state_stream", STATE)
def job_state_stream(lab: Lab):
    state = st.job_state(named(metric_stream(lab)))
    return st.upsert_snapshots(lab.spark, state, ["job_id"], scratch(lab.spark, "job-state"))


DONE = "SELECT user_id AS job_id, min(ts) AS completed_at FROM events WHERE value >= 300 GROUP BY 1"


def progress(points):
    return points.withColumn("metric_name", F.lit("progress"))


@query("completions", DONE)
def completions(lab: Lab):
    return st.completions(progress(lab.metrics()), 300.0)


@query("completion_events", DONE.replace("completed_at FROM", "completed_at, 'completed' AS status FROM"))
def completion_events(lab: Lab):
    """Jobs that reach the threshold, once each, with the status they take."""
    return st.completion_stream(lab.spark, progress(metric_stream(lab)), scratch(lab.spark, "completions"), 300.0)


@query(
    "completion_notices",
    """SELECT o_custkey AS user_id, o_orderkey AS job_id, 'Job ' || o_orderkey || ' completed' AS title, min(ts) AS created_at
    FROM events JOIN orders ON o_orderkey = user_id WHERE value >= 300 GROUP BY 1, 2""",
)
def completion_notices(lab: Lab):
    """One notice to the owner of each job that the stream sees complete; the customer of an order owns its job."""
    events = st.completion_stream(lab.spark, progress(metric_stream(lab)), scratch(lab.spark, "completions"), 300.0)
    jobs = lab.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner_id"))
    return st.completion_notices(events, jobs)


@query(
    "live_subscription",
    f"WITH {METRICS} SELECT * FROM metrics WHERE job_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 2000)",
)
def live_subscription(lab: Lab):
    watched = lab.models().where(F.col("score") > 2000).select(F.col("id").alias("job_id"))
    points = metric_stream(lab)
    return st.append_to(lab.spark, st.subscribe(points, watched).select(*points.columns), scratch(lab.spark, "subscription"))


@query("micro_batch_flush", f"WITH {METRICS} SELECT * FROM metrics")
def micro_batch_flush(lab: Lab):
    """Every point is sent twice, as after a failed flush; the landed table has it once."""
    sent = metric_stream(lab).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(2)))).drop("attempt")
    return st.land_once(lab.spark, sent, scratch(lab.spark, "flushed"), "id", "recorded_at", interval=st.FLUSH_INTERVAL)


@query(
    "windowed_metrics",
    f"""WITH {METRICS} SELECT metric_name, time_bucket(INTERVAL '1 day', recorded_at) AS window_start, count(value) AS n,
    round(sum(value) / count(value), 6) AS mean FROM metrics GROUP BY 1, 2""",
)
def windowed_metrics(lab: Lab):
    """Daily means per metric from the stream; late rows would stand in a table beside."""
    points = metric_stream(lab)
    means, _ = st.windowed_means(lab.spark, points, scratch(lab.spark, "windows"), ["metric_name"], "recorded_at", "value", "1 day", "1 hour")
    return means.withColumn("mean", F.round("mean", 6))


@query(
    "windowed_metrics_late",
    f"""WITH {METRICS}, mark AS (SELECT max(recorded_at) AS newest FROM metrics WHERE id % 10 <> 0)
    SELECT id, metric_name, recorded_at FROM metrics, mark WHERE id % 10 = 0 AND recorded_at < newest - INTERVAL '10 days'""",
)
def windowed_metrics_late(lab: Lab):
    """Every tenth point arrives after the others; those more than ten days behind the newest are late."""
    source, out, state = (scratch(lab.spark, name) for name in ("arriving", "windows", "window-state"))
    points, late = lab.metrics(), None
    for arrived in (F.col("id") % 10 != 0, F.col("id") % 10 == 0):
        points.where(arrived).write.mode("append").parquet(source)
        stream = lab.spark.readStream.schema(points.schema).parquet(source)
        _, late = st.windowed_means(lab.spark, stream, out, ["metric_name"], "recorded_at", "value", "1 day", "10 days", state=state)
    return late.select("id", "metric_name", "recorded_at")


@query("metric_append", f"WITH {METRICS} SELECT * FROM metrics")
def metric_append(lab: Lab):
    return st.append_to(lab.spark, metric_stream(lab), scratch(lab.spark, "metrics"))


def log_stream_of(lab: Lab):
    return lab.stream("conversations").select(
        F.col("conv_id").alias("job_id"),
        F.when(F.col("turn") % 3 > 0, F.col("turn")).alias("logged_at"),
        F.col("role").alias("level"),
        F.col("text").alias("message"),
    )


LOGS = "SELECT conv_id AS job_id, CASE WHEN turn % 3 > 0 THEN turn ELSE -1 END AS logged_at, role AS level, text AS message FROM conversations"


@query("log_append", LOGS)
def log_append(lab: Lab):
    """Lines without a time take the time of arrival, here a fixed one."""
    lines = st.log_lines(log_stream_of(lab), default_at=F.lit(-1).cast("long"))
    return st.append_to(lab.spark, lines, scratch(lab.spark, "logs"))


@query("log_stream", LOGS + " WHERE role = 'user'")
def log_stream(lab: Lab):
    lines = st.log_lines(log_stream_of(lab), "user", F.lit(-1).cast("long"))
    return st.append_to(lab.spark, lines, scratch(lab.spark, "user-logs"))


@query(
    "live_status_counts",
    f"""WITH {JOBS} SELECT 'status' AS board, status AS key, count(*) AS n FROM jobs GROUP BY 2
    UNION ALL SELECT 'unread', CAST(user_id AS VARCHAR), count(*) FILTER (NOT value < 50) FROM events GROUP BY 2""",
)
def live_status_counts(lab: Lab):
    """Jobs per status and unread notifications per user, kept by two streams."""
    jobs = lab.stream("orders").select(status_of(F.col("o_orderstatus")).alias("key"))
    unread = lab.stream("events").select(F.col("user_id").cast("string").alias("key"), (F.col("value") < 50).alias("read"))
    by_status = jobs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    by_user = unread.groupBy("key").agg(F.count_if(~F.col("read")).alias("n"))
    boards = []
    for board, counts in (("status", by_status), ("unread", by_user)):
        landed = st.upsert_snapshots(lab.spark, counts, ["key"], scratch(lab.spark, f"counts-{board}"))
        boards.append(landed.select(F.lit(board).alias("board"), "key", "n"))
    return boards[0].unionByName(boards[1])


@query(
    "refresh_snapshot",
    """WITH span AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    grid AS (SELECT pow(2, list_filter(range(-20, 64), lambda e: floor(hi / pow(2, e)) - floor(lo / pow(2, e)) < 64)[1]) AS width FROM span)
    SELECT floor(value / width) * width AS edge, width, count(*) AS n FROM events, grid GROUP BY 1, 2""",
)
def refresh_snapshot(lab: Lab):
    """Each beat adds a histogram of at most 64 bins, whose width doubles as the range of values grows."""
    counts = st.refresh(
        lab.spark,
        lab.stream("events").select("value"),
        scratch(lab.spark, "summary"),
        partial=lambda rows: profile.doubling_counts(rows, "value"),
        merge=profile.merged_counts,
        finish=lambda counts: counts,
    )
    width = F.pow(F.lit(2.0), F.col("exponent").cast("double"))
    return counts.select((F.col("bin") * width).alias("edge"), width.alias("width"), "n")


@query("media_stream", "SELECT doc_id, md5(text) AS digest FROM documents")
def media_stream(lab: Lab):
    """Exported documents picked up file by file as they arrive."""
    folder = scratch(lab.spark, "incoming")
    lab.raw("documents").select("doc_id", "text").write.option("maxRecordsPerFile", 250).json(folder)
    files = st.media_stream(lab.spark, folder, "*.json")
    landed = st.append_to(lab.spark, files, scratch(lab.spark, "arrived"))
    return parsed_objects(landed)
