"""Counts, boards, monitoring and display queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlab.functions import display
from loomlab.operators import reports
from loomlab.plans.registry import ENDPOINTS, JOBS, query
from loomlab.tables import Lab

COUNTED = ("nation", "customer", "part", "orders", "lineitem", "events")


@query("system_stats", " UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS n FROM {t}" for t in COUNTED))
def system_stats(lab: Lab):
    return reports.row_counts({t: lab.raw(t) for t in COUNTED})


@query("unread_count", "SELECT user_id, count(*) FILTER (NOT value < 50) AS unread FROM events GROUP BY 1")
def unread_count(lab: Lab):
    return reports.unread_count(lab.notifications())


@query(
    "kpi_board",
    f"""WITH {JOBS}, c AS (SELECT 'projects' AS kpi, count(*) AS n FROM nation UNION ALL SELECT 'models', count(*) FROM customer
      UNION ALL SELECT 'datasets', count(*) FROM part
      UNION ALL SELECT 'active', count(*) FROM jobs WHERE status IN ('running', 'pending'))
    SELECT kpi, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ROLLUP (kpi)""",
)
def kpi_board(lab: Lab):
    """Catalog sizes and active jobs, with the total under a null name."""
    active = lab.jobs().where(F.col("status").isin("running", "pending"))
    return reports.kpi_board({"projects": lab.projects(), "models": lab.models(), "datasets": lab.raw("part"), "active": active})


@query(
    "set_summary",
    """SELECT count(CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) AS linked, count(DISTINCT CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END) AS projects,
    count(*) FILTER (epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(o_orderdate) < 604800) AS recent FROM orders""",
)
def set_summary(lab: Lab):
    sets = lab.jobs().select(
        F.when(F.col("status") != "pending", F.col("model_id")).alias("model_id"),
        F.when(F.col("id") % 4 > 0, F.col("model_id")).alias("project_id"),
        "created_at",
    )
    return reports.set_summary(sets, F.lit("2001-08-02 00:00:00").cast("timestamp_ntz"))


@query(
    "feature_store_summary",
    """SELECT p_brand AS group_name, count(*) AS features, count(DISTINCT p_type) AS entities, count(*) FILTER (p_size > 25) AS online
    FROM part GROUP BY ROLLUP (p_brand)""",
)
def feature_store_summary(lab: Lab):
    online = (F.col("p_size") > 25).alias("online")
    features = lab.raw("part").select(F.col("p_brand").alias("group_name"), F.col("p_type").alias("entity"), online)
    return reports.feature_store_summary(features)


@query(
    "active_counts",
    """SELECT s_nationkey AS project_id, count(*) AS members, count(*) FILTER (s_acctbal > 0) AS active FROM supplier GROUP BY 1""",
)
def active_counts(lab: Lab):
    members = lab.raw("supplier").select(F.col("s_nationkey").alias("project_id"), (F.col("s_acctbal") > 0).alias("active"))
    return reports.active_counts(members, "project_id")


HEALTH = "CASE WHEN error_rate > 2 THEN 'degraded' WHEN status = 'active' THEN 'healthy' ELSE 'unhealthy' END"


@query(
    "health_class",
    f"""WITH {ENDPOINTS} SELECT id, name, replicas || 'x' AS version, {HEALTH} AS health, error_rate, CAST(floor(latency + 0.5) AS BIGINT) AS latency
    FROM endpoints""",
)
def health_class(lab: Lab):
    return reports.health(lab.endpoints()).select(
        "id", "name", F.concat("replicas", F.lit("x")).alias("version"), "health", "error_rate", F.floor(F.col("latency") + 0.5).alias("latency")
    )


@query(
    "health_pct",
    f"""WITH {ENDPOINTS} SELECT project_id, CAST(round(100.0::DOUBLE * count(*) FILTER ({HEALTH} = 'healthy') / count(*)) AS BIGINT) AS percent, count(*) AS n
    FROM endpoints GROUP BY ROLLUP (project_id)""",
)
def health_pct(lab: Lab):
    return reports.health_percent(lab.endpoints(), "project_id")


@query(
    "alerts",
    f"""WITH {ENDPOINTS} SELECT id, 'err-' || id AS alert_id, 'error' AS kind, 'Error rate spike on ' || name || ': ' || CAST(CAST(error_rate AS DECIMAL(18,2)) AS VARCHAR) || '% (threshold: 2%)' AS message FROM endpoints WHERE error_rate > 2
    UNION ALL SELECT id, 'warn-' || id, 'warn', 'High latency on ' || name || ': ' || CAST(CAST(latency AS DECIMAL(18,2)) AS VARCHAR) || ' ms (threshold: 500 ms)' FROM endpoints WHERE latency > 500
    UNION ALL SELECT id, 'info-' || id, 'info', name || ' scaled to ' || replicas || ' replicas' FROM endpoints WHERE replicas > 1""",
)
def alerts(lab: Lab):
    return reports.alerts(lab.endpoints())


@query(
    "replica_rows",
    f"""WITH {ENDPOINTS}, h AS (SELECT *, {HEALTH} AS health FROM endpoints)
    SELECT id || '-pod-' || i AS pod, name AS model, CASE health WHEN 'healthy' THEN 'green' WHEN 'degraded' THEN 'yellow' ELSE 'red' END AS color
    FROM h, unnest(range(0, CAST(replicas AS BIGINT))) AS u(i)""",
)
def replica_rows(lab: Lab):
    return reports.replica_rows(lab.endpoints())


@query(
    "capacity_pct",
    """SELECT p_partkey AS id, least((p_size % 12) * 12.5::DOUBLE, 100.0::DOUBLE) AS cpu_percent, least(p_size * 3.0::DOUBLE, 100.0::DOUBLE) AS ram_percent,
    CASE WHEN p_size % 4 > 0 THEN least((p_size % 4) * 50.0::DOUBLE, 100.0::DOUBLE) ELSE 0.0::DOUBLE END AS gpu_percent FROM part""",
)
def capacity_pct(lab: Lab):
    size = F.col("p_size")
    rows = reports.capacity_percent(lab.raw("part"), size % 12, size, size % 4)
    return rows.select(F.col("p_partkey").alias("id"), "cpu_percent", "ram_percent", "gpu_percent")


# display rules -----------------------------------------------------------------------------

# Work dates of a job: from its order date to its last shipment, if it completed.
SPANS = f"""{JOBS}, ends AS (SELECT l_orderkey AS id, max(l_shipdate) AS last_day FROM lineitem GROUP BY 1),
spans AS (SELECT jobs.id, status, CASE WHEN status <> 'pending' THEN created_at + INTERVAL (jobs.id % 97) SECOND END AS started,
          CASE WHEN status = 'completed' THEN CASE WHEN jobs.id % 3 = 0 THEN created_at + INTERVAL (jobs.id % 7000) SECOND ELSE last_day END END AS ended
          FROM jobs LEFT JOIN ends ON jobs.id = ends.id),
spent AS (SELECT *, CAST(greatest(0, epoch(coalesce(ended, TIMESTAMP '2001-12-01 12:00:00')) - epoch(started)) AS BIGINT) AS total FROM spans)"""
AS_OF = "2001-12-01 12:00:00"


@query(
    "job_report",
    f"""WITH {SPANS} SELECT id, upper(left(status, 1)) || substr(status, 2) AS status,
      CASE WHEN started IS NULL THEN '—' WHEN total < 60 THEN total || 's' WHEN total < 3600 THEN (total // 60) || 'm ' || (total % 60) || 's'
           ELSE (total // 3600) || 'h ' || (total // 60 % 60) || 'm' END AS duration,
      CASE WHEN started IS NOT NULL THEN printf('%02d:%02d:%02d', total // 3600, total // 60 % 60, total % 60) END AS clock,
      CASE WHEN started IS NULL THEN '—' ELSE CASE WHEN mins < 60 THEN mins || 'm ago' WHEN mins < 1440 THEN (mins // 60) || 'h ago'
           ELSE (mins // 1440) || 'd ago' END END AS started_ago,
      left(printf('%010d', id), 8) AS label
    FROM (SELECT *, CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(started)) / 60) AS BIGINT) AS mins FROM spent)""",
)
def job_report(lab: Lab):
    """Status, duration, clock, age and short label of every job."""
    ends = lab.artifacts().groupBy(F.col("job_id").alias("id")).agg(F.max("created_at").alias("last_day"))
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    spans = (
        lab.jobs()
        .join(ends, "id", "left")
        .select(
            "id",
            "status",
            F.when(F.col("status") != "pending", F.col("created_at") + F.make_dt_interval(secs=F.col("id") % 97)).alias("started"),
            F.when(
                F.col("status") == "completed",
                F.when(F.col("id") % 3 == 0, F.col("created_at") + F.make_dt_interval(secs=F.col("id") % 7000)).otherwise(F.col("last_day")),
            ).alias("ended"),
        )
    )
    started, ended = F.col("started"), F.col("ended")
    total = F.greatest(F.lit(0), display.seconds_between(started, F.coalesce(ended, as_of)))
    return spans.select(
        "id",
        display.capitalize_first(F.col("status")).alias("status"),
        display.duration_text(started, ended, as_of).alias("duration"),
        F.when(started.isNotNull(), display.clock_text(total)).alias("clock"),
        display.time_ago(started, as_of, with_date=False).alias("started_ago"),
        F.substring(F.format_string("%010d", F.col("id")), 1, 8).alias("label"),
    )


NOW = "2024-01-31 23:00:00"


@query(
    "time_ago",
    f"""WITH a AS (SELECT event_id AS id, ts, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 60000000) AS BIGINT) AS m FROM events)
    SELECT id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago' WHEN m < 10080 THEN (m // 1440) || 'd ago'
      ELSE strftime(ts, '%-m/%-d/%Y') END AS age FROM a""",
)
def time_ago(lab: Lab):
    return lab.notifications().select("id", display.time_ago(F.col("created_at"), F.lit(NOW).cast("timestamp_ntz")).alias("age"))


@query(
    "day_bucket",
    f"""SELECT event_id AS id, CASE WHEN ts >= TIMESTAMP '2024-01-31 00:00:00' THEN 'today' WHEN ts >= TIMESTAMP '2024-01-28 00:00:00' THEN 'week' ELSE 'earlier' END AS bucket
    FROM events""",
)
def day_bucket(lab: Lab):
    return lab.notifications().select("id", display.day_bucket(F.col("created_at"), F.lit(NOW).cast("timestamp_ntz")).alias("bucket"))


def _bytes_sql(size: str) -> str:
    arms = " ".join(
        f"WHEN {size} < {1024 ** (i + 1)} THEN printf('%.1f {u}', floor({size} / {1024**i}.0::DOUBLE * 10 + 0.5) / 10)"
        for i, u in enumerate(("B", "KB", "MB", "GB"))
    )
    return f"CASE WHEN {size} IS NULL OR {size} = 0 THEN '—' {arms} ELSE printf('%.1f TB', floor({size} / {1024**4}.0::DOUBLE * 10 + 0.5) / 10) END"


@query(
    "bytes_text",
    f"""WITH s AS (SELECT p_partkey AS id, CASE WHEN p_size = 1 THEN 0 WHEN p_size = 2 THEN NULL ELSE CAST(power(2, p_size) AS BIGINT) * 3 // 2 + p_partkey END AS size FROM part)
    SELECT id, size, {_bytes_sql('size')} AS shown FROM s""",
)
def bytes_text(lab: Lab):
    grown = F.expr("cast(power(2, p_size) as bigint) * 3 div 2 + p_partkey")
    size = F.when(F.col("p_size") == 1, 0).when(F.col("p_size") == 2, None).otherwise(grown)
    return lab.raw("part").select(F.col("p_partkey").alias("id"), size.alias("size")).withColumn("shown", display.bytes_text(F.col("size")))
