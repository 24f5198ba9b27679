"""Status boards and monitoring rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlab.functions.display import health_class, pod_color
from loomlab.operators.experiments import union_all


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table; Parquet footers answer this without reading a column."""
    return union_all([df.agg(F.lit(n).alias("relation"), F.count(F.lit(1)).alias("n")) for n, df in tables.items()])


def kpi_board(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table as a figure, and their total under a null name."""
    return row_counts(tables).rollup(F.col("relation").alias("kpi")).agg(F.sum("n").alias("n"))


def unread_count(notifications: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Unread notifications per user; with ``users``, also of those who never got one."""
    counted = notifications.groupBy("user_id").agg(F.count_if(~F.col("read")).alias("unread"))
    if users is None:
        return counted
    everyone = users.select(F.col("id").alias("user_id")).join(counted, "user_id", "left")
    return everyone.select("user_id", F.coalesce("unread", F.lit(0)).cast("long").alias("unread"))


def active_counts(members: DataFrame, by: str) -> DataFrame:
    """Members and active members (``active``; null is not active) per ``by``."""
    return members.groupBy(by).agg(F.count(F.lit(1)).alias("members"), F.count_if("active").alias("active"))


def feature_store_summary(features: DataFrame) -> DataFrame:
    """Features, distinct entities and online features per group, and over all groups (null).

    ``features`` has group_name, entity and online. Rows are counted per group and entity first, so a hot group reaches
    the distinct count as one row per entity.
    """
    per = features.groupBy("group_name", "entity").agg(F.count(F.lit(1)).alias("n"), F.count_if("online").alias("on"))
    return per.rollup("group_name").agg(
        F.sum("n").alias("features"), F.count_distinct("entity").alias("entities"), F.sum("on").alias("online")
    )


def set_summary(sets: DataFrame, as_of: Column) -> DataFrame:
    """Linked sets, distinct projects, and sets created in the seven days before ``as_of``."""
    age = F.timestamp_diff("SECOND", F.col("created_at"), as_of)
    return sets.agg(
        F.count("model_id").alias("linked"),
        F.count_distinct("project_id").alias("projects"),
        F.count_if(age < 7 * 24 * 3600).alias("recent"),
    )


def health(endpoints: DataFrame) -> DataFrame:
    return endpoints.withColumn("health", health_class(F.col("error_rate"), F.col("status")))


def health_percent(endpoints: DataFrame, by: str) -> DataFrame:
    """Percent of healthy endpoints per ``by`` and overall (null), rounded half up."""
    share = F.round(100.0 * F.count_if(F.col("health") == "healthy") / F.count(F.lit(1))).cast("long")
    return health(endpoints).rollup(by).agg(share.alias("percent"), F.count(F.lit(1)).alias("n"))


def alerts(endpoints: DataFrame) -> DataFrame:
    """Up to three alerts per endpoint, from one pass."""

    def alert(condition: Column, prefix: str, kind: str, *text: Column) -> Column:
        fields = F.struct(
            F.concat(F.lit(f"{prefix}-"), "id").alias("alert_id"), F.lit(kind).alias("kind"), F.concat(*text).alias("message")
        )
        return F.when(condition, fields)

    name = F.col("name")
    reading = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    found = F.array_compact(
        F.array(
            alert(F.col("error_rate") > 2, "err", "error", F.lit("Error rate spike on "), name, F.lit(": "), reading("error_rate"), F.lit("% (threshold: 2%)")),
            alert(F.col("latency") > 500, "warn", "warn", F.lit("High latency on "), name, F.lit(": "), reading("latency"), F.lit(" ms (threshold: 500 ms)")),
            alert(F.col("replicas") > 1, "info", "info", name, F.lit(" scaled to "), F.col("replicas").cast("string"), F.lit(" replicas")),
        )
    )
    return endpoints.select("id", F.explode(found).alias("a")).select("id", "a.*")


def replica_rows(endpoints: DataFrame) -> DataFrame:
    """One colored row per replica; none counts as one."""
    n = F.when(F.col("replicas") > 0, F.col("replicas")).otherwise(1)
    rows = health(endpoints).select("id", "name", "health", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("i"))
    return rows.select(
        F.concat("id", F.lit("-pod-"), "i").alias("pod"), F.col("name").alias("model"), pod_color(F.col("health")).alias("color")
    )


def capacity_percent(df: DataFrame, cpu: Column, ram: Column, gpu: Column) -> DataFrame:
    full = F.lit(100.0)
    return df.withColumns(
        {
            "cpu_percent": F.least(cpu * 12.5, full),
            "ram_percent": F.least(ram * 3.0, full),
            "gpu_percent": F.when(gpu > 0, F.least(gpu * 50.0, full)).otherwise(0.0),
        }
    )
