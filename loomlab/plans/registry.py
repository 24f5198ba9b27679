"""Name → (callable, oracle SQL) registry filled by the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomlab.tables import Lab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a :class:`Lab` under ``name``, with its SQL twin if there is one."""

    def wrap(fn: Callable[[Lab], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Lab(spark, folder))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


# Common table expressions shared by the SQL twins.
METRICS = """metrics AS (
  SELECT event_id AS id, user_id AS job_id, event_type AS metric_name, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS step,
         CAST(floor(CAST(json_extract_string(props, '$.k') AS INTEGER) / 10) AS INTEGER) AS epoch,
         ts AS recorded_at
  FROM events)"""

JOBS = """jobs AS (
  SELECT o_orderkey AS id, o_custkey AS model_id,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status,
         o_orderpriority AS tier, o_totalprice AS cost, o_orderdate AS created_at
  FROM orders)"""

ENDPOINTS = """endpoints AS (
  SELECT s_suppkey AS id, s_name AS name, s_nationkey AS project_id,
         CASE WHEN s_suppkey % 7 = 0 THEN 'stopped' ELSE 'active' END AS status,
         round(abs(s_acctbal) % 5, 2) AS error_rate, round(abs(s_acctbal) % 1000, 2) AS latency,
         1 + s_suppkey % 3 AS replicas
  FROM supplier)"""

TRIALS = """trials AS (
  SELECT o_custkey AS sweep_id, o_orderkey AS job_id,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS objective,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'pending' END AS status
  FROM orders)"""
