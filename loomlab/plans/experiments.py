"""Experiment, sweep and metric-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlab.functions import display
from loomlab.operators import experiments as ex
from loomlab.operators.catalog import rows_of
from loomlab.plans.registry import JOBS, METRICS, TRIALS, query
from loomlab.tables import Lab

# The runs relation for the twins, with one column per key.
RUNS = """runs AS (
  SELECT o_orderkey AS run_id, o_custkey AS experiment_id, o_orderdate AS created_at,
         CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 500000 END AS learning_rate,
         CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice / 500000 END AS lr,
         CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE left(o_orderpriority, 1) END AS tier,
         CASE WHEN o_custkey % 3 = 0 THEN o_totalprice / 500000 END AS accuracy,
         CASE WHEN o_custkey % 3 IN (0, 1) THEN 1 - o_totalprice / 500000 END AS loss,
         CASE WHEN o_custkey % 3 = 2 THEN o_totalprice / 500000 END AS val_error,
         CASE WHEN o_custkey % 3 = 2 THEN o_totalprice / 500000 * 2 END AS zeta
  FROM orders)"""
KEYS = ["learning_rate", "lr", "tier", "accuracy", "loss", "val_error", "zeta"]


def _number(key: str) -> str:
    return "coalesce(TRY_CAST(tier AS DOUBLE), 0.0)" if key == "tier" else f"coalesce({key}, 0.0)"


@query("status_counts", f"WITH {JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY status")
def status_counts(lab: Lab):
    return ex.status_counts(lab.jobs())


@query(
    "run_counts",
    "SELECT o_orderkey AS experiment_id, count(l_orderkey) AS runs FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
)
def run_counts(lab: Lab):
    return ex.run_counts(lab.jobs(), lab.artifacts().withColumnRenamed("job_id", "experiment_id"))


def event_runs(lab: Lab):
    """Events read as runs: parameters from their JSON text, one metric named by the type."""
    return lab.raw("events").select(
        F.col("user_id").alias("experiment_id"),
        F.col("event_id").alias("run_id"),
        F.from_json("props", "map<string,string>").alias("parameters"),
        F.create_map("event_type", "value").alias("metrics"),
    )


@query(
    "dynamic_keys",
    """SELECT DISTINCT 'parameter' AS kind, unnest(json_keys(props)) AS key FROM events
    UNION ALL SELECT DISTINCT 'metric', event_type FROM events""",
)
def dynamic_keys(lab: Lab):
    return ex.dynamic_keys(event_runs(lab))


@query(
    "experiment_summary",
    """SELECT user_id AS experiment_id, count(*) AS runs, 1::BIGINT AS parameter_keys,
    count(DISTINCT event_type) AS metric_keys FROM events GROUP BY 1""",
)
def experiment_summary(lab: Lab):
    return ex.experiment_summary(event_runs(lab))


@query(
    "epoch_loss",
    f"WITH {METRICS} SELECT job_id, epoch, round(sum(value) / greatest(count(*), 1), 9) AS loss, count(*) AS steps FROM metrics GROUP BY 1, 2",
)
def epoch_loss(lab: Lab):
    return ex.epoch_loss(lab.metrics()).withColumn("loss", F.round("loss", 9))


@query("next_version", "SELECT l_orderkey AS model_id, CAST(max(l_linenumber) + 1 AS BIGINT) AS next_version FROM lineitem GROUP BY 1")
def next_version(lab: Lab):
    return ex.next_version(lab.artifacts().select(F.col("job_id").alias("model_id"), F.col("line").alias("version")))


@query(
    "sweep_progress",
    f"""WITH {TRIALS} SELECT sweep_id, count(*) FILTER (status = 'completed') AS completed, count(*) AS planned,
    round(count(*) FILTER (status = 'completed') * 100.0::DOUBLE / count(*), 4) AS percent FROM trials GROUP BY 1""",
)
def sweep_progress(lab: Lab):
    return ex.sweep_progress(lab.trials())


@query(
    "last_metric",
    f"WITH {METRICS} SELECT job_id, metric_name, arg_max(value, {{'t': recorded_at, 'i': id}}) AS value FROM metrics GROUP BY 1, 2",
)
def last_metric(lab: Lab):
    return ex.last_metric(lab.metrics())


def _running_sql(fn: str, sign: str) -> str:
    return f"""WITH {TRIALS}, s AS (
      SELECT sweep_id, job_id, count(*) OVER w AS completed_trials,
             {fn}(CASE WHEN objective IS NOT NULL THEN {{'v': objective, 'j': {sign}job_id}} END) OVER w AS b
      FROM trials WINDOW w AS (PARTITION BY sweep_id ORDER BY job_id ROWS UNBOUNDED PRECEDING))
    SELECT sweep_id, job_id, completed_trials, b.v AS best_value, {sign}b.j AS best_job FROM s"""


@query("running_best", _running_sql("min", ""))
def running_best(lab: Lab):
    return ex.running_best(lab.trials(), minimize=True)


@query("running_best_maximize", _running_sql("max", "-"))
def running_best_maximize(lab: Lab):
    return ex.running_best(lab.trials(), minimize=False)


@query(
    "best_run",
    f"""WITH {RUNS}, v AS (
      SELECT experiment_id, run_id, 'accuracy' AS metric, accuracy AS value FROM runs WHERE experiment_id % 3 = 0
      UNION ALL SELECT experiment_id, run_id, 'loss', loss FROM runs WHERE experiment_id % 3 = 1
      UNION ALL SELECT experiment_id, run_id, 'val_error', val_error FROM runs WHERE experiment_id % 3 = 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY
             CASE WHEN metric = 'accuracy' THEN -value ELSE value END, run_id) AS k FROM v)
    SELECT experiment_id, metric, run_id, round(value, 10) AS value FROM r WHERE k = 1""",
)
def best_run(lab: Lab):
    return ex.best_run(lab.runs()).withColumn("value", F.round("value", 10))


@query(
    "best_flag",
    f"""WITH {RUNS}, t AS (SELECT experiment_id, run_id, coalesce(accuracy, 0) AS accuracy FROM runs)
    SELECT experiment_id, run_id, round(accuracy, 10) AS accuracy,
           accuracy = max(accuracy) OVER (PARTITION BY experiment_id) AND accuracy > 0 AS is_best FROM t""",
)
def best_flag(lab: Lab):
    flagged = ex.best_flag(ex.trial_view(lab.runs()).select("experiment_id", "run_id", "accuracy"))
    return flagged.withColumn("accuracy", F.round("accuracy", 10))


@query(
    "json_extract",
    f"""WITH {RUNS} SELECT experiment_id, run_id, round(coalesce(nullif(learning_rate, 0), nullif(lr, 0), 0), 10) AS learning_rate,
    32.0::DOUBLE AS batch_size, 4.0::DOUBLE AS layers, round(coalesce(accuracy, 0), 10) AS accuracy, round(coalesce(loss, 0), 10) AS loss FROM runs""",
)
def json_extract(lab: Lab):
    """Typed fields out of the JSON text of each run, with aliases and defaults."""
    texts = lab.runs().withColumns({"parameters": F.to_json("parameters"), "metrics": F.to_json("metrics")})
    parsed = texts.withColumns(
        {
            "parameters": F.from_json("parameters", "map<string,string>"),
            "metrics": F.from_json("metrics", "map<string,double>"),
        }
    )
    view = ex.trial_view(parsed)
    return view.withColumns({c: F.round(c, 10) for c in ("learning_rate", "accuracy", "loss")})


@query("metric_history", f"WITH {METRICS} SELECT * FROM metrics ORDER BY job_id, recorded_at, id")
def metric_history(lab: Lab):
    return ex.metric_history(lab.metrics())


@query(
    "first_per_step",
    f"""WITH {METRICS} SELECT job_id, metric_name, coalesce(epoch, step, 0) AS step,
    arg_min(value, {{'t': recorded_at, 'i': id}}) AS value FROM metrics GROUP BY 1, 2, 3""",
)
def first_per_step(lab: Lab):
    return ex.first_per_step(lab.metrics())


@query(
    "overlay_pivot",
    f"""WITH {METRICS} SELECT job_id, metric_name, coalesce(epoch, step, 0) AS step,
       arg_min(value, {{'t': recorded_at, 'i': id}}) AS value FROM metrics WHERE metric_name <> 'progress' GROUP BY 1, 2, 3""",
)
def overlay_pivot(lab: Lab):
    """The overlaid points of every job, in long form; columns are for runs that a caller lists."""
    return ex.overlay(lab.metrics(), "job_id")


@query(
    "overlay_columns",
    f"""WITH {METRICS}, p AS (SELECT job_id, metric_name, coalesce(epoch, step, 0) AS step,
       arg_min(value, {{'t': recorded_at, 'i': id}}) AS value FROM metrics WHERE metric_name <> 'progress' GROUP BY 1, 2, 3)
    SELECT metric_name, step, """
    + ", ".join(f"max(value) FILTER (job_id = {j}) AS \"{j}\"" for j in (1, 2, 3))
    + " FROM p WHERE job_id IN (1, 2, 3) GROUP BY 1, 2",
)
def overlay_columns(lab: Lab):
    """Three listed jobs side by side."""
    return ex.overlay_pivot(lab.metrics(), "job_id", [1, 2, 3])


@query(
    "metric_split",
    f"""WITH {METRICS} SELECT id, job_id, CASE metric_name WHEN 'error' THEN 'loss' ELSE 'accuracy' END AS series,
    coalesce(step, epoch, 0) AS x, value FROM metrics WHERE metric_name IN ('error', 'view')""",
)
def metric_split(lab: Lab):
    return ex.metric_split(lab.metrics(), loss="error", accuracy="view")


@query(
    "metric_key_order",
    f"""WITH {METRICS}, k AS (SELECT DISTINCT (['train_', 'val_', 'test_', 'best_', ''])[epoch % 5 + 1] || metric_name AS key FROM metrics)
    SELECT key, CAST(CASE WHEN starts_with(key, 'train') THEN 0 WHEN starts_with(key, 'val') THEN 1 WHEN starts_with(key, 'test') THEN 2
           WHEN starts_with(key, 'best') THEN 3 ELSE 4 END AS INTEGER) AS prefix_rank FROM k ORDER BY prefix_rank, key""",
)
def metric_key_order(lab: Lab):
    keys = metric_keys(lab).select("key").distinct()
    return keys.withColumn("prefix_rank", display.metric_prefix_rank(F.col("key"))).orderBy("prefix_rank", "key")


def metric_keys(lab: Lab):
    prefixes = F.array(*[F.lit(p) for p in ("train_", "val_", "test_", "best_", "")])
    return lab.metrics().withColumn("key", F.concat(prefixes[F.col("epoch") % 5], "metric_name"))


@query(
    "run_report",
    f"""WITH {METRICS}, k AS (
      SELECT job_id, (['train_', 'val_', 'test_', 'best_', ''])[epoch % 5 + 1]
        || CASE metric_name WHEN 'error' THEN 'loss' WHEN 'click' THEN 'accuracy' WHEN 'view' THEN 'f1' ELSE metric_name END AS key, value
      FROM metrics),
    a AS (SELECT job_id, key, avg(value) / 499 AS v FROM k GROUP BY 1, 2),
    s AS (SELECT *, contains(key, 'acc') OR contains(key, 'f1') AS score FROM a),
    m AS (SELECT job_id, max(v) AS top FROM s WHERE score GROUP BY 1)
    SELECT s.job_id, 'job-' || left(CAST(s.job_id AS VARCHAR), 4) AS label, key, replace(key, '_', ' ') AS title, round(v, 9) AS value,
      CASE WHEN score THEN printf('%.1f%%', v * 100 + CASE WHEN v * 400 % 2 = 1 THEN 0.01 ELSE 0 END)
           ELSE printf('%.4f', v + CASE WHEN v * 32 % 2 = 1 THEN 0.00001 ELSE 0 END) END AS shown,
      CASE WHEN contains(key, 'loss') THEN '#ef4444' WHEN contains(key, 'train') THEN '#8b5cf6' WHEN contains(key, 'val') THEN '#f59e0b'
           WHEN contains(key, 'test') THEN '#10b981' WHEN contains(key, 'f1') THEN '#3b82f6' WHEN contains(key, 'acc') THEN '#10b981'
           ELSE '#d4d4d4' END AS color,
      CASE WHEN score THEN CASE WHEN top > 0 THEN round(v / top * 100, 6) ELSE 0 END END AS percent_of_best
    FROM s LEFT JOIN m USING (job_id)""",
)
def run_report(lab: Lab):
    """Metric cards per job: title, shown text, color and share of the job's best score."""
    named = F.create_map(*[F.lit(x) for x in ("error", "loss", "click", "accuracy", "view", "f1")])
    prefixes = F.array(*[F.lit(p) for p in ("train_", "val_", "test_", "best_", "")])
    key = F.concat(prefixes[F.col("epoch") % 5], F.coalesce(named[F.col("metric_name")], "metric_name"))
    values = lab.metrics().groupBy("job_id", key.alias("key")).agg((F.avg("value") / 499).alias("value"))
    label = F.concat(F.lit("job-"), F.substring(F.col("job_id").cast("string"), 1, 4))
    cards = ex.metric_cards(values).withColumn("label", label)
    return cards.withColumns({"value": F.round("value", 9), "percent_of_best": F.round("percent_of_best", 6)})


@query(
    "series_slots",
    """WITH r AS (SELECT o_custkey AS experiment_id, o_orderkey AS run_id,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
    SELECT experiment_id, run_id, CAST(i % 10 AS INTEGER) AS slot,
      (['#10b981', '#3b82f6', '#f59e0b', '#ef4444', '#8b5cf6', '#ec4899', '#06b6d4', '#f97316', '#84cc16', '#6366f1'])[i % 10 + 1] AS color,
      left(printf('%06d-run', run_id), 8) AS label FROM r""",
)
def series_slots(lab: Lab):
    label = F.format_string("%06d-run", F.col("run_id"))
    return ex.series_slots(lab.runs().select("experiment_id", "run_id"), label)


@query(
    "merge_param_metric",
    f"WITH {RUNS} " + " UNION ALL ".join(f"SELECT run_id, '{k}' AS key, round({_number(k)}, 10) AS value FROM runs" for k in KEYS),
)
def merge_param_metric(lab: Lab):
    return ex.merge_param_metric(lab.runs(), KEYS).withColumn("value", F.round("value", 10))


@query(
    "run_matrix",
    f"WITH {RUNS} SELECT experiment_id, run_id, " + ", ".join(f"round({_number(k)}, 10) AS {k}" for k in KEYS) + " FROM runs",
)
def run_matrix(lab: Lab):
    return ex.run_matrix(lab.runs(), KEYS).withColumns({k: F.round(k, 10) for k in KEYS})


@query(
    "axis_scaling",
    f"WITH {RUNS}, x AS (SELECT run_id, 1.0::DOUBLE AS flat, " + ", ".join(f"{_number(k)} AS {k}" for k in KEYS) + " FROM runs), b AS (SELECT "
    + ", ".join(f"min({k}) AS {k}_lo, max({k}) AS {k}_hi" for k in KEYS)
    + " FROM x) SELECT run_id, 0.5::DOUBLE AS flat, "
    + ", ".join(f"round(({k} - {k}_lo) / ({k}_hi - {k}_lo), 6) AS {k}" for k in KEYS)
    + " FROM x, b",
)
def axis_scaling(lab: Lab):
    matrix = ex.run_matrix(lab.runs(), KEYS).drop("experiment_id").withColumn("flat", F.lit(1.0))
    return ex.axis_scaling(matrix, [*KEYS, "flat"]).withColumns({k: F.round(k, 6) for k in KEYS})


@query(
    "compare_table",
    f"""WITH {RUNS} SELECT experiment_id, run_id, created_at, round(learning_rate, 10) AS parameter_learning_rate,
    round(lr, 10) AS parameter_lr, tier AS parameter_tier, round(accuracy, 10) AS metric_accuracy, round(loss, 10) AS metric_loss,
    round(val_error, 10) AS metric_val_error, round(zeta, 10) AS metric_zeta FROM runs ORDER BY created_at, run_id""",
)
def compare_table(lab: Lab):
    table = ex.compare_table(lab.runs(), KEYS[:3], KEYS[3:])
    texts = ("parameter_learning_rate", "parameter_lr")
    numbers = {c: F.round(F.col(c).cast("double"), 10) for c in (*texts, *[c for c in table.columns if c.startswith("metric_")])}
    return table.withColumns(numbers)


@query(
    "trials_of_experiments",
    f"""WITH {TRIALS} SELECT t.sweep_id, t.job_id, t.status, c_nationkey AS project_id, c_name AS experiment
    FROM trials t JOIN customer ON t.sweep_id = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' ORDER BY job_id DESC""",
)
def trials_of_experiments(lab: Lab):
    trials = lab.trials().select("sweep_id", "job_id", "status")
    columns = ["project_id", F.col("name").alias("experiment")]
    return rows_of(trials, "sweep_id", lab.models(), columns, [F.col("job_id").desc()], framework="AUTOMOBILE")


@query(
    "run_series",
    f"""WITH {METRICS} SELECT c_custkey AS run_id, left(c_name, 8) AS label, metric_name, coalesce(epoch, step, 0) AS step, id, value
    FROM customer JOIN metrics ON c_custkey = job_id""",
)
def run_series(lab: Lab):
    """Points of every run that has a job with points."""
    runs = lab.models().select(F.col("id").alias("run_id"), F.col("id").alias("job_id"), F.substring("name", 1, 8).alias("label"))
    return ex.run_series(runs, lab.metrics())


@query(
    "model_latest_job_series",
    f"""WITH {JOBS}, {METRICS}, newest AS (
      SELECT model_id, arg_max(id, {{'t': created_at, 'i': id}}) AS job_id FROM jobs GROUP BY 1),
    m AS (SELECT *, row_number() OVER (PARTITION BY job_id, metric_name ORDER BY id) AS pos,
          CASE WHEN step >= 30 THEN step END AS s, CASE WHEN step >= 10 THEN epoch END AS e FROM metrics)
    SELECT model_id, job_id, metric_name, coalesce(s, e, pos) AS x, value FROM m JOIN newest USING (job_id)""",
)
def model_latest_job_series(lab: Lab):
    """Small steps are taken as missing, so all three x rules occur."""
    points = lab.metrics().withColumns(
        {
            "epoch": F.when(F.col("step") >= 10, F.col("epoch")),
            "step": F.when(F.col("step") >= 30, F.col("step")),
        }
    )
    return ex.latest_job_series(lab.jobs(), points)


@query(
    "version_history",
    """SELECT o_custkey AS model_id, o_orderkey AS id, o_orderpriority AS code,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
    o_orderkey < max(o_orderkey) OVER (PARTITION BY o_custkey) AS archived FROM orders""",
)
def version_history(lab: Lab):
    return ex.version_history(lab.jobs().select("model_id", "id", F.col("tier").alias("code")))


VERSIONS = """versions AS (
  SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_brand END AS registry_name, p_name AS name,
         CASE WHEN p_size % 3 > 0 THEN p_type END AS project, p_partkey AS version FROM part)"""


@query(
    "latest_version",
    f"""WITH {VERSIONS} SELECT coalesce(registry_name, name) AS family, project, max(version) AS version,
    arg_max(id, version) AS id FROM versions GROUP BY 1, 2""",
)
def latest_version(lab: Lab):
    """Newest version per (registry name or name, project); no project is a scope of its own."""
    models = lab.raw("part").select(
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("registry_name"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_type")).alias("project"),
        F.col("p_partkey").alias("version"),
        F.col("p_partkey").alias("id"),
    )
    return ex.latest_version(models)
