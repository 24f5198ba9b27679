"""Analysis of experiment runs and metric series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlab.functions import display
from loomlab.functions.display import RUN_PALETTE
from loomlab.operators.grouped import latest, moment
from loomlab.operators.ordered import position, running

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number_or_zero(text: Column) -> Column:
    """A number, or 0 for anything that is not one."""
    parsed = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.coalesce(F.nanvl(parsed, F.lit(0.0)), F.lit(0.0))


def dynamic_keys(runs: DataFrame, params: str = "parameters", metrics: str = "metrics") -> DataFrame:
    """Distinct (kind, key) over all runs; duplicates fold before the shuffle."""
    tagged = F.concat(
        F.transform(F.coalesce(F.map_keys(params), F.array()), lambda k: F.struct(F.lit("parameter").alias("kind"), k.alias("key"))),
        F.transform(F.coalesce(F.map_keys(metrics), F.array()), lambda k: F.struct(F.lit("metric").alias("kind"), k.alias("key"))),
    )
    return runs.select(F.explode(tagged).alias("k")).select("k.kind", "k.key").distinct()


def experiment_summary(runs: DataFrame) -> DataFrame:
    """Runs, parameter keys and metric keys per experiment, in two pre-aggregated steps."""
    marks = F.concat(
        F.array(F.struct(F.lit("run").alias("kind"), F.lit("").alias("key"))),
        F.transform(F.coalesce(F.map_keys("parameters"), F.array()), lambda k: F.struct(F.lit("parameter").alias("kind"), k.alias("key"))),
        F.transform(F.coalesce(F.map_keys("metrics"), F.array()), lambda k: F.struct(F.lit("metric").alias("kind"), k.alias("key"))),
    )
    per_key = (
        runs.select("experiment_id", F.explode(marks).alias("k"))
        .groupBy("experiment_id", "k.kind", "k.key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return per_key.groupBy("experiment_id").agg(
        F.sum(F.when(F.col("kind") == "run", F.col("n"))).alias("runs"),
        F.count_if(F.col("kind") == "parameter").alias("parameter_keys"),
        F.count_if(F.col("kind") == "metric").alias("metric_keys"),
    )


def status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per status."""
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def run_counts(experiments: DataFrame, runs: DataFrame, key: str = "experiment_id") -> DataFrame:
    """Runs per experiment, zero kept. Runs are counted before the join, so a hot experiment is one row in it."""
    counts = runs.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    counted = experiments.select(F.col("id").alias(key)).join(counts, key, "left")
    return counted.select(key, F.coalesce("n", F.lit(0)).cast("long").alias("runs"))


def next_version(versions: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """The version that an update of each model gets. Models of ``models`` without a version get their first."""
    newest = versions.groupBy("model_id").agg(F.max("version").cast("long").alias("newest"))
    if models is not None:
        newest = models.select(F.col("id").alias("model_id")).join(newest, "model_id", "left")
    return newest.select("model_id", (F.coalesce("newest", F.lit(0)) + 1).cast("long").alias("next_version"))


def latest_version(models: DataFrame) -> DataFrame:
    """(family, project, version, id) of the newest version of each family: the registry name, else the name, in a project.

    Models without a project are a scope of their own. Of equal versions the greatest id counts.
    """
    family = F.coalesce("registry_name", "name").alias("family")
    rows = models.select(family, "project", "version", "id")
    newest = rows.groupBy("family", "project", "version").agg(F.max("id").alias("id"))
    return newest.groupBy("family", "project").agg(F.max("version").alias("version"), F.max_by("id", "version").alias("id"))


def best_run(runs: DataFrame, minimize: Column | None = None) -> DataFrame:
    """The best run of each experiment by its primary metric.

    The primary metric is ``accuracy`` if any run has it, else the first key in alphabetical
    order. It is minimized if it is ``loss`` or contains ``error``, unless ``minimize`` (a
    condition on ``metric``) says otherwise. Of equal runs the first listed wins. Runs without
    the key never win over runs with it, so only present values are aggregated.
    """
    direction = (F.col("metric") == "loss") | F.col("metric").contains("error") if minimize is None else minimize
    values = runs.select("experiment_id", "run_id", F.explode("metrics").alias("metric", "value")).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    per_key = values.groupBy("experiment_id", "metric").agg(
        F.min(F.struct("value", F.col("run_id").alias("id"))).alias("low"),
        F.max(F.struct("value", (-F.col("run_id")).alias("id"))).alias("high"),
    )
    chosen = per_key.groupBy("experiment_id").agg(
        F.min_by(F.struct("metric", "low", "high"), F.struct(F.col("metric") != "accuracy", "metric")).alias("c")
    )
    return chosen.select("experiment_id", "c.*").select(
        "experiment_id",
        "metric",
        F.when(direction, F.col("low.id")).otherwise(-F.col("high.id")).alias("run_id"),
        F.when(direction, F.col("low.value")).otherwise(F.col("high.value")).alias("value"),
    )


def trial_view(runs: DataFrame) -> DataFrame:
    """Typed trial fields with alias fallbacks; zero counts as missing."""

    def first_set(*names: str, default: float) -> Column:
        options = [F.nullif(number_or_zero(F.col("parameters")[n]), F.lit(0.0)) for n in names]
        return F.coalesce(*options, F.lit(default))

    return runs.select(
        "experiment_id",
        "run_id",
        first_set("learning_rate", "lr", default=0.0).alias("learning_rate"),
        first_set("batch_size", "batch", default=32.0).alias("batch_size"),
        first_set("layers", "n_layers", default=4.0).alias("layers"),
        F.coalesce(F.col("metrics")["accuracy"], F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.col("metrics")["loss"], F.lit(0.0)).alias("loss"),
    )


def best_flag(trials: DataFrame) -> DataFrame:
    """Marks every trial that reaches its experiment's highest accuracy, if that is above 0."""
    top = trials.groupBy("experiment_id").agg(F.max("accuracy").alias("_top"))
    flagged = trials.join(top, "experiment_id")
    return flagged.withColumn(
        "is_best", (F.col("accuracy") == F.col("_top")) & (F.col("accuracy") > 0)
    ).drop("_top")


def running_best(trials: DataFrame, minimize: bool) -> DataFrame:
    """State of each sweep after every trial: completed count, best value and best job.

    Only a strictly better value replaces the best, and trials without a value are skipped, so
    the best is the extreme of (value, job) with the earlier job winning ties.
    """
    job = F.col("job_id") if minimize else -F.col("job_id")
    scored = F.when(F.col("objective").isNotNull(), F.struct(F.col("objective").alias("value"), job.alias("job")))
    state = running(
        trials.select("sweep_id", "job_id", "objective"),
        ["sweep_id"],
        "job_id",
        {"completed_trials": ("count", F.lit(1)), "_best": ("min" if minimize else "max", scored)},
    )
    best_job = F.col("_best.job") if minimize else -F.col("_best.job")
    return state.select(
        "sweep_id", "job_id", "completed_trials", F.col("_best.value").alias("best_value"), best_job.alias("best_job")
    )


def sweep_progress(trials: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "completed")
    planned = F.count(F.lit(1))
    return trials.groupBy("sweep_id").agg(
        done.alias("completed"), planned.alias("planned"), F.round(F.try_divide(done * 100.0, planned), 4).alias("percent")
    )


# metric series -----------------------------------------------------------------------------


def metric_history(metrics: DataFrame, job=None) -> DataFrame:
    """All points of a job, or of every job, oldest first."""
    chosen = metrics if job is None else metrics.where(F.col("job_id") == F.lit(job))
    return chosen.orderBy("job_id", "recorded_at", "id")


def epoch_loss(metrics: DataFrame) -> DataFrame:
    """Mean of the step losses of each job and epoch, and their number; 0 where no step has a loss."""
    steps = F.count("value")
    loss = F.coalesce(F.sum("value"), F.lit(0.0)) / F.greatest(steps, F.lit(1))
    return metrics.groupBy("job_id", "epoch").agg(loss.alias("loss"), steps.alias("steps"))


def run_series(runs: DataFrame, metrics: DataFrame, metric: str | None = None) -> DataFrame:
    """Points of every run, under its label; runs without a job, or whose job has no points, have none.

    ``runs`` has run_id, job_id and label. x is the epoch, else the step, else 0. Runs may share a job.
    """
    points = metrics if metric is None else metrics.where(F.col("metric_name") == metric)
    points = points.select("job_id", "metric_name", F.coalesce("epoch", "step", F.lit(0)).alias("step"), "id", "value")
    return points.join(runs.select("run_id", "job_id", "label"), "job_id").drop("job_id")


def metric_cards(values: DataFrame, run: str = "job_id") -> DataFrame:
    """Title, shown text and color of each (run, key, value), and scores as percent of the run's best one.

    Missing scores count as 0, and if no score is above 0 all are 0 percent.
    """
    score = display.is_score(F.col("key"))
    amount = F.coalesce("value", F.lit(0.0))
    best = values.groupBy(run).agg(F.max(F.when(score, amount)).alias("_top"))
    share = F.when(F.col("_top") > 0, amount / F.col("_top") * 100).otherwise(0.0)
    return values.join(best, run).select(
        *values.columns,
        display.metric_label(F.col("key")).alias("title"),
        display.metric_text(F.col("key"), F.col("value")).alias("shown"),
        display.metric_color(F.col("key")).alias("color"),
        F.when(score, share).alias("percent_of_best"),
    )


def last_metric(metrics: DataFrame) -> DataFrame:
    """Last recorded value per job and metric."""
    return metrics.groupBy("job_id", "metric_name").agg(
        F.max_by("value", moment("recorded_at", "id")).alias("value")
    )


def first_per_step(metrics: DataFrame, keys=("job_id", "metric_name")) -> DataFrame:
    """Earliest recorded point per key and step, where step is epoch, else step, else 0."""
    step = F.coalesce("epoch", "step", F.lit(0)).alias("step")
    return metrics.groupBy(*keys, step).agg(F.min_by("value", moment("recorded_at", "id")).alias("value"))


def overlay(metrics: DataFrame, run: str) -> DataFrame:
    """The overlaid points of all runs in long form: (run, metric, step, value)."""
    return first_per_step(metrics.where(F.col("metric_name") != "progress"), (run, "metric_name"))


def overlay_pivot(metrics: DataFrame, run: str, runs: list) -> DataFrame:
    """One row per (metric, step) and one column per listed run, empty where a run has no point."""
    points = overlay(metrics.where(F.col(run).isin(runs)), run)
    return points.groupBy("metric_name", "step").pivot(run, runs).agg(F.first("value"))


def metric_split(metrics: DataFrame, loss: str = "loss", accuracy: str = "accuracy") -> DataFrame:
    """The points of the loss and the accuracy series, x = step, else epoch, else 0."""
    series = F.when(F.col("metric_name") == loss, "loss").otherwise("accuracy")
    return metrics.where(F.col("metric_name").isin(loss, accuracy)).select(
        "id", "job_id", series.alias("series"), F.coalesce("step", "epoch", F.lit(0)).alias("x"), "value"
    )


def latest_job_series(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics of each model's newest job; x = step, else epoch, else the position in its series."""
    newest = latest(jobs.select("model_id", "id", "created_at"), ["model_id"], ["created_at", "id"])
    mine = metrics.join(newest.select("model_id", F.col("id").alias("job_id")), "job_id")
    placed = position(mine, ["job_id", "metric_name"], "id", "_pos", measure=metrics.select("id"))
    x = F.coalesce(F.col("step").cast("long"), F.col("epoch").cast("long"), F.col("_pos") + 1)
    return placed.select("model_id", "job_id", "metric_name", x.alias("x"), "value")


def series_slots(runs: DataFrame, label: Column) -> DataFrame:
    """Color slot of each run (its index in the experiment modulo the palette) and short label."""
    placed = position(runs, ["experiment_id"], "run_id", "_pos")
    slot = (F.col("_pos") % len(RUN_PALETTE)).cast("int")
    colors = F.array(*[F.lit(c) for c in RUN_PALETTE])
    return placed.select(
        "experiment_id", "run_id", slot.alias("slot"), colors[slot].alias("color"), F.substring(label, 1, 8).alias("label")
    )


# run tables --------------------------------------------------------------------------------


def merged_value(key: str) -> Column:
    """Parameter value of the key, else its metric value, as a number or 0."""
    given = F.col("parameters")[key]
    measured = F.coalesce(F.nanvl(F.col("metrics")[key], F.lit(0.0)), F.lit(0.0))
    return F.when(given.isNotNull(), number_or_zero(given)).otherwise(measured)


def merge_param_metric(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per run and key."""
    cells = [F.struct(F.lit(k).alias("key"), merged_value(k).alias("value")) for k in keys]
    return runs.select("run_id", F.explode(F.array(*cells)).alias("c")).select("run_id", "c.*")


def run_matrix(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Wide form: one numeric column per key."""
    return runs.select("experiment_id", "run_id", *[merged_value(k).alias(k) for k in keys])


def axis_scaling(matrix: DataFrame, dimensions: list[str]) -> DataFrame:
    """Each dimension scaled to 0..1 over all rows; a constant one becomes 0.5."""
    bounds = matrix.agg(*[f(d).alias(f"{d}:{n}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {}
    for d in dimensions:
        lo, hi = bounds[f"{d}:lo"], bounds[f"{d}:hi"]
        scaled[d] = F.lit(0.5) if lo == hi else (F.col(d) - F.lit(lo)) / F.lit(hi - lo)
    return matrix.withColumns(scaled)


def compare_table(runs: DataFrame, params: list[str] | None = None, metrics: list[str] | None = None) -> DataFrame:
    """All runs side by side, oldest first: one column per listed key, or the maps where no keys are listed."""
    if params is None or metrics is None:
        return runs.select("experiment_id", "run_id", "created_at", "parameters", "metrics").orderBy("created_at", "run_id")
    return runs.select(
        "experiment_id",
        "run_id",
        "created_at",
        *[F.col("parameters")[k].alias(f"parameter_{k}") for k in params],
        *[F.col("metrics")[k].alias(f"metric_{k}") for k in metrics],
    ).orderBy("created_at", "run_id")


def version_history(updates: DataFrame) -> DataFrame:
    """Every update of a model as a version row; all but the newest are archived."""
    walked = running(updates, ["model_id"], "id", {"version": ("count", F.lit(1)), "_total": ("total", F.lit(1))})
    return walked.withColumn("archived", F.col("version") < F.col("_total")).drop("_total")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
