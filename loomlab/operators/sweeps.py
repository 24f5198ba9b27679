"""Hyperparameter search: trial tables, their parameters, and sweeps over them.

A search space maps a name to a spec: {"type": "choice", "values": [...]}, {"type": "int_range",
"min": a, "max": b}, {"type": "uniform", ...} or {"type": "log_uniform", ...}.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlab.operators.experiments import running_best

# Bounds used where a spec names none.
DEFAULT_BOUNDS = {"uniform": (0.0, 1.0), "log_uniform": (1e-5, 1e-1), "int_range": (0, 10)}
DRAWN_DIGITS = 13


def bounds_of(spec: dict) -> tuple:
    low, high = DEFAULT_BOUNDS[spec["type"]]
    return spec.get("min", low), spec.get("max", high)


def choices(spec: dict) -> Column | None:
    values = spec.get("values") or []
    return F.array(*[F.lit(v) for v in values]) if values else None


def draw(name: str, seed: int, *keys: str) -> Column:
    """A number in [0, 1) that depends on the trial and the parameter only.

    Unlike ``rand`` it does not change with the partitioning or when a task is run again, and any
    database can draw the same: it is the first 13 hexadecimal digits of an MD5 sum.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(name), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, DRAWN_DIGITS), 16, 10).cast("double") / F.lit(16.0**DRAWN_DIGITS)


def sample(spec: dict, u: Column) -> Column:
    """One parameter value from a uniform number; null for unknown types."""
    kind = spec.get("type")
    if kind == "choice":
        values = choices(spec)
        return F.lit(None) if values is None else F.get(values, F.floor(u * F.size(values)).cast("int"))
    if kind not in DEFAULT_BOUNDS:
        return F.lit(None)
    low, high = bounds_of(spec)
    if kind == "uniform":
        return F.lit(float(low)) + u * float(high - low)
    if kind == "log_uniform":
        return F.exp(F.lit(math.log(low)) + u * (math.log(high) - math.log(low)))
    return (F.lit(int(low)) + F.floor(u * (int(high) - int(low) + 1))).cast("long")


def random_trials(trials: DataFrame, space: dict[str, dict], keys: list[str], seed: int = 0) -> DataFrame:
    """Add one randomly sampled column per parameter, identified by the trial's keys."""
    return trials.withColumns({n: sample(spec, draw(n, seed, *keys)) for n, spec in sorted(space.items())})


def grid_trials(trials: DataFrame, space: dict[str, dict], index: str, seed: int = 0) -> DataFrame:
    """Add one grid column per parameter, decoded from the trial index.

    Names go in alphabetical order and the first changes fastest. Past the last combination the
    grid starts over. Continuous parameters have no grid and are sampled.
    """
    columns, divisor = {}, 1
    for name, spec in sorted(space.items()):
        kind = spec.get("type")
        if kind == "choice":
            values = choices(spec)
            if values is None:
                columns[name] = F.lit(None)
                continue
            size = len(spec["values"])
            slot = F.expr(f"pmod({index} div {divisor}, {size})").cast("int")
            columns[name] = F.get(values, slot)
        elif kind == "int_range":
            low, high = bounds_of(spec)
            size = int(high) - int(low) + 1
            columns[name] = F.lit(int(low)) + F.expr(f"pmod({index} div {divisor}, {size})")
        else:
            columns[name] = sample(spec, draw(name, seed, index))
            continue
        divisor *= size
    return trials.withColumns(columns)


def train_params(jobs: DataFrame, sets: DataFrame) -> DataFrame:
    """Parameters of each job: its own, else those of its stored set, else none."""
    stored = sets.select(F.col("id").alias("set_id"), F.col("parameters").alias("_stored"))
    return jobs.join(stored, "set_id", "left").withColumn("parameters", F.coalesce("parameters", "_stored")).drop("_stored")


def sweep(trials: DataFrame, evaluate: Callable[[DataFrame], DataFrame], minimize: bool) -> tuple[DataFrame, DataFrame]:
    """Evaluate all trials at once; (state after every trial, one summary row per sweep).

    ``evaluate`` adds ``objective`` to trials (sweep_id, job_id, parameters…).
    """
    scored = evaluate(trials)
    job = F.col("job_id") if minimize else -F.col("job_id")
    score = F.when(F.col("objective").isNotNull(), F.struct(F.col("objective").alias("value"), job.alias("job")))
    best = (F.min if minimize else F.max)(score)
    summary = scored.groupBy("sweep_id").agg(F.count(F.lit(1)).alias("completed_trials"), best.alias("b"))
    best_job = F.col("b.job") if minimize else -F.col("b.job")
    return running_best(scored, minimize), summary.select(
        "sweep_id", "completed_trials", F.col("b.value").alias("best_value"), best_job.alias("best_job")
    )


# trials that train -----------------------------------------------------------------------------


def fold_moments(df: DataFrame, columns: list[str], fold: str, folds: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(rows, means, mean products about the means) of ``columns`` per fold, from one scan; rows with a null are left out.

    The driver holds a matrix per fold.
    """
    size = len(columns)
    x = [F.col(c).cast("double") for c in columns]
    aggs = [F.avg(v).alias(f"m{i}") for i, v in enumerate(x)]
    aggs += [F.covar_pop(x[i], x[j]).alias(f"s{i}_{j}") for i in range(size) for j in range(i, size)]
    rows = df.na.drop(subset=columns).groupBy(F.col(fold).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), *aggs).collect()
    out = [(0.0, np.zeros(size), np.zeros((size, size)))] * folds
    for r in rows:
        spread = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
        out[r["fold"]] = (float(r["n"]), np.array([r[f"m{i}"] for i in range(size)]), spread)
    return out


def joined_moments(parts: list[tuple]) -> tuple:
    """The moments of all parts together."""
    n = sum(p[0] for p in parts)
    mean = sum((p[0] * p[1] for p in parts), np.zeros_like(parts[0][1])) / max(n, 1.0)
    spread = sum((p[0] * (p[2] + np.outer(p[1] - mean, p[1] - mean)) for p in parts), np.zeros_like(parts[0][2])) / max(n, 1.0)
    return n, mean, spread


def ridge_errors(moments: list[tuple], features: list[int], penalties: np.ndarray) -> np.ndarray:
    """Held-out root mean squared error of a penalized line for each penalty; the last column is what is predicted.

    A line is fitted to the other folds and tried on each fold; both need nothing but the moments.
    """
    squared, rows = np.zeros(len(penalties)), 0.0
    for i, (n, mean, spread) in enumerate(moments):
        fitted, at, inner = joined_moments(moments[:i] + moments[i + 1 :])
        if not n or not fitted:
            continue
        known, unit = inner[np.ix_(features, features)], np.eye(len(features))
        w = np.linalg.solve(known + penalties[:, None, None] * unit, np.broadcast_to(inner[features, -1], (len(penalties), len(features)))[..., None])[..., 0]
        shift = (mean[-1] - at[-1]) - w @ (mean - at)[features]
        held = spread[-1, -1] - 2 * w @ spread[features, -1] + np.einsum("ij,jk,ik->i", w, spread[np.ix_(features, features)], w)
        squared += n * (held + shift**2)
        rows += n
    return np.sqrt(np.maximum(squared, 0.0) / rows) if rows else np.full(len(penalties), np.nan)


def ridge_trials(moments: list[tuple], columns: list[str], choices: dict[str, list[str]], choice: str, penalty: str, done: str) -> Callable[[DataFrame], DataFrame]:
    """An ``evaluate`` for :func:`sweep`: every trial fits lines with its features and penalty, and is scored on held-out rows.

    The table is read once for all trials, by :func:`fold_moments` over ``columns``. Trials for which ``done`` does not
    hold, and those without rows to learn from, have no objective.
    """

    def score(trials: DataFrame) -> DataFrame:
        schema = T.StructType([*trials.schema.fields, T.StructField("objective", T.DoubleType())])

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = pd.Series(np.nan, index=batch.index)
                for name, rows in batch[batch[done]].groupby(choice):
                    found[rows.index] = ridge_errors(moments, [columns.index(c) for c in choices[name]], rows[penalty].to_numpy(float))
                yield batch.assign(objective=found.astype(object).where(found.notna(), None))

        return trials.mapInPandas(fit, schema)

    return score
