"""Training and scoring with user code, in parallel and without gathering a group.

A user trainer is a mergeable fold. ``partial`` turns one bounded batch of a group's rows into a
state, ``merge`` joins two states, ``finish`` makes metric rows of the last one. Batches are
folded inside the map tasks, so a group of any size crosses the network as a few states per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from multiprocessing.pool import ThreadPool
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlab.operators.sweeps import draw
from loomlab.session import scratch

FOLDS = 5
#: Least variance of a feature within a class.
MIN_VARIANCE = 1e-9
MERGE_FAN_IN = 64
OPEN_STATES = 10_000


class Trainer(Protocol):
    def partial(self, rows: pd.DataFrame, params: dict) -> list[float]: ...

    def merge(self, a: list[float], b: list[float]) -> list[float]: ...

    def finish(self, state: list[float], params: dict) -> dict[str, float]: ...


def user_train(df: DataFrame, keys: list[str], columns: list[str], trainer: Trainer, params: dict | None = None) -> DataFrame:
    """(keys…, metric_name, value): the metrics a user trainer reports for each group."""
    params = params or {}
    key_fields = [df.schema[k] for k in keys]
    state_schema = T.StructType([*key_fields, T.StructField("state", T.ArrayType(T.DoubleType()))])
    metric_schema = T.StructType([*key_fields, T.StructField("metric_name", T.StringType()), T.StructField("value", T.DoubleType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict[tuple, list[float]] = {}
        for batch in batches:
            for key, rows in batch.groupby(keys, dropna=False, sort=False):
                state = trainer.partial(rows, params)
                states[key] = trainer.merge(states[key], state) if key in states else state
            if len(states) > OPEN_STATES:
                yield pd.DataFrame([(*key, state) for key, state in states.items()], columns=[*keys, "state"])
                states = {}
        yield pd.DataFrame([(*key, state) for key, state in states.items()], columns=[*keys, "state"])

    def join(rows: pd.DataFrame) -> list[float]:
        state = list(rows["state"].iloc[0])
        for other in rows["state"].iloc[1:]:
            state = trainer.merge(state, list(other))
        return state

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.iloc[:1].copy()
        out["state"] = [join(rows)]
        return out[[*keys, "state"]]

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        metrics = trainer.finish(join(rows), params)
        key = [rows[k].iloc[0] for k in keys]
        return pd.DataFrame([(*key, n, float(v)) for n, v in metrics.items()], columns=[*keys, "metric_name", "value"])

    states = df.select(*keys, *columns).mapInPandas(fold, state_schema)
    salted = states.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_FAN_IN)))
    merged = salted.groupBy(*keys, "_salt").applyInPandas(lambda rows: merge(rows), state_schema)
    return merged.groupBy(*keys).applyInPandas(finish, metric_schema)


class LinearTrainer:
    """Least squares of one column on others; a trainer as users write them.

    Its state is the number of rows, the means, and the sums of products about the means, which merge without the
    cancellation that plain sums of products suffer far from zero. A penalty leaves the intercept alone.
    """

    def __init__(self, features: list[str], label: str):
        self.features, self.label = features, label

    def partial(self, rows: pd.DataFrame, params: dict) -> list[float]:
        x = rows[[*self.features, self.label]].to_numpy(float)
        mean = x.mean(axis=0)
        return [float(len(x)), *mean, *((x - mean).T @ (x - mean)).ravel()]

    def _parts(self, state: list[float]) -> tuple[float, np.ndarray, np.ndarray]:
        size = len(self.features) + 1
        return state[0], np.array(state[1 : size + 1]), np.array(state[size + 1 :]).reshape(size, size)

    def merge(self, a: list[float], b: list[float]) -> list[float]:
        (n, mean, spread), (m, other, more) = self._parts(a), self._parts(b)
        gap = other - mean
        return [n + m, *(mean + gap * (m / (n + m))), *(spread + more + np.outer(gap, gap) * (n * m / (n + m))).ravel()]

    def finish(self, state: list[float], params: dict) -> dict[str, float]:
        n, mean, spread = self._parts(state)
        inner, outer = spread[:-1, :-1], spread[:-1, -1]
        weights, *_ = np.linalg.lstsq(inner + np.eye(len(inner)) * params.get("ridge", 0.0), outer, rcond=None)
        squared = spread[-1, -1] - 2 * weights @ outer + weights @ inner @ weights
        named = {"intercept": mean[-1] - weights @ mean[:-1], **dict(zip(self.features, weights))}
        return {**named, "rows": n, "loss": max(squared, 0.0) / n}


def user_infer(df: DataFrame, features: list[str], model, output: str = "prediction") -> DataFrame:
    """Add the predictions of ``model(matrix) -> vector``; the model travels with the task once."""
    schema = T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())])

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{output: np.asarray(model(batch[features].to_numpy(float)), float)})

    return df.mapInPandas(infer, schema)


def batch_transform(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Apply a function of a batch of rows, which sees whole columns at a time."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(fn, batches)

    return df.mapInPandas(apply, schema)


def row_transform(df: DataFrame, fn: Callable[[dict], dict], schema: T.StructType | str) -> DataFrame:
    """Apply a function of one item to every row: for code that exists only in this form, as it runs row by row.

    What column expressions can say belongs in ``df.transform``, what arrays can say in :func:`batch_transform`.
    """
    return batch_transform(df, lambda batch: pd.DataFrame([fn(row) for row in batch.to_dict("records")]), schema)


# classifier in closed form ---------------------------------------------------------------------


def gaussian_models(df: DataFrame, features: list[str], label: str, fold: str | None = None, folds: int = 0) -> DataFrame:
    """One row (model, classes) for each fold left out, and one, numbered ``folds``, for all rows.

    A class has its label, its log prior and, per feature, mean and variance. They come from count, mean and spread about
    the mean per fold and label, so the rows are read once for all models: a model joins those of the other folds.
    Their means are taken as distances from one of them, so values far from zero lose no digits. Rows without a label
    say nothing, null features are left out. A model is as long as there are labels.
    """
    moments = {}
    for i, name in enumerate(features):
        x = F.col(name).cast("double")
        moments |= {f"n_{i}": F.count(x), f"m_{i}": F.avg(x), f"v_{i}": F.var_pop(x)}
    own = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label"), (F.col(fold) if fold else F.lit(-1)).alias("own"))
    own = own.agg(F.count(F.lit(1)).alias("n"), *[v.alias(k) for k, v in moments.items()])
    near = Window.partitionBy("label")
    own = own.select("*", *[F.min(f"m_{i}").over(near).alias(f"o_{i}") for i in range(len(features))])  # a row per fold
    rest = own.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(folds)))).where(F.col("own") != F.col("model"))
    joined = [F.sum("n").alias("n")]
    for i in range(len(features)):
        n, gap = F.col(f"n_{i}"), F.col(f"m_{i}") - F.col(f"o_{i}")
        joined += [F.sum(n).alias(f"n_{i}"), F.first(f"o_{i}").alias(f"o_{i}"), F.sum(n * gap).alias(f"s_{i}"), F.sum(n * (F.col(f"v_{i}") + gap * gap)).alias(f"q_{i}")]
    left = rest.groupBy("label", "model").agg(*joined)
    stats = []
    for i in range(len(features)):
        n = F.nullif(F.col(f"n_{i}"), F.lit(0))
        gap = F.col(f"s_{i}") / n
        stats.append(F.struct((F.col(f"o_{i}") + gap).alias("mean"), F.greatest(F.col(f"q_{i}") / n - gap * gap, F.lit(MIN_VARIANCE)).alias("variance")))
    one = F.struct("label", F.log(F.col("n").cast("double")).alias("prior"), F.array(*stats).alias("stats"))
    return left.groupBy("model").agg(F.collect_list(one).alias("classes"))


def gaussian_prediction(features: list[str]) -> Column:
    """The likeliest label by the ``classes`` of a model, the smallest of equals; a null feature has no say."""

    def cost(c: Column) -> Column:
        out = -c["prior"]
        for i, name in enumerate(features):
            s = c["stats"][i]
            off = F.col(name).cast("double") - s["mean"]
            out = out + F.coalesce(F.log(s["variance"]) / 2 + off * off / (2 * s["variance"]), F.lit(0.0))
        return F.struct(out.alias("cost"), c["label"].alias("label"))

    return F.array_min(F.transform("classes", cost))["label"]


def gaussian_train(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """The model of all labeled rows, a table of one row."""
    return gaussian_models(df, features, label)


def gaussian_infer(df: DataFrame, features: list[str], model: DataFrame, output: str = "prediction") -> DataFrame:
    """``df`` with the predictions of a one-row model; null everywhere if the model was fitted to nothing."""
    rows = df.withColumn("classes", model.select("classes").scalar())
    return rows.select(*df.columns, gaussian_prediction(features).alias(output))


def cv_train(df: DataFrame, key: str, features: list[str], label: str, folds: int = FOLDS) -> DataFrame:
    """Cross-validated accuracy and loss, then those of the fit on all rows: (epoch, metric_name, value).

    There are no more folds than rows, and folds without rows have no epoch. One pass sums up for every model, another
    scores each row by the model without its fold and by the whole one.
    """
    rows = df.where(F.col(label).isNotNull())
    folds = min(folds, rows.count())
    if not folds:
        return df.sparkSession.createDataFrame([], "epoch int, metric_name string, value double")
    placed = rows.withColumn("_fold", fold_of(key, folds))
    models = gaussian_models(placed, features, label, "_fold", folds)
    scored = placed.withColumn("model", F.explode(F.array(F.col("_fold"), F.lit(folds)))).join(models, "model")
    hit = (gaussian_prediction(features) == F.col(label)).cast("long")
    found = scored.groupBy("model").agg((F.sum(hit) / F.count(F.lit(1))).alias("accuracy"))
    found = found.withColumn("epoch", F.row_number().over(Window.orderBy("model")))  # one row per fold
    row = lambda name, value: F.struct(F.lit(name).alias("metric_name"), value.alias("value"))
    return found.select("epoch", F.inline(F.array(row("accuracy", F.col("accuracy")), row("loss", 1 - F.col("accuracy")))))


# pipelines of Spark ML -------------------------------------------------------------------------


def classifier(numeric: list[str], categorical: list[str], label: str, **params) -> Pipeline:
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in categorical]
    inputs = [*numeric, *[f"{c}_index" for c in categorical]]
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    model = LogisticRegression(featuresCol="features", labelCol=label, maxIter=params.get("max_iter", 10), regParam=params.get("reg", 0.01))
    return Pipeline(stages=[*indexers, assembler, model])


def stored(model: PipelineModel) -> PipelineModel:
    """The model as a job reads it back: saved to the shared folder, without training leftovers."""
    path = scratch(SparkSession.builder.getOrCreate(), "model")
    model.write().save(path)
    return PipelineModel.load(path)


def accuracy(scored: DataFrame, label: str) -> float:
    hit = F.avg((F.col("prediction") == F.col(label).cast("double")).cast("double"))
    return scored.agg(hit.alias("a")).first()["a"] or 0.0


def fold_of(key: str, folds: int) -> Column:
    """The fold of a row by the MD5 sum of its key, the same in every run and in any database."""
    return F.floor(draw("fold", 0, key) * folds).cast("int")


def cv_pipeline(df: DataFrame, key: str, label: str, pipeline: Pipeline, folds: int = FOLDS) -> tuple[DataFrame, PipelineModel]:
    """Cross-validate any pipeline, then fit on all rows: metric rows (epoch, metric_name, value) and the model.

    The folds run side by side; each fit and each score is a distributed job. :func:`cv_train` needs one fit for all.
    """
    spark = df.sparkSession
    folds = min(folds, df.count())
    placed = df.withColumn("_fold", fold_of(key, folds))

    def one_fold(i: int) -> float | None:
        held = placed.where(F.col("_fold") == i)
        if held.isEmpty():
            return None
        return accuracy(stored(pipeline.fit(placed.where(F.col("_fold") != i))).transform(held), label)

    with ThreadPool(folds) as pool:
        found = pool.map(inheritable_thread_target(spark)(one_fold), range(folds))
    rows, epoch = [], 0
    for score in found:
        if score is not None:
            epoch += 1
            rows += [(epoch, "accuracy", score), (epoch, "loss", 1 - score)]
    final = stored(pipeline.fit(df))
    score = accuracy(final.transform(df), label)
    rows += [(epoch + 1, "accuracy", score), (epoch + 1, "loss", 1 - score)]
    return spark.createDataFrame(rows, "epoch int, metric_name string, value double"), final
