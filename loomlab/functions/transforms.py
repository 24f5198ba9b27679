"""Feature transforms as column expressions over stored statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlab.operators.profile import Stats


def standard_scale(x: Column, stats: Stats) -> Column:
    """(x - mean) / std; unchanged when the stored deviation is missing or zero."""
    if not stats.std:
        return x
    return (x - F.lit(stats.mean or 0.0)) / F.lit(stats.std)


def min_max_scale(x: Column, stats: Stats) -> Column:
    """(x - min) / (max - min); unchanged when the stored range is empty."""
    if stats.max == stats.min or stats.max is None or stats.min is None:
        return x
    return (x - F.lit(stats.min)) / F.lit(stats.max - stats.min)


def log_scale(x: Column) -> Column:
    """log1p; null outside its domain."""
    return F.log1p(x)


def categories(df: DataFrame, column: str) -> list:
    """Sorted distinct values, for a stored definition that makes a column of each; see :func:`sparse_hot`."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


def one_hot(column: str, values: list) -> list[Column]:
    """One boolean column per value; all false for null."""
    return [F.coalesce(F.col(column) == F.lit(v), F.lit(False)).alias(f"{column}_{v}") for v in values]


def sparse_hot(column: str) -> Column:
    """The value as the only key of a map, empty for null: one-hot for any number of values, without a list of them."""
    value = F.col(column)
    return F.when(value.isNotNull(), F.create_map(value, F.lit(True))).otherwise(F.map_from_arrays(F.array_compact(F.array(value)), F.array().cast("array<boolean>"))).alias(f"{column}_one_hot")


@dataclass(frozen=True)
class Feature:
    """A stored feature definition; ``categories`` are the values that one-hot makes columns of."""

    name: str
    transform: str | None = None
    stats: Stats = field(default_factory=lambda: Stats(0.0, 1.0, 0.0, 1.0))
    categories: tuple | None = None


def apply_features(df: DataFrame, features: list[Feature]) -> DataFrame:
    """Apply every stored transform in one projection.

    Definitions without a transform, and those of columns the frame lacks, are skipped;
    one-hot columns come last, in definition order, as one sparse map where the definition lists no categories.
    """
    latest = {f.name: f for f in features}
    kept, appended = [], []
    for c in df.columns:
        feature = latest.get(c)
        kind = feature.transform if feature else None
        if kind == "standard_scaler":
            kept.append(standard_scale(F.col(c), feature.stats).alias(c))
        elif kind == "min_max_scaler":
            kept.append(min_max_scale(F.col(c), feature.stats).alias(c))
        elif kind == "log_transform":
            kept.append(log_scale(F.col(c)).alias(c))
        elif kind != "one_hot":
            kept.append(F.col(c))
    for feature in latest.values():
        if feature.transform == "one_hot" and feature.name in df.columns:
            listed = feature.categories
            appended += [sparse_hot(feature.name)] if listed is None else one_hot(feature.name, list(listed))
    return df.select(*kept, *appended)
