"""Vectors as whole numbers: what the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlab.llm.common import stored


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """Rows of a list column, all of ``length`` values, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), length)


def whole_numbers(rows: DataFrame, vector: str, scale: int, most: Callable[[int], int]) -> DataFrame:
    """``rows`` with ``vector`` replaced by ``floor(scale * x)`` of each component, an array of integers.

    Rows go whose vector is null or holds a null or a value that is not finite. Numbers beyond ``most(components)``
    either way become that.
    """
    kept = [c for c in rows.columns if c != vector]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(vector)), -1).to_numpy(zero_copy_only=False)
            for n in np.unique(sizes[sizes >= 0]).tolist():
                some = batch.filter(pa.array(sizes == n))
                values = some.column(vector).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null becomes NaN
                values = values.reshape(some.num_rows, n)
                finite = np.isfinite(values).all(axis=1)
                limit = most(n)
                with np.errstate(over="ignore"):
                    values = np.clip(np.floor(values[finite] * scale), -limit, limit).astype(np.int32)
                some = some.filter(pa.array(finite))
                offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * np.int32(n))
                out = pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in kept), out], [*kept, vector])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != vector)
    return rows.mapInArrow(convert, f"{kinds}, `{vector}` array<int>")


def comparable(rows: DataFrame, key: str, vector: str, scale: int, most: Callable[[int], int], purpose: str) -> tuple[DataFrame, int]:
    """:func:`whole_numbers` of ``rows``, stored, and the number of components that all of them have.

    That is the number that the vector with the smallest key has (null keys last; of equal keys the shortest); rows with
    another number go. It is 0 if no row is left.
    """
    found = whole_numbers(rows, vector, scale, most)
    found = stored(found.withColumn("components", F.size(vector)), purpose)
    least = found.agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "components")).alias("least")).first()["least"]
    length = least["components"] if least else 0
    return found.where(F.col("components") == length).drop("components"), length
