"""Per-group selections that aggregate or cut down before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moment(at: str, ident: str) -> Column:
    """One sortable number of a time and, for equal times, an id.

    Aggregates over a struct of the two cannot use hash aggregation; over a number they can.
    """
    micros = f"timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast({at} as timestamp_ntz))"
    micros = f"coalesce({micros}, -999999999999999999)"  # no time comes before any
    wide = f"cast({micros} as decimal(18,0)) * cast(20000000000000000000 as decimal(20,0))"
    return F.expr(f"cast({wide} as decimal(38,0)) + cast({ident} as decimal(19,0))")


FIXED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; a partial ``max_by`` runs before the shuffle.

    Where all other columns have a fixed width and the order is a time and a unique id, each of them is folded by one
    number of the two, which hashes; else the row is folded as a whole, which sorts.
    """
    payload = [c for c in df.columns if c not in keys]
    kinds = [df.schema[c].dataType for c in (*payload, *order)]
    timed = len(order) == 2 and isinstance(df.schema[order[0]].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    if timed and isinstance(df.schema[order[1]].dataType, T.IntegralType) and all(isinstance(k, FIXED) for k in kinds):
        at = moment(*order)
        return df.groupBy(*keys).agg(*[F.max_by(c, at).alias(c) for c in payload]).select(*df.columns)
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return best.select(*keys, "_row.*").select(*df.columns)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key, with their one-based rank.

    Spark cuts every map task's share of a group to ``k`` rows before the shuffle, so a group of
    any size arrives small. It does so up to a threshold of ``k``, which ``build_session`` sets.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def page_per_group(df: DataFrame, keys: list[str], order: list[Column], limit: int, offset: int, cap: int) -> DataFrame:
    """Rows ``offset`` .. ``offset + min(limit, cap)`` of every group."""
    stop = offset + min(limit, cap)
    return top_per_group(df, keys, order, stop).where(F.col("rank") > offset)
