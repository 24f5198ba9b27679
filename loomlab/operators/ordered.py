"""Ordered (window-like) operators that never put one whole group into one task.

A plain ``Window.partitionBy(group)`` sorts a group in a single task, which fails when one
group holds a third of a 100 TB table. The operators here need a unique integer order key.
They cut every group into chunks of consecutive keys that hold about ``ROWS`` rows. Where the keys lie is measured
first, by a quantile sketch of the key alone: its ``PIECES`` quantiles cut the keys into pieces of equally many rows,
pieces with few rows are joined, and pieces with many are cut by the density of their own keys. So keys that bunch up,
or lie far apart, make even chunks too. One window runs inside the
chunks; a second, ``ROWS`` times smaller one runs over one summary row per chunk and yields what the
earlier chunks contribute. Both frames meet in an equi join on (group, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 65_536
PIECES = 1024

AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


def literal(numbers: list, kind: str) -> Column:
    """An array of numbers as one constant."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")


def chunk_edges(keys: DataFrame, order: str, rows: int = ROWS) -> list[tuple[int, int]]:
    """(first key, width) of each piece in order: a chunk of a piece spans ``width`` keys. One scan of the key column.

    The driver holds at most ``PIECES`` pairs.
    """
    key = F.col(order).cast("long")
    marks = literal([i / PIECES for i in range(PIECES + 1)], "double")
    row = keys.agg(F.count(key).alias("n"), F.kll_sketch_agg_bigint(key, F.lit(8192)).alias("sketch"))
    row = row.select("n", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("sketch", marks)).alias("at")).first()
    if not row["n"]:
        return []
    share, at = row["n"] / PIECES, row["at"]
    joined = max(1, round(rows / share))  # pieces of one chunk
    cuts = sorted({*at[:-1:joined]})
    if joined > 1:
        return [(a, 1 << 62) for a in cuts]
    return [(a, min(max(1, -(-(b - a) * rows // max(1, int(share)))), 1 << 62)) for a, b in zip(cuts, [*cuts[1:], at[-1] + 1])]


def chunk_of(order: str, edges: list[tuple[int, int]]) -> Column:
    """The chunk number of a key, growing with the key: a binary search in the edges, then steps of the piece's width."""
    key = F.col(order).cast("long")
    starts, widths = literal([a for a, _ in edges] or [0], "bigint"), literal([w for _, w in edges] or [1 << 62], "bigint")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((len(edges) - 1).bit_length() if edges else 0))] or [F.lit(len(edges))])
    further = lambda at, step: (at + step < len(edges)) & (key >= F.get(starts, at + step))
    piece = F.aggregate(steps, F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))
    if all(w == 1 << 62 for _, w in edges):  # each piece is a chunk
        return piece.cast("long")
    chunk = lambda at: at.cast("long") * (1 << 40) + F.call_function("div", key, F.get(widths, at)) - F.call_function("div", F.get(starts, at), F.get(widths, at))
    return F.transform(F.array(piece), chunk)[0]


def chunked_group(group: list[str]) -> Column:
    return (F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)]) if group else F.lit(0)).alias("_group")


def _chunked(df: DataFrame, group: list[str], order: str, width: int | None, measure: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """Add the chunk number and the group as one struct; without ``width`` the chunks are measured.

    A struct is never null and equal structs may hold nulls, so null groups join like others.
    Windows and join share this key, so the rows are shuffled once.
    """
    if width is None:
        chunk = chunk_of(order, chunk_edges(df if measure is None else measure, order, rows))
    else:
        chunk = F.call_function("div", F.col(order), F.lit(width).cast("long"))
    return df.withColumns({"_group": chunked_group(group), "_chunk": chunk})


def running(
    df: DataFrame, group: list[str], order: str, aggs: dict[str, tuple[str, Column]],
    width: int | None = None, measure: DataFrame | None = None, rows: int = ROWS,
) -> DataFrame:
    """Add running aggregates over all rows of the group up to and including the current one.

    ``aggs`` maps a new column to (kind, value), kind one of count, sum, min, max, previous (the
    value of the row before, null for the first) or total (the count over the whole group). Null
    values are ignored as SQL aggregates do; struct values compare field by field. Chunks have about ``rows`` rows, or
    ``width`` keys if given; ``measure`` is a cheaper frame whose keys lie as those of ``df`` do.

    Of what came before a chunk, "previous" carries the last *key* only; the values of those few rows are fetched by a
    join, so wide values take no part in an aggregate.
    """
    inner_order = Window.partitionBy("_group", "_chunk").orderBy(order)
    outer_order = Window.partitionBy("_group").orderBy("_chunk")
    inner = inner_order.rowsBetween(Window.unboundedPreceding, 0)
    outer = outer_order.rowsBetween(Window.unboundedPreceding, -1)
    chunked = _chunked(df, group, order, width, measure, rows)
    summaries, carried, here, merged, fetched = [], [], [], [], {}
    for name, (kind, value) in aggs.items():
        total, carry, own = f"_s_{name}", F.col(f"_c_{name}"), F.col(f"_i_{name}")
        if kind == "previous":
            boxed = F.struct(value.alias("v"))
            fetched[f"_c_{name}"] = boxed
            here.append(F.lag(boxed).over(inner_order).alias(f"_i_{name}"))
            merged.append(F.coalesce(own, carry)["v"].alias(name))
            continue
        if kind == "total":
            summaries.append(F.count(value).alias(total))
            carried.append(F.sum(total).over(Window.partitionBy("_group")).alias(f"_c_{name}"))
            merged.append(carry.alias(name))
            continue
        combine = F.sum if kind == "count" else AGGREGATES[kind]
        summaries.append(AGGREGATES[kind](value).alias(total))
        carried.append(combine(total).over(outer).alias(f"_c_{name}"))
        here.append(AGGREGATES[kind](value).over(inner).alias(f"_i_{name}"))
        if kind in ("count", "sum"):
            added = F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(own + carry)
            merged.append(added.alias(name))
        else:
            merged.append((F.least if kind == "min" else F.greatest)(own, carry).alias(name))
    keys = ["_group", "_chunk"]
    if fetched:
        summaries.append(F.max(order).alias("_last"))
        carried.append(F.lag("_last").over(outer_order).alias("_before"))
    carry_rows = chunked.groupBy(*keys).agg(*summaries).select(*keys, *carried)
    if fetched:
        edge = df.select(chunked_group(group), F.col(order).alias("_before"), *[v.alias(c) for c, v in fetched.items()])
        edge = edge.join(carry_rows.select(*keys, "_before").where(F.col("_before").isNotNull()), ["_group", "_before"])
        carry_rows = carry_rows.drop("_before").join(edge.drop("_before"), keys, "left")
    joined = chunked.select("*", *here).join(carry_rows, keys)
    return joined.select(*df.columns, *merged)


def position(df: DataFrame, group: list[str], order: str, name: str = "position", width: int | None = None, measure: DataFrame | None = None) -> DataFrame:
    """Add the zero-based position of the row in its group."""
    numbered = running(df, group, order, {name: ("count", F.lit(1))}, width, measure)
    return numbered.withColumn(name, F.col(name) - 1)


def global_index(df: DataFrame, order: str, name: str = "index", width: int | None = None) -> DataFrame:
    """Add the zero-based rank of the row in the order of a unique integer key.

    The only unpartitioned window runs over one row per chunk.
    """
    return position(df, [], order, name, width)
