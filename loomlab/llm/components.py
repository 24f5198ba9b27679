"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlab.llm.common import stored


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node that has a link; ``root`` is the smallest node of its component.

    ``links`` has two long columns ``u`` and ``v``. A large star ties every larger neighbor of a node to the
    smallest node around it, a small star does so for the smaller ones; at rest each component is one star. Both are a
    hash aggregate for the minimum and an equi-join, so a node with very many links is pre-aggregated and its join
    partition can be split. The links of a round are written to the shared folder. Loops and repeated links are
    allowed, rows with a null end say nothing; without links the result is empty.
    """
    pairs = stored(
        links.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    state = _state(pairs)
    while state[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = stored(small, "links")
        before, state = state, _state(pairs)
        if before == state:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
