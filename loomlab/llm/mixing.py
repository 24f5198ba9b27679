"""Mixing sources to target weights by a low-discrepancy schedule over blocks of equally many words.

Each source is a stream: its documents in shuffled order, passed through up to ``passes`` times and cut into blocks of
``block`` words. A schedule of slots decides which source gives the next block: the slot's golden-ratio point falls into
the interval that the source has in the cumulative target shares. The k-th slot of a source takes its k-th block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlab.llm.common import fresh, stored, words_of

#: Points are whole numbers below 2**40; golden ratio times 2**40, rounded to an odd number.
BITS = 40
GOLDEN = 679_535_556_991
#: The unit interval is cut into so many cells, so that points meet the sources' intervals in an equi-join.
CELL_BITS = 12
#: Slots and shuffled documents are numbered in chunks: a window sorts one chunk, prefix sums over chunks do the rest.
SLOT_CHUNK = 1 << 16


def point(slot: Column) -> Column:
    """frac(slot * golden ratio) * 2**40, exactly, for slots below 2**42."""
    one = 1 << BITS
    high, low = F.shiftright(slot, 21), slot.bitwiseAND((1 << 21) - 1)
    return (high * F.lit((GOLDEN << 21) % one) % one + low * F.lit(GOLDEN) % one) % one


def shares(sizes: DataFrame, weights: list[float], passes: int) -> DataFrame:
    """One row per source: its number, size, target and interval of points, from rows of (source, size).

    Sources by code point, null last, have the weights in turn. The targets share the sum of all sizes by weight; a
    target stops at ``passes`` times its source's size, and what is over is shared again by weight. In ascending order
    of limit over weight the stopped sources come first, so the level is a ratio of running sums. One row per source is
    all that the windows without a partition see.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(order) - 1
    per = per.withColumn("number", number)
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(table, F.col("number") % len(weights) + 1))
    per = per.withColumn("limit", passes * F.col("source_size"))
    steps = Window.orderBy(F.col("limit") / F.col("weight"), "number")
    before = steps.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything)
    per = per.withColumn("total", total).withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0)))
    per = per.withColumn("open", F.sum("weight").over(steps.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
    # the level of the first source that it does not stop; all later ones have it too
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "number", "level"))).over(everything)
    per = per.withColumn("target", F.least(F.col("limit").cast("double"), F.col("weight") * F.coalesce(first["level"], F.lit(0.0))))
    reach = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("target").over(everything)
    per = per.withColumn("high", F.when(whole > 0, F.floor(reach / whole * (1 << BITS))).otherwise(0))
    last = F.max(F.when(F.col("target") > 0, F.col("number"))).over(everything)
    per = per.withColumn("high", F.when(F.col("number") >= last, F.lit(1 << BITS)).otherwise(F.col("high")))
    per = per.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0)))
    return per.select("source", "number", "source_size", "weight", "limit", "target", "low", "high", "total")


def numbered(rows: DataFrame, key: str, chunk: str, amount: Column, order: list) -> DataFrame:
    """Adds ``before``: the running sum of ``amount`` within ``key``, in order of chunk and then ``order``."""
    part = rows.withColumn("amount", amount)
    sums = part.groupBy(key, chunk).agg(F.sum("amount").alias("amount"))
    ahead = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, chunk, F.coalesce(F.sum("amount").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("inside", F.coalesce(F.sum("amount").over(inside), F.lit(0)))
    return part.join(sums, [key, chunk]).withColumn("before", F.col("ahead") + F.col("inside")).drop("ahead", "inside", "amount")


def schedule(per: DataFrame, block: int) -> DataFrame:
    """(slot, number, rank): which source gives each slot, and the slot's rank among those of its source."""
    total = (per.agg(F.max("total")).first()[0]) or 0
    slots = per.sparkSession.range(-(-total // block)).select(F.col("id").alias("slot"), point(F.col("id") + 1).alias("point"))
    slots = slots.withColumn("cell", F.shiftright("point", BITS - CELL_BITS))
    spans = per.where(F.col("low") < F.col("high")).select("number", "low", "high").withColumn(
        "cell", F.explode(F.sequence(F.shiftright("low", BITS - CELL_BITS), F.shiftright(F.col("high") - 1, BITS - CELL_BITS)))
    )
    slots = slots.join(spans, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    slots = slots.select("slot", "number", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    return numbered(slots, "number", "chunk", F.lit(1).cast("long"), ["slot"]).select("slot", "number", F.col("before").alias("rank"))


def mix(rows: DataFrame, weights: list[float] = (1, 2, 3), passes: int = 3, block: int = 64, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(sources, pieces) of the mix of rows (row, doc_id, source, size).

    A piece is what one slot takes of one document: slot, row, pass, the first word's place in the document, words. A
    source stops at its target, and no document gives more than ``passes`` times its size.
    """
    per = stored(shares(rows, list(weights), passes), "sources")
    slots = schedule(per, block)
    numbers = per.select(F.col("source").alias("of"), "number", "source_size", "target")
    docs = rows.join(numbers, rows["source"].eqNullSafe(F.col("of"))).where((F.col("size") > 0) & (F.col("target") > 0))
    docs = docs.withColumn("draw", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")))
    docs = docs.withColumn("chunk", F.substring("draw", 1, 4))
    docs = numbered(docs, "number", "chunk", F.col("size"), ["draw", "doc_id", "size", "row"])
    stop = F.floor("target")
    passed = F.explode(F.sequence(F.lit(0), F.floor((stop - 1) / F.col("source_size")).cast("int")))
    docs = docs.where(stop > 0).withColumn("stop", stop).withColumn("pass", passed)
    docs = docs.withColumn("begin", F.col("pass") * F.col("source_size") + F.col("before"))
    docs = docs.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("stop"))).where(F.col("begin") < F.col("end"))
    docs = docs.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))))
    left, right = F.greatest("begin", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    docs = docs.select("row", "doc_id", "number", "rank", "pass", (left - F.col("begin")).alias("first_word"), (right - left).alias("words"))
    return per, slots.join(docs, ["number", "rank"]).drop("rank")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row, doc_id, source, size) of each document, stored, so that the rows' numbers stay as they are."""
    return stored(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"),
            F.col(f"`{source}`").cast("string").alias("source"), F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("size"),
        ),
        "sizes",
    )


def taken(rows: DataFrame, **how) -> DataFrame:
    """``rows`` of :func:`sized` with their source's size and target and the words that the mix takes of each.

    Null and blank texts have size zero and give nothing. A null source is a source of its own, after the others. A
    null id is shuffled like the empty string; repeated rows are documents of their own. Where every size is zero all
    targets are zero. An empty table gives no rows.
    """
    per, pieces = mix(rows, **how)
    got = pieces.groupBy("row").agg(F.sum("words").alias("taken"))
    numbers = per.select(F.col("source").alias("of"), "source_size", "target")
    out = rows.join(numbers, rows["source"].eqNullSafe(F.col("of"))).drop("of").join(got, "row", "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` as the mix has them: each row as many times as the mix takes its words, to the nearest whole.

    Rows are told apart by id, source and size; rows that are equal in these share what they are taken together evenly
    enough (their mean). Columns are those of ``docs``.
    """
    rows = sized(docs, doc_id, text, source)
    counts = taken(rows, **how).where(F.col("taken") > 0)
    names = fresh(docs.columns, "mix_id", "mix_source", "mix_size", "mix_times", "mix_pass")
    key = ("doc_id", "source", "size")
    times = counts.groupBy(*key).agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("n")).where(F.col("n") > 0)
    times = times.select(*[F.col(c).alias(n) for c, n in zip((*key, "n"), names)])
    sized_docs = docs.withColumn(names[4], F.size(words_of(F.col(f"`{text}`"))).cast("long"))
    match = [
        F.col(f"`{doc_id}`").eqNullSafe(F.col(names[0])), F.col(f"`{source}`").eqNullSafe(F.col(names[1])), F.col(names[4]) == F.col(names[2]),
    ]
    out = sized_docs.join(times, reduce(lambda a, b: a & b, match))
    again = F.explode(F.array_repeat(F.lit(1), F.col(names[3])))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], again.alias(names[4])).drop(names[4])
