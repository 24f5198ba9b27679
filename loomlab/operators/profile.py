"""Column profiles and small summaries of big frames, each from one aggregating scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlab.session import materialize

QUARTILES = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns, in frame order."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing, as a data-frame user expects."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(F.col(name), F.lit(None).cast("double"))
    return F.col(name)


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows with a value (neither null nor NaN) in every listed column."""
    return df.na.drop(subset=subset)


def to_long(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def feature_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Kind, type, null rate, mean, sample deviation, min and max per column; one scan for all."""
    columns = columns or numeric_columns(df)
    numeric = set(numeric_columns(df))
    aggs, rows = [F.count(F.lit(1)).alias("_n")], []
    for c in columns:
        x = clean(df, c)
        if c in numeric:
            x = x.cast("double")
            for stat, fn in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                aggs.append(fn(x).alias(f"{c}:{stat}"))
            aggs.append(F.count(x).alias(f"{c}:seen"))
        absent = F.lit(None).cast("double")
        stats = [
            (F.col(f"`{c}:{s}`") if c in numeric else absent).alias(s)
            for s in ("mean", "std", "min", "max")
        ]
        null_rate = 1 - F.try_divide(F.col(f"`{c}:seen`"), F.col("_n")) if c in numeric else absent
        rows.append(
            F.struct(
                F.lit(c).alias("feature"),
                F.lit("numerical" if c in numeric else "categorical").alias("kind"),
                F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                F.col("_n").alias("n"),
                null_rate.alias("null_rate"),
                *stats,
            )
        )
    return to_long(df.agg(*aggs), rows)


@dataclass(frozen=True)
class Stats:
    mean: float | None
    std: float | None
    min: float | None
    max: float | None


def column_stats(df: DataFrame, columns: list[str]) -> dict[str, Stats]:
    """Stored statistics for transforms: one aggregate row brought to the driver."""
    aggs = []
    for c in columns:
        x = clean(df, c).cast("double")
        aggs += [F.avg(x).alias(f"{c}:mean"), F.stddev_samp(x).alias(f"{c}:std"), F.min(x).alias(f"{c}:min"), F.max(x).alias(f"{c}:max")]
    row = df.agg(*aggs).first()
    return {c: Stats(*[row[f"{c}:{s}"] for s in ("mean", "std", "min", "max")]) for c in columns}


def histogram(df: DataFrame, column: str, bins: int = 15, weight: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max]; the last one is closed, empty ones are kept. NaN counts as missing.

    A row counts as often as its ``weight`` says, so tables of distinct values with counts will do.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    df = df.select(clean(df, column).alias(column), times.alias("_times"))
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    lo = span.select("lo").scalar()
    width = span.select(F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) / bins).scalar()
    slot = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).cast("long")
    counts = df.where(F.col(column).isNotNull()).groupBy(slot.alias("bin")).agg(F.sum("_times").alias("n"))
    axis = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return axis.join(counts, "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("edge"), F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every unordered pair, the diagonal included, in one aggregate.

    A pair leaves out the rows where either value is null or NaN.
    """
    df = df.select(*[clean(df, c).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}:{b}") for a, b in pairs])
    return to_long(
        one,
        [
            F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"`{a}:{b}`").alias("corr"))
            for a, b in pairs
        ],
    )


def density_grid(df: DataFrame, x: str, y: str, nx: int, ny: int) -> DataFrame:
    """Point counts on an nx × ny grid with the share of the fullest cell; at most nx·ny rows."""
    df = df.select(clean(df, x).alias(x), clean(df, y).alias(y))
    present = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    span = present.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))

    def cell(col: str, lo: str, hi: str, n: int) -> Column:
        low, reach = span.select(lo).scalar(), span.select(F.col(hi) - F.col(lo)).scalar()
        scaled = F.coalesce(F.try_divide(F.col(col) - low, reach), F.lit(0.0))
        return F.least(F.floor(scaled * n), F.lit(n - 1)).cast("long")

    grid = present.groupBy(cell(x, "x0", "x1", nx).alias("ix"), cell(y, "y0", "y1", ny).alias("iy")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return grid.withColumn("intensity", F.col("n") / F.max("n").over(Window.partitionBy()))


# exact quantiles ---------------------------------------------------------------------------


def moments(df: DataFrame, columns: list[str], sketch: int | None = None) -> dict[str, dict]:
    """n, mean, std, min, max and, if asked for, a quantile sketch per column: one scan, one row on the driver."""
    aggs = []
    for c in columns:
        x = clean(df, c).cast("double")
        aggs += [F.count(x).alias(f"{c}:n"), F.avg(x).alias(f"{c}:mean"), F.stddev_samp(x).alias(f"{c}:std"), F.min(x).alias(f"{c}:min"), F.max(x).alias(f"{c}:max")]
        if sketch:
            aggs.append(F.kll_sketch_agg_double(x, F.lit(sketch)).alias(f"{c}:sketch"))
    row = df.agg(*aggs).first().asDict()
    return {c: {k: row.get(f"{c}:{k}") for k in ("n", "mean", "std", "min", "max", "sketch")} for c in columns}


def sketch_values(spark, sketches: list[tuple[bytes, list[float]]]) -> list[list[float]]:
    """The values of each sketch at its ranks (shares of all rows)."""
    ranks = lambda r: F.split(F.lit(",".join(map(repr, r))), ",").cast("array<double>")
    one = spark.createDataFrame([tuple(bytearray(s) for s, _ in sketches)], ", ".join(f"s{i} binary" for i in range(len(sketches))))
    row = one.select(*[F.kll_sketch_get_quantile_double(f"s{i}", ranks(r)).alias(f"q{i}") for i, (_, r) in enumerate(sketches)]).first()
    return [list(q) for q in row]


def exact_quantiles(df: DataFrame, columns: list[str], probs=QUARTILES, accuracy: int = 4096, found: dict[str, dict] | None = None) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles in three scans, whatever the number of rows.

    Spark's ``percentile`` keeps every distinct value in one buffer. Here the first scan makes a mergeable sketch per
    column (``found`` has it, if :func:`moments` was asked before), whose values a little to either side bracket each
    quantile. The second counts exactly the rows below and inside each bracket, so a bracket that misses its ranks is
    seen and widened. The third writes the values inside the brackets, counted; the rest is done on that table. It is
    cut into ``SLICES`` slices per bracket, and only the slices that hold the wanted ranks are sorted. The driver holds
    the sketches and two bounds per quantile.
    """
    x = {c: clean(df, c).cast("double") for c in columns}
    found = found or moments(df, columns, accuracy)
    targets = {}
    for c in columns:
        for p in probs:
            if n := found[c]["n"]:
                rank = p * (n - 1)
                targets[c, p] = (int(rank), min(int(rank) + 1, n - 1), rank - int(rank))
    bounds, below, slack, left = {}, {}, 8 / accuracy, list(targets)
    while left:  # once, unless a sketch is further off than it is meant to be
        by_column = {c: [k for k in left if k[0] == c] for c in columns}
        asked = [(c, ks) for c, ks in by_column.items() if ks]
        ranks = [[r for k in ks for r in (max(0.0, targets[k][0] / found[c]["n"] - slack), min(1.0, (targets[k][1] + 1) / found[c]["n"] + slack))] for c, ks in asked]
        values = sketch_values(df.sparkSession, [(found[c]["sketch"], r) for (c, _), r in zip(asked, ranks)])
        bounds |= {k: (v[2 * i], v[2 * i + 1]) for (_, ks), v in zip(asked, values) for i, k in enumerate(ks)}
        aggs = []
        for i, k in enumerate(left):
            lo, hi = bounds[k]
            aggs += [F.count_if(x[k[0]] < lo).alias(f"l{i}"), F.count_if((x[k[0]] >= lo) & (x[k[0]] <= hi)).alias(f"n{i}")]
        row = df.agg(*aggs).first()
        below |= {k: row[f"l{i}"] for i, k in enumerate(left)}
        left = [k for i, k in enumerate(left) if not (row[f"l{i}"] <= targets[k][0] and targets[k][1] < row[f"l{i}"] + row[f"n{i}"])]
        slack *= 8
    out = {k: bounds[k][0] for k in targets if bounds[k][0] == bounds[k][1]}
    counted = [k for k in targets if k not in out]
    if counted:
        out |= _values_at_ranks(df, {k: (x[k[0]], *bounds[k]) for k in counted}, {k: (targets[k][0] - below[k], targets[k][1] - below[k], targets[k][2]) for k in counted})
    return {c: [out.get((c, p)) for p in probs] for c in columns}


#: Slices of a bracket.
SLICES = 1024


def _values_at_ranks(df: DataFrame, brackets: dict, targets: dict) -> dict:
    """Interpolated values at known ranks among the values of each bracket (column, lowest, highest)."""
    keys = list(brackets)
    inside = [(i, x, lo, hi) for i, (x, lo, hi) in enumerate(brackets.values())]
    entries = F.array(*[F.when((x >= lo) & (x <= hi), F.struct(F.lit(i).alias("k"), x.alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))) for i, x, lo, hi in inside])
    rows = df.select(F.explode(F.array_compact(entries)).alias("r")).select("r.*")
    share = (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    rows = rows.groupBy("k", "v", F.least(F.floor(F.nanvl(share, F.lit(0.0)) * SLICES), F.lit(SLICES)).alias("slice")).agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(df.sparkSession, rows, "brackets")
    ranks = F.create_map(*[z for i, k in enumerate(keys) for z in (F.lit(i), F.array(F.lit(targets[k][0]), F.lit(targets[k][1])).cast("array<bigint>"))])
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("slice"))
    slices = rows.groupBy("k", "slice").agg(F.sum("n").alias("n")).withColumn("ahead", upto - F.col("n"))
    slices = slices.select("k", "slice", "ahead", "n", F.explode(ranks[F.col("k")]).alias("rank")).where((F.col("ahead") <= F.col("rank")) & (F.col("rank") < F.col("ahead") + F.col("n")))
    within = F.sum("n").over(Window.partitionBy("k", "slice", "rank").orderBy("v"))
    near = rows.join(slices.drop("n"), ["k", "slice"]).withColumn("upto", F.col("ahead") + within).where(F.col("upto") > F.col("rank"))
    at = {(r["k"], r["rank"]): r["v"] for r in near.groupBy("k", "rank").agg(F.min("v").alias("v")).collect()}
    out = {}
    for i, k in enumerate(keys):
        a, b, part = at[i, targets[k][0]], at[i, targets[k][1]], targets[k][2]
        out[k] = a + (b - a) * part if a != b else a
    return out


def describe(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """count, mean, std, min, quartiles and max per column: three scans, or one with sketch quartiles if not ``exact``."""
    found = moments(df, columns, 4096)
    quartiles = {c: [None] * len(QUARTILES) for c in columns}
    if exact:
        quartiles = exact_quantiles(df, columns, found=found)
    elif seen := [c for c in columns if found[c]["n"]]:
        quartiles |= dict(zip(seen, sketch_values(df.sparkSession, [(found[c]["sketch"], list(QUARTILES)) for c in seen])))
    rows = [(c, *[found[c][s] for s in ("n", "mean", "std", "min")], *quartiles[c], found[c]["max"]) for c in columns]
    return df.sparkSession.createDataFrame(rows, "feature string, n long, mean double, std double, min double, q1 double, median double, q3 double, max double")


# a histogram that grows with its range ---------------------------------------------------------


def _exponent(low: Column, high: Column, bins: int, finest: int) -> Column:
    """The least power of two at whose grid the values from ``low`` to ``high`` take at most ``bins`` bins."""

    def fits(e: Column) -> Column:
        width = F.pow(F.lit(2.0), e.cast("double"))
        countable = F.greatest(F.abs(low), F.abs(high)) / width < float(1 << 53)
        return countable & (F.floor(high / width) - F.floor(low / width) < bins)

    return F.get(F.filter(F.sequence(F.lit(finest), F.lit(1023)), fits), F.lit(0))


def doubling_counts(df: DataFrame, column: str, bins: int = 64, finest: int = -20) -> DataFrame:
    """(exponent, bin, n, low, high) of at most ``bins`` bins ``2 ** exponent`` wide, which lie on multiples of it.

    Null, NaN and infinite values are left out. :func:`merged_counts` joins such tables of any ranges exactly.
    """
    x = clean(df, column).cast("double")
    rows = df.select(x.alias("v")).where(F.abs("v") < float("inf"))
    one = rows.agg(F.min("v").alias("low"), F.max("v").alias("high")).select(_exponent(F.col("low"), F.col("high"), bins, finest).alias("e"))
    rows = rows.withColumn("exponent", one.scalar())
    place = F.floor(F.col("v") / F.pow(F.lit(2.0), F.col("exponent").cast("double")))
    return rows.groupBy("exponent", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


def merged_counts(parts: DataFrame, bins: int = 64, finest: int = -20) -> DataFrame:
    """Tables of :func:`doubling_counts` as one: bins double in width until the whole range takes at most ``bins``."""
    one = parts.agg(F.min("low").alias("low"), F.max("high").alias("high")).select(_exponent(F.col("low"), F.col("high"), bins, finest).alias("e"))
    rows = parts.withColumn("to", one.scalar())
    wider = F.call_function("shiftright", F.col("bin"), F.least(F.col("to") - F.col("exponent"), F.lit(63)))
    return rows.groupBy(F.col("to").alias("exponent"), wider.alias("bin")).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
