"""Feature profiling and transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlab.functions.transforms import Feature, apply_features, categories, log_scale, min_max_scale, one_hot, standard_scale
from loomlab.operators import profile
from loomlab.plans.registry import query
from loomlab.tables import Lab

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def measured(lab: Lab):
    """Line items with the zero discounts taken as missing."""
    return lab.raw("lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))


MEASURED = "measured AS (SELECT * REPLACE (nullif(l_discount, 0) AS l_discount) FROM lineitem)"


def _profile_sql() -> str:
    types = {"l_linenumber": "int"}
    parts = [
        f"""SELECT '{c}' AS feature, 'numerical' AS kind, '{types.get(c, "double")}' AS dtype, count(*) AS n,
        round(1 - count({c}) / count(*), 4) AS null_rate, round(avg({c}), 4) AS mean,
        round(stddev_samp({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min,
        round(CAST(max({c}) AS DOUBLE), 4) AS max FROM measured"""
        for c in NUMERIC
    ]
    parts.append(
        """SELECT 'l_returnflag', 'categorical', 'string', count(*), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
        CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM measured"""
    )
    return f"WITH {MEASURED} " + " UNION ALL ".join(parts)


def rounded(df, digits: int):
    """Doubles to so many digits, so that both engines print the same."""
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def with_nan(df, columns, key: str):
    """Every 97th row has NaN and every 89th a null in the given columns."""
    holes = lambda c: F.when(F.col(key) % 97 == 0, float("nan")).when(F.col(key) % 89 != 0, F.col(c).cast("double"))
    return df.withColumns({c: holes(c) for c in columns})


SOUND = "{k} % 97 <> 0 AND {k} % 89 <> 0"


@query("feature_profile", _profile_sql())
def feature_profile(lab: Lab):
    return rounded(profile.feature_profile(measured(lab), [*NUMERIC, "l_returnflag"]), 4)


@query(
    "describe",
    f"WITH {MEASURED} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
        round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1,
        round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3,
        round(CAST(max({c}) AS DOUBLE), 4) AS max FROM measured"""
        for c in NUMERIC
    ),
)
def describe(lab: Lab):
    return rounded(profile.describe(measured(lab), NUMERIC), 4)


@query(
    "dropna_subset",
    f"WITH {MEASURED} SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM measured WHERE l_discount IS NOT NULL",
)
def dropna_subset(lab: Lab):
    rows = measured(lab).select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return profile.drop_missing(rows, ["l_discount", "l_tax"])


@query(
    "numeric_columns",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax
    FROM lineitem""",
)
def numeric_columns(lab: Lab):
    rows = lab.raw("lineitem")
    return rows.select(*profile.numeric_columns(rows))


@query(
    "histogram15",
    f"""WITH e AS (SELECT * FROM events WHERE {SOUND.format(k="event_id")}), span AS (SELECT min(value) AS lo, (max(value) - min(value)) / 15 AS w FROM e),
    counts AS (SELECT least(CAST(floor((value - lo) / w) AS BIGINT), 14) AS bin, count(*) AS n FROM e, span GROUP BY 1)
    SELECT r.bin, round(lo + r.bin * w, 1) AS edge, coalesce(n, 0) AS n
    FROM (SELECT range AS bin FROM range(15)) r LEFT JOIN counts USING (bin), span""",
)
def histogram15(lab: Lab):
    return rounded(profile.histogram(with_nan(lab.raw("events"), ["value"], "event_id"), "value", 15), 1)


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM lineitem WHERE {SOUND.format(k='l_orderkey')}"
        for i, a in enumerate(NUMERIC)
        for b in NUMERIC[i:]
    ),
)
def corr_matrix(lab: Lab):
    return rounded(profile.correlations(with_nan(lab.raw("lineitem"), NUMERIC, "l_orderkey"), NUMERIC), 6)


@query(
    "density_grid",
    f"""WITH l AS (SELECT * FROM lineitem WHERE {SOUND.format(k="l_orderkey")}),
    span AS (SELECT min(l_quantity) x0, max(l_quantity) x1, min(l_extendedprice) y0, max(l_extendedprice) y1 FROM l),
    grid AS (SELECT least(CAST(floor((l_quantity - x0) / (x1 - x0) * 40) AS BIGINT), 39) AS ix,
                    least(CAST(floor((l_extendedprice - y0) / (y1 - y0) * 30) AS BIGINT), 29) AS iy, count(*) AS n
             FROM l, span GROUP BY 1, 2)
    SELECT ix, iy, n, round(n / max(n) OVER (), 6) AS intensity FROM grid""",
)
def density_grid(lab: Lab):
    rows = with_nan(lab.raw("lineitem"), ["l_quantity", "l_extendedprice"], "l_orderkey")
    return rounded(profile.density_grid(rows, "l_quantity", "l_extendedprice", 40, 30), 6)


@query(
    "standard_scaler",
    """WITH s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS d FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 4) AS l_quantity FROM lineitem, s""",
)
def standard_scaler(lab: Lab):
    rows = lab.raw("lineitem")
    stats = profile.column_stats(rows, ["l_quantity"])["l_quantity"]
    return rows.select("l_orderkey", "l_linenumber", F.round(standard_scale(F.col("l_quantity"), stats), 4).alias("l_quantity"))


@query(
    "min_max_scaler",
    """WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT l_orderkey, l_linenumber, round((l_extendedprice - lo) / (hi - lo), 6) AS l_extendedprice FROM lineitem, s""",
)
def min_max_scaler(lab: Lab):
    rows = lab.raw("lineitem")
    stats = profile.column_stats(rows, ["l_extendedprice"])["l_extendedprice"]
    scaled = min_max_scale(F.col("l_extendedprice"), stats)
    return rows.select("l_orderkey", "l_linenumber", F.round(scaled, 6).alias("l_extendedprice"))


@query(
    "log_transform",
    """SELECT c_custkey, round(CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END, 6) AS c_acctbal FROM customer""",
)
def log_transform(lab: Lab):
    return lab.raw("customer").select("c_custkey", F.round(log_scale(F.col("c_acctbal")), 6).alias("c_acctbal"))


PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


@query(
    "one_hot",
    "SELECT p_partkey, p_size, "
    + ", ".join(f"p_type = '{t}' AND p_size > 5 AS p_type_{t}" for t in PART_TYPES)
    + " FROM part",
)
def one_hot_types(lab: Lab):
    """The types of small parts are taken as missing, so their flags are all false."""
    rows = lab.raw("part").withColumn("p_type", F.when(F.col("p_size") > 5, F.col("p_type")))
    return rows.select("p_partkey", "p_size", *one_hot("p_type", categories(rows, "p_type")))


@query(
    "apply_feature_group",
    f"""WITH {MEASURED}, s AS (
      SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS d, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM measured)
    SELECT l_orderkey, l_linenumber, round((l_quantity - m) / d, 4) AS l_quantity,
           round((l_extendedprice - lo) / (hi - lo), 4) AS l_extendedprice, round(ln(1 + l_discount), 4) AS l_discount, l_tax,
           l_returnflag = 'A' AS l_returnflag_A, l_returnflag = 'N' AS l_returnflag_N, l_returnflag = 'R' AS l_returnflag_R
    FROM measured, s""",
)
def apply_feature_group(lab: Lab):
    rows = measured(lab).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    stats = profile.column_stats(rows, ["l_quantity", "l_extendedprice"])
    group = [
        Feature("l_quantity", "standard_scaler", stats["l_quantity"]),
        Feature("l_extendedprice", "min_max_scaler", stats["l_extendedprice"]),
        Feature("l_discount", "log_transform"),
        Feature("l_tax"),
        Feature("l_returnflag", "one_hot", categories=tuple(categories(rows, "l_returnflag"))),
        Feature("not_in_this_frame", "standard_scaler"),
    ]
    out = apply_features(rows, group)
    floats = ("l_quantity", "l_extendedprice", "l_discount")
    return out.withColumns({c: F.round(c, 4) for c in floats})
