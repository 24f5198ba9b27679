"""Quality rules: text statistics, and multivariate outliers among them by robust location and scatter.

For each language and source the minimum covariance determinant is approached by concentration steps: the rows nearest
to the current centre, by Mahalanobis distance, give the next mean and covariance. A document far from its group's
centre is rejected; a group too small for a centre of its own is judged by its language's, or by that of all rows.
Everything is column expressions and aggregates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlab.llm.common import stored, words_of

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Transformed statistics, and the least standard deviation each is given: ratios are zero in most documents.
FEATURES = {"log_words": 0.25, "log_word_length": 0.05, "symbol_share": 0.5, "dup_line_share": 0.5, "repeat_share": 0.5}
#: Share of a group that the concentration steps hold on to, number of steps, smallest group with a centre of its own.
CORE, STEPS, MIN_ROWS = 0.75, 4, 50
#: A document is rejected beyond this quantile of the chi-squared distribution.
QUANTILE = 0.99999
#: Windows are sorted as the upper 40 bits of their hash with their place in the lower 24.
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.transform(F.array(value), fn)[0]


def _covered(places: Column) -> Column:
    """Words in the three-word windows that begin at these ascending places."""
    start = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    walk = F.aggregate(places, start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")))
    return walk["n"]


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that the text has twice or more, the first one included; in n log n steps.

    Equal windows stand next to each other among the sorted hashes. Where two different hashes share their upper bits, or
    a text has too many words for the packed form, whole hashes are sorted with their places instead.
    """
    upper = lambda x: F.shiftright(x, PLACE_BITS)

    def of(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(upper(x), PLACE_BITS).bitwiseOR(i.cast("long"))))

        def fast(p: Column) -> Column:
            twins = F.filter(p, lambda x, j: (upper(x) == upper(F.get(p, j - 1))) | (upper(x) == upper(F.get(p, j + 1))))
            return _let(twins, lambda t: F.when(mixed(t), F.lit(None).cast("long")).otherwise(_covered(F.sort_array(F.transform(t, lambda x: x.bitwiseAND(PLACES))))))

        def mixed(t: Column) -> Column:
            at = lambda x: F.get(h, x.bitwiseAND(PLACES).cast("int"))
            rows = F.transform(t, lambda x, j: (upper(x) == upper(F.get(t, j - 1))) & (at(x) != at(F.get(t, j - 1))))
            return F.exists(rows, lambda x: x)

        def exact(p: Column) -> Column:
            twins = F.filter(p, lambda x, j: (x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]))
            return _covered(F.sort_array(F.transform(twins, lambda x: x["i"])))

        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
        quick = F.when(F.size(h) <= PLACES, _let(packed, fast))
        return F.coalesce(quick, _let(pairs, exact))

    def windows(w: Column) -> Column:
        firsts = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
        return _let(F.transform(firsts, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), of)

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(hashes, windows))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, lang, source, the statistics, base_failed) of each row; a null text has no words and no lines."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"),
        _let(words_of(body), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"),
        )).alias("w"),
        F.length(F.regexp_replace(body, "[^" + SYMBOLS + "]+", "")).cast("long").alias("n_symbols"),
        _let(F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""), lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )).alias("l"),
    )
    rows = rows.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def features(rows: DataFrame) -> DataFrame:
    """The transformed statistics, for rows that have words."""
    percent = lambda part, whole: F.log1p(100 * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return rows.withColumns({
        "log_words": F.log1p("n_words"), "log_word_length": F.log(F.greatest(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(1.0))),
        "symbol_share": percent("n_symbols", "word_chars"), "dup_line_share": percent("n_dup_lines", "n_lines"), "repeat_share": percent("n_repeat_words", "n_words"),
    })


def chi2_cdf(x: float, k: int) -> float:
    """Of the chi-squared distribution, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= y / n
        total += term
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a))


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return low


NAMES = list(FEATURES)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _factored(groups: DataFrame, scale: float) -> DataFrame:
    """Adds the Cholesky factor l_i_j of scale * (c_i_j) with each variance at its least value or above."""
    for i, j in PAIRS:
        c = scale * F.col(f"c_{i}_{j}")
        if i == j:
            c = F.greatest(c, F.lit(FEATURES[NAMES[i]] ** 2))
        for k in range(j):
            c = c - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
        groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l_{j}_{j}"))
    return groups


def _near(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` of judged groups with their offset from the centre (z_i) and their squared Mahalanobis distance."""
    keyed = groups.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    out = rows.join(keyed, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))).drop("of_lang", "of_source")
    for i, name in enumerate(NAMES):
        out = out.withColumn(f"z_{i}", F.col(name) - F.col(f"m_{i}"))
    for i in range(len(NAMES)):
        y = F.col(f"z_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
    return out.withColumn("distance", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(NAMES))), F.lit(0.0)))


def scatter(rows: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """Centre (m_i) and Cholesky factor (l_i_j) of each (lang, source) with ``least`` rows or more.

    The start is the medians and the quartiles' spans. Each step counts the distances of a group in logarithmic classes,
    so the nearest ``CORE`` of a group ends at a class's edge and no group is sorted; then it sums up the nearest rows.
    """
    p = len(NAMES)
    sums = [F.percentile_approx(n, [0.25, 0.5, 0.75], 10_000).alias(f"q_{i}") for i, n in enumerate(NAMES)]
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)
    groups = groups.select(
        "lang", "source", *[F.col(f"q_{i}")[1].alias(f"m_{i}") for i in range(p)],
        *[(F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(2.0)) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in PAIRS],
    )
    groups = stored(_factored(groups, 1.0), "scatter")
    scale = CORE / chi2_cdf(chi2_quantile(CORE, p), p + 2)  # what the cut-off tails take from a normal's variance
    for _ in range(STEPS):
        near = _near(rows, groups).withColumn("class", F.floor(16 * F.log(F.col("distance") + 1e-6)))
        held = near.groupBy("lang", "source", "class").agg(
            F.count("*").alias("n"), *[F.sum(f"z_{i}").alias(f"s_{i}") for i in range(p)], *[F.sum(F.col(f"z_{i}") * F.col(f"z_{j}")).alias(f"s_{i}_{j}") for i, j in PAIRS]
        )
        group = Window.partitionBy("lang", "source")
        before = F.coalesce(F.sum("n").over(group.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = held.withColumn("before", before).withColumn("all", F.sum("n").over(group)).where(F.col("before") < CORE * F.col("all"))
        held = held.groupBy("lang", "source").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in held.columns if c.startswith("s_")])
        old = groups.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *[F.col(f"m_{i}").alias(f"o_{i}") for i in range(p)])
        held = held.join(old, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")))
        mean = lambda i: F.col(f"s_{i}") / F.col("n")
        groups = held.select(
            "lang", "source", *[(F.col(f"o_{i}") + mean(i)).alias(f"m_{i}") for i in range(p)],
            *[(F.col(f"s_{i}_{j}") / F.col("n") - mean(i) * mean(j)).alias(f"c_{i}_{j}") for i, j in PAIRS],
        )
        groups = stored(_factored(groups, scale), "scatter")
    return groups


def pools(rows: DataFrame) -> DataFrame:
    """(lang, source, pool_lang, pool) of each group with fewer than MIN_ROWS rows that pass the base rules.

    The pool is the group's language if that has MIN_ROWS such rows in all its sources, else the whole table.
    """
    counts = rows.groupBy("lang", "source").agg(F.sum((~F.col("base_failed")).cast("long")).alias("n"))
    counts = counts.withColumn("of_lang", F.sum("n").over(Window.partitionBy("lang"))).where(F.col("n") < MIN_ROWS)
    own = F.col("of_lang") >= MIN_ROWS
    return counts.select("lang", "source", F.when(own, F.col("lang")).alias("pool_lang"), F.when(own, "language").otherwise("all").alias("pool"))


def _distance(rows: DataFrame, centres: DataFrame, keys: tuple[str, str], name: str) -> DataFrame:
    """``rows`` with the squared distance from the centre whose (lang, source) equals ``keys``; null without one."""
    centres = centres.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    match = F.col(keys[0]).eqNullSafe(F.col("of_lang")) & F.col(keys[1]).eqNullSafe(F.col("of_source"))
    out = rows.join(centres, match, "left")
    for i, feature in enumerate(NAMES):
        y = F.col(feature) - F.col(f"m_{i}")
        for k in range(i):
            y = y - F.col(f"l_{i}_{k}") * F.col(f"y_{k}")
        out = out.withColumn(f"y_{i}", y / F.col(f"l_{i}_{i}"))
    distance = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(NAMES))), F.lit(0.0))
    return out.select(*rows.columns, distance.alias(name))


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, lang, source, statistics, base_failed, distance, pool_distance, kept) of each row of ``docs``.

    A row that fails the base rules is not kept. The others are kept unless their squared distance from the centre of
    their language and source is beyond the quantile. Groups of fewer than ``MIN_ROWS`` such rows have no centre and a
    null distance; their rows are judged by ``pool_distance``, from the centre of all rows of their language, or of the
    whole table where the language has fewer than ``MIN_ROWS`` too. It is null in the other groups. Null languages and
    sources are groups of their own; null, empty and blank texts fail the base rules; repeated rows count each; an empty
    table gives no rows. Other columns are not read.
    """
    rows = stored(features(statistics(docs, **columns)), "statistics")
    good = rows.where(~F.col("base_failed"))
    small = stored(pools(rows), "pools")
    both = [F.struct(F.col("lang").alias("of_lang"), F.lit("language").alias("of_pool")), F.struct(F.lit(None).alias("of_lang"), F.lit("all").alias("of_pool"))]
    member = F.col("p.of_lang").eqNullSafe(F.col("pool_lang")) & (F.col("p.of_pool") == F.col("pool"))
    pooled = good.select(*NAMES, F.explode(F.array(*both)).alias("p")).join(small.select("pool_lang", "pool").distinct(), member, "left_semi")
    pooled = pooled.select(F.col("p.of_lang").alias("lang"), F.col("p.of_pool").alias("source"), *NAMES)
    small = small.withColumnsRenamed({"lang": "small_lang", "source": "small_source"})
    out = _distance(rows, scatter(good), ("lang", "source"), "distance")
    out = out.join(small, F.col("lang").eqNullSafe(F.col("small_lang")) & F.col("source").eqNullSafe(F.col("small_source")), "left")
    out = _distance(out, scatter(pooled, 1), ("pool_lang", "pool"), "pool_distance")
    far = F.coalesce(F.coalesce("distance", "pool_distance") > chi2_quantile(QUANTILE, len(NAMES)), F.lit(False))
    return out.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "pool_distance",
        (~F.col("base_failed") & ~far).alias("kept"),
    )
