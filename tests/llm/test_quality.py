import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlab.llm import quality
from tests.llm.helpers import documents

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    inside = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def texts():
    rng = random.Random(11)
    out = [None, "", " \n\t", "a", "a b c", "a b c a b c", "a a a a a", "x\nx\n\n \nx ", "# * <b> é|é 😀", "a b c d a b c"]
    out += [" ".join(rng.choices("ab", k=rng.randint(1, 30))) for _ in range(60)]
    out += ["\n".join(" ".join(rng.choices(["é", "\x1c", "b c", "#"], k=3)) for _ in range(12)) for _ in range(20)]
    return out + [" ".join(rng.choices("abcdefghij", k=40_000))]


def test_statistics_match_brute_force(spark):
    some = texts()
    docs = documents(spark, list(enumerate(some))).withColumn("n_words", F.lit("clash"))
    rows = quality.statistics(docs).collect()
    assert {r["doc_id"]: tuple(r[c] for c in STATS) for r in rows} == {i: brute(t) for i, t in enumerate(some)}
    for r in rows:
        n, _, _, _, k = brute(some[r["doc_id"]])
        assert r["base_failed"] == (n < 50 or 100 * k > 50 * n)


def test_colliding_upper_bits_take_the_exact_way(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACE_BITS", 60)  # four upper bits are left, so most windows share them
    monkeypatch.setattr(quality, "PLACES", (1 << 60) - 1)
    some = texts()[:-1]
    rows = quality.statistics(documents(spark, list(enumerate(some)))).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in rows} == {i: brute(t)[4] for i, t in enumerate(some)}


@given(st.floats(0.01, 60), st.integers(1, 9))
@settings(max_examples=40, deadline=None)
def test_chi_squared(x, k):
    steps = np.linspace(0, x, 20_001)[1:]
    mid = steps - x / 40_000
    if k >= 2:
        density = mid ** (k / 2 - 1) * np.exp(-mid / 2) / (2 ** (k / 2) * __import__("math").gamma(k / 2))
        assert quality.chi2_cdf(x, k) == pytest.approx(density.sum() * x / 20_000, abs=2e-3)
    q = quality.chi2_cdf(x, k)
    if 1e-6 < q < 1 - 1e-9:
        assert quality.chi2_quantile(q, k) == pytest.approx(x, rel=1e-3)


def table(spark, seed=12):
    rng = np.random.default_rng(seed)
    rows = []
    for g, (lang, source) in enumerate([("en", "a"), ("en", None), ("de", "a")]):
        mix = rng.normal(0, 1, (5, 5)) * 0.4
        x = rng.normal(0, 1, (400, 5)) @ mix + rng.normal(0, 3, 5)
        x[:40] += 25  # one in ten lies far off
        rows += [(g * 1000 + i, lang, source, *map(float, v)) for i, v in enumerate(x)]
    rows += [(9000 + i, "fr", "a", 1.0, 1.0, 0.0, 0.0, 0.0) for i in range(10)]
    kinds = "doc_id long, lang string, source string, " + ", ".join(f"{n} double" for n in quality.NAMES)
    return rows, spark.createDataFrame(rows, kinds)


def numpy_scatter(x):
    """The same concentration steps for one group."""
    floors = np.array(list(quality.FEATURES.values())) ** 2
    lift = lambda c: c + np.diag(np.maximum(floors - np.diag(c), 0))
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0, method="inverted_cdf")
    centre, cov = q[1], lift(np.diag(((q[2] - q[0]) / 1.349) ** 2))
    scale = quality.CORE / quality.chi2_cdf(quality.chi2_quantile(quality.CORE, 5), 7)
    for _ in range(quality.STEPS):
        z = x - centre
        d = np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z)
        classes = np.floor(16 * np.log(d + 1e-6))
        held = z[[(classes < c).sum() < quality.CORE * len(x) for c in classes]]
        centre, cov = centre + held.mean(axis=0), lift(scale * np.cov(held.T, bias=True))
    return centre, cov


def test_scatter_matches_numpy_and_ignores_a_tenth_of_outliers(spark):
    rows, df = table(spark)
    got = {(r["lang"], r["source"]): r for r in quality.scatter(df).collect()}
    assert set(got) == {("en", "a"), ("en", None), ("de", "a")}
    for (lang, source), r in got.items():
        x = np.array([v[3:] for v in rows if (v[1], v[2]) == (lang, source)])
        centre, cov = numpy_scatter(x)
        factor = np.zeros((5, 5))
        for i, j in quality.PAIRS:
            factor[i, j] = r[f"l_{i}_{j}"]
        assert np.array([r[f"m_{i}"] for i in range(5)]) == pytest.approx(centre, abs=1e-6)
        assert factor @ factor.T == pytest.approx(cov, abs=1e-6)
        assert np.abs(centre - x[40:].mean(axis=0)).max() < 0.3


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(13)
    words = [f"w{rng.randint(0, 9)}{'abcdefgh'[rng.randint(0, 7)] * rng.randint(1, 6)}{i}" for i in range(4000)]
    clean = lambda: "\n".join(" ".join(rng.choices(words, k=rng.randint(9, 60))) for _ in range(rng.randint(3, 9)))
    rows = [(i, clean(), "en", "s") for i in range(200)]
    rows += [(900, " ".join(w + "#$" for w in rng.choices(words, k=200)), "en", "s"), (901, "short", "en", "s"), (902, "same words again " * 40, "en", "s"), (903, None, "en", "s")]
    rows += [(904, " ".join(rng.choices(words, k=120)), None, None), (None, clean(), "en", "s"), (904, clean(), None, None)]
    frame = quality.judge(documents(spark, rows))
    got = {}
    for r in frame.collect():
        got.setdefault(r["doc_id"], []).append((r["kept"], r["distance"]))
    assert [got[i][0][0] for i in (900, 901, 902, 903)] == [False] * 4
    assert got[904] == [(True, None)] * 2 and sum(got[i][0][0] for i in range(200)) == 200
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_of_small_groups_are_judged_by_their_pool(spark):
    """Many small sources of one language, and a language of three rows: the junk goes from either."""
    rng = random.Random(14)
    words = [f"{'abcdefgh'[rng.randint(0, 7)] * rng.randint(1, 6)}{i}" for i in range(4000)]
    clean = lambda: "\n".join(" ".join(rng.choices(words, k=rng.randint(9, 60))) for _ in range(rng.randint(3, 9)))
    junk = lambda: " ".join(w + "#$" for w in rng.choices(words, k=200))
    rows = [(i, clean(), "en", f"s{i % 20}") for i in range(200)] + [(300 + i, clean(), "de", "big") for i in range(60)]
    rows += [(900, junk(), "en", "s3"), (901, junk(), "en", "alone"), (902, junk(), None, "s3"), (903, clean(), None, "s3"), (904, clean(), None, None), (905, "short", "xx", None)]
    got = {r["doc_id"]: r for r in quality.judge(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert all((r["distance"] is None) == (r["lang"] != "de") and (r["distance"] is None) != (r["pool_distance"] is None) for r in got.values())
    assert sorted(i for i, r in got.items() if not r["kept"]) == [900, 901, 902, 905]
    # a language's pool holds all its rows, the last pool those of all languages
    near = quality.features(quality.statistics(documents(spark, rows))).where(~F.col("base_failed"))
    assert {(r["lang"], r["source"]): (r["pool_lang"], r["pool"]) for r in quality.pools(near).collect() if r["source"] in ("alone", None)} == {
        ("en", "alone"): ("en", "language"), (None, None): (None, "all")
    }
    # a whole table below the least size is its own pool
    few = {r["doc_id"]: r for r in quality.judge(documents(spark, rows[:30] + [(900, junk(), "en", "s3")])).collect()}
    assert all(r["pool_distance"] is not None for r in few.values()) and [i for i, r in few.items() if not r["kept"]] == [900]


def test_empty_table(spark):
    assert quality.judge(documents(spark, [])).count() == 0
