import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlab.llm import langid
from tests.llm.helpers import documents


def brute_em(like, share, rounds):
    """One document, segment by segment."""
    for _ in range(rounds):
        total = np.zeros(len(share))
        for row in like:
            p = share * np.exp(row - row.max())
            total += p / p.sum()
        share = total / len(like)
    return share, sum(np.log((share * np.exp(row - row.max())).sum()) for row in like)


def test_proportions_match_one_document_at_a_time():
    rng = np.random.default_rng(6)
    docs = [rng.normal(0, 4, (n, 4)) for n in (1, 2, 7, 30)]
    like, firsts = np.concatenate(docs), np.cumsum([0] + [len(d) for d in docs[:-1]])
    share, value = langid.proportions(like, firsts, np.full((4, 4), 0.25))
    chosen = langid.choose(like, firsts)
    for i, d in enumerate(docs):
        want, total = brute_em(d, np.full(4, 0.25), langid.ROUNDS)
        assert share[i] == pytest.approx(want) and value[i] == pytest.approx(total)
        assert chosen[i].sum() == pytest.approx(1)
        order = np.argsort(-want)
        best, top = None, -np.inf
        for m in range(1, 5):
            start = np.where(np.isin(np.arange(4), order[:m]), np.maximum(want, 1e-6), 0)
            s, v = brute_em(d, start / start.sum(), langid.ROUNDS if m > 1 else 0)
            v -= (m - 1) * (langid.PENALTY + 0.5 * np.log(len(d)))
            if v > top:
                best, top = s, v
        assert chosen[i] == pytest.approx(best)


def test_counts_are_those_of_all_texts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("Aé b1", "x"), ("aé b2", "x"), ("zz" * 20_000, "y"), ("", "x")])]
    got = {(r["lang"], r["bucket"]): r["n"] for r in langid.counts(documents(spark, rows).repartition(3)).collect()}
    want = {}
    for _, t, lang in rows:
        raw = b" " + "".join(c if c.isalpha() else " " for c in t.lower()).encode() + b" "
        for i in range(len(raw) - 2):
            b = ((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 16
            want[lang, b] = want.get((lang, b), 0) + 1
    assert got == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r["lang"] == r["lang_pred"] for r in got if r["held_out"]]
    assert sum(held) / len(held) > 0.97
    assert langid.accepted(docs).count() > 0.99 * docs.count()


def messy():
    rng = random.Random(7)
    words = {"xx": ["kalo", "mira", "tuno", "belka"], "yy": ["schtr", "wrang", "drumpf", "oerk"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i in range(60) for lang in ("xx", "yy")]
    mixed = " ".join(rng.choices(words["xx"], k=400)) + " " + " ".join(rng.choices(words["yy"], k=400))
    return rows + [(100, None), (101, ""), (102, "123 !!"), (103, "a"), (None, "kalo mira"), (104, "kalo", None), (105, mixed, None), (106, "schtr " * 60_000, None), (104, "kalo", None)]


def test_messy_rows_and_mixtures(spark):
    docs = documents(spark, messy()).withColumn("score", F.lit("clash")).withColumn("LANG_PRED", F.lit(1))
    got = langid.identify(docs)
    assert len(set(got.columns)) == len(got.columns) == len(docs.columns) + 4
    rows = {}
    for r in got.collect():
        rows.setdefault(r["doc_id"], []).append((r["lang_pred_"], r["score_"], r["mixture"]))
    assert all(rows[i][0][:2] == ("und", 0.0) for i in (100, 101, 102))
    assert rows[106][0][0] == "yy" and rows[104] == [rows[104][0]] * 2 and rows[None][0][0] in ("xx", "en")
    assert dict(x.split(":") for x in rows[105][0][2].split(",")).keys() == {"xx", "yy"}
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and not {100, 101, 102} & {r["doc_id"] for r in kept.collect()}


def test_nothing_to_learn_from(spark):
    assert langid.identify(documents(spark, [])).count() == 0
    got = langid.identify(documents(spark, [(1, "some text", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]


def test_the_model_has_a_bound(spark, monkeypatch):
    docs = documents(spark, [(i, "some text", f"l{i % 5}") for i in range(40)] + [(90, "more", None)])
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 5)
    assert langid.identify(docs).count() == 41
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 4)
    with pytest.raises(ValueError, match="languages"):
        langid.identify(docs)
