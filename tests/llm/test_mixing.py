import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from loomlab.llm import mixing
from tests.llm.helpers import documents


def brute_targets(sizes, passes=3):
    """Sharing again and again until no target is above its limit."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(passes * sizes[s] for s in stopped)
        w = sum(weight[s] for s in names if s not in stopped)
        out = {s: passes * sizes[s] if s in stopped else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in stopped and out[s] > passes * sizes[s] + 1e-9}
        if not over:
            return names, out
        stopped |= over


def brute_taken(rows, block=64, passes=3):
    """rows: (doc_id, text, lang, source); the schedule walked slot by slot."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _, _ in rows]
    per = {}
    for (_, _, _, s), n in zip(rows, size):
        per[s] = per.get(s, 0) + n
    names, target = brute_targets(per)
    total, edges, reach = sum(per.values()), [], 0
    for s in names:
        reach += target[s]
        edges.append(reach / total)
    edges[max(i for i, s in enumerate(names) if target[s] > 0)] = 1.0
    slots = dict.fromkeys(names, 0)
    for n in range(1, math.ceil(total / block) + 1):
        x = n * mixing.GOLDEN % 2**40 / 2**40
        slots[names[next(i for i, e in enumerate(edges) if x < e)]] += 1
    out = [0] * len(rows)
    for s in names:
        draw = lambda i: hashlib.md5(f"{'' if rows[i][0] is None else rows[i][0]}:mix".encode()).hexdigest()
        order = sorted((i for i in range(len(rows)) if rows[i][3] == s), key=lambda i: (draw(i), size[i], i))
        stream = [i for _ in range(passes) for i in order for _ in range(size[i])]
        for i in stream[: min(slots[s] * block, math.floor(target[s]))]:
            out[i] += 1
    return size, target, out


def rows_of(n=220):
    out = []
    for i in range(n):
        source = [None, "a", "b", "é", "big", "big", "big", "tiny"][i % 8] if i % 40 else "tiny"
        out.append((i, " ".join(["w"] * (i * 37 % 211)), "en", source))
    return out + [(7, "again and again", "en", "a"), (None, "no id \t here", "en", "a"), (900, None, "en", "b"), (901, " ", "en", None), (902, "x " * 9000, "en", "b")]


@pytest.mark.parametrize("rows", [rows_of(), [(1, "one", "en", "a"), (2, "two words", "en", None)], [(i, "x " * (300 if i else 3), "en", f"s{i:02}") for i in range(9)]])
def test_taken_words_match_a_slow_walk(spark, rows):
    docs = documents(spark, rows).withColumn("size", F.lit("clash")).withColumn("row", F.lit(None).cast("int"))
    got = mixing.taken(mixing.sized(docs)).collect()
    size, target, want = brute_taken(rows)
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got) == sorted((d or -1, n, k) for (d, _, _, _), n, k in zip(rows, size, want))
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 3 * r["size"]


def test_sources_come_near_their_targets(spark, folder):
    got = mixing.taken(mixing.sized(spark.read.parquet(f"{folder}/documents.parquet")))
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect():
        assert abs(r["t"] - r["target"]) <= 0.05 * r["target"] + 128


def test_slots_interleave(spark):
    rows = spark.createDataFrame([(i, i, "a" if i % 2 else "b", 1000) for i in range(40)], "row long, doc_id long, source string, size long")
    per, pieces = mixing.mix(rows, weights=[1, 3])
    found = [r["number"] for r in pieces.select("slot", "number").distinct().orderBy("slot").collect()]
    share = found.count(0) / len(found)
    assert share == pytest.approx(0.25, abs=0.01)
    for i in range(0, len(found) - 40, 40):  # no long stretch without either source
        assert abs(found[i : i + 40].count(0) - 10) <= 2
    again = mixing.mix(rows, weights=[1, 3])[1]
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, again.collect()))


def test_copies_follow_the_words_taken(spark):
    rows = rows_of()
    docs = documents(spark, rows).withColumn("mix_times", F.lit("clash"))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    want = {}
    for r in mixing.taken(mixing.sized(docs)).collect():
        if r["taken"]:
            want[(r["doc_id"], r["size"])] = math.floor(r["taken"] / r["size"] + 0.5)
    got = {}
    for r in out.collect():
        k = (r["doc_id"], len(re.findall(r"\S+", r["text"])))
        got[k] = got.get(k, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_nothing_to_mix(spark):
    for rows in ([], [(1, None), (2, "  ")]):
        docs = documents(spark, rows)
        assert [(r["taken"], r["target"]) for r in mixing.taken(mixing.sized(docs)).collect()] == [(0, 0.0)] * len(rows)
        assert mixing.mixed_documents(docs).count() == 0
