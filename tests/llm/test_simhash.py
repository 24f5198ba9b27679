import random

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomlab.llm import simhash
from loomlab.llm.components import components
from tests.llm.helpers import documents


def brute_fingerprint(text, k=4):
    words = (text or "")
    words = "".join(c.lower() if c.isascii() else c for c in words)
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids_fps, bits=4):
    parent = {x: x for x in range(len(ids_fps))}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, f) in enumerate(ids_fps):
        for j in range(i):
            if (f ^ ids_fps[j][1]).bit_count() <= bits:
                parent[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(ids_fps):
        ids = [ids_fps[j][0] for j in range(len(ids_fps)) if find(j) == find(i) and ids_fps[j][0] is not None]
        out.setdefault(d, set()).add(min(ids) if ids else None)
    return out


@given(st.text(max_size=60) | st.lists(st.sampled_from(["a", "B", "É", "\x1c", "x y"]), max_size=12).map(" ".join))
@settings(max_examples=60, deadline=None)
def test_fingerprint_follows_the_definition(text):
    assert simhash.fingerprint(text.encode("utf-8", "replace")) == brute_fingerprint(text.encode("utf-8", "replace").decode())


def test_every_close_pair_shares_a_key_and_a_viable_chain():
    rng = random.Random(1)
    for bits in (2, 3, 4, 5):
        masks = simhash.key_masks(bits)
        ring = simhash.segments(bits)
        assert sum(ring) == simhash.ALL
        for _ in range(3000):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), rng.randint(1, bits)):
                y ^= 1 << b
            met = False
            for start, mask in masks:
                if (x ^ y) & mask == 0:
                    turn = [ring[(start + j) % len(ring)] for j in range(len(ring))]
                    met |= all(((x ^ y) & sum(turn[: j + 1])).bit_count() <= j for j in range(len(ring)))
            assert met


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = list(base)
    for b in base[:30]:
        x = b
        for _ in range(6):  # chains that leave the first one's neighborhood
            for bit in rng.sample(range(64), 3):
                x ^= 1 << bit
            fps.append(x)
    center = rng.getrandbits(64)
    fps += [center ^ (1 << i) ^ (1 << j) for i in range(0, 24) for j in range(i)]
    fps = list(dict.fromkeys(fps))
    for part in (20_000, 50):  # also with every bucket dealt out in parts
        monkeypatch.setattr(simhash, "BUCKET_PART", part)
        links = simhash.linked(spark.createDataFrame([(_signed(f),) for f in fps], "fp long"))
        roots = {r["node"]: r["root"] for r in components(links).collect()}
        got = {}
        for f in fps:
            got.setdefault(roots.get(_signed(f), _signed(f)), set()).add(f)
        want = brute_components([(i, f) for i, f in enumerate(fps)])
        groups = {}
        for i, f in enumerate(fps):
            groups.setdefault(min(want[i]), set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_of_paths_and_hubs(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (1, 2)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and all(got[i] == 1000 for i in range(1001, 1400))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def messy():
    long = " ".join(f"w{i}" for i in range(30_000))
    text = " ".join(f"tok{i}" for i in range(300))
    near = text.replace("tok7 ", "tok_ ")
    return [
        (3, text), (9, text), (4, near), (4, near), (None, text), (5, None), (6, ""), (7, " \n\t"), (8, "one two"),
        (10, "ONE\ttwo"), (11, long), (12, long + " end"), (1, "completely different words that match nothing else here"),
        (None, "only nameless rows say this sentence"), (None, "only nameless rows say this sentence"),
        (None, "another nameless sentence without any copy at all"),
    ]


def test_rows_match_brute_force_on_messy_input(spark):
    rows = messy()
    docs = documents(spark, rows).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0)).withColumn("root", F.lit(1))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_fp = {}
    for r in got:
        by_fp.setdefault(r["fp"], set()).add(r["component_id"])
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    want = brute_components(fps)
    for r in got:
        assert r["component_id"] in want[r["doc_id"]]
    assert sorted(_signed(f) for _, f in fps) == sorted(r["fp"] for r in got)
    assert all(len(x) == 1 for x in by_fp.values())


def test_one_row_of_each_group_stays(spark):
    rows = messy()
    docs = documents(spark, rows).withColumn("several", F.lit("clash")).withColumn("FP", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    ids = [x[1] for x in got if not x[0]]
    assert ids == [1, 3, 5, 8, 11] and len([x for x in got if x[0]]) == 2
    twice = documents(spark, [(2, "a b c d e f"), (2, "a b c d e f"), (3, "x y z")])
    assert sorted(r["doc_id"] for r in simhash.keep_one(twice).collect()) == [2, 3]


def test_an_id_of_several_components_stays_once_in_each(spark):
    rows = [(1, "alpha beta gamma delta epsilon"), (4, "alpha beta gamma delta epsilon"), (4, "nothing of that is here at all"),
            (4, "a third text with its own words"), (4, "a third text with its own words"), (7, "a third text with its own words")]
    got = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(documents(spark, rows)).collect())
    assert got == sorted({rows[0], rows[2], rows[3]})


def test_empty_table(spark):
    empty = documents(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
