import random
import re

from pyspark.sql import functions as F

from loomlab.llm import decontaminate as dc
from tests.llm.helpers import documents


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def found(docs, items):
    return {(r["doc_id"], r["item_id"]): r for r in dc.contaminated(docs, items).collect()}


QUESTION = "In the morning Anna buys 12 apples at the market and gives 5 km of rope to Peter before Anna eats 3 apples with her friend at the river bank."


def test_copies_and_reparameterised_questions(spark):
    rng = random.Random(8)
    filler = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    other = QUESTION.replace("Anna", "Maria").replace("12", "40").replace("5 km", "9 miles").replace("Peter", "Jonas").replace("3 apples", "7 apples")
    mixed = QUESTION.replace("Anna buys", "Maria buys").replace("Anna eats", "Otto eats").replace("Peter", "Ina").replace("In", "Um").replace("12", "40").replace(" 3 ", " 40 ")
    rows = [
        (1, filler(200) + " " + QUESTION + " " + filler(9)), (2, QUESTION.upper()), (3, filler(30) + "\n" + other), (4, filler(400)), (5, None), (6, ""),
        (7, " ".join(QUESTION.split()[:6])), (None, QUESTION), (9, "x " * 50_000 + QUESTION), (1, filler(5) + " " + QUESTION + " again"), (1, QUESTION + " again"), (1, QUESTION + " again"),
        (10, QUESTION.replace(" and", ",  and")), (11, "5 km 6 km 7 km 8 km 9 km 10 km 11 km 12 km of 3 apples"),
    ]
    docs = documents(spark, rows).withColumn("text_key", F.lit("clash")).withColumn("item", F.lit(1))
    items = bench(spark, [(70, QUESTION), (71, None), (72, "too short"), (73, "just five words of text"), (70, QUESTION)]).withColumn("doc_id", F.lit("clash"))
    got = found(docs, items)
    assert set(got) == {(i, 70) for i in (1, 2, 3, None, 9, 10)}
    assert got[3, 70]["changed"] and not got[1, 70]["changed"] and got[1, 70]["coverage"] == 1
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect())) == [4, 5, 6, 7, 11]
    # slots that contradict one another: Anna is Maria here and Otto there
    twisted = bench(spark, [(1, "so Anna and 1 cat saw Anna and 1 dog near Anna and 1 cow with Anna and 1 pig by Anna")])
    same = "so Berta and 2 cat saw Berta and 2 dog near Berta and 2 cow with Berta and 2 pig by Berta"
    names = iter(["Ada", "Bo", "Cid", "Dan", "Eva"])
    apart = re.sub("Berta", lambda m: next(names), same)
    numbers = iter("23456")
    apart = re.sub("2", lambda m: next(numbers), apart)
    assert mixed and set(found(documents(spark, [(1, same), (2, apart)]), twisted)) == {(1, 1)}


def test_matches_plain_windows_on_the_given_tables(spark):
    """Every document with a whole item is found, and none without 13 words of one in a row."""
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    plain = lambda t: [w for w in (dc.reading(w)[2] for w in re.split(r"[\x20\x09-\x0D]+", t)) if w]
    joined = lambda ws: " " + " ".join(ws) + " "
    texts = {r["doc_id"]: joined(plain(r["text"])) for r in docs.collect()}
    whole, some = set(), set()
    for r in items.collect():
        ws = plain(r["text"])
        runs = [joined(ws[i : i + 13]) for i in range(max(1, len(ws) - 12))]
        for d, t in texts.items():
            if any(x in t for x in runs):
                some.add((d, r["item_id"]))
                if joined(ws) in t:
                    whole.add((d, r["item_id"]))
    rows = found(docs, items)
    assert len(whole) > 10 and whole <= set(rows) <= some | {x for x, r in rows.items() if r["changed"]}


def test_each_occurrence_is_judged_by_itself(spark):
    """An item that a document holds twice with different values is found, next to each other or apart."""
    rng = random.Random(15)
    filler = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    other = QUESTION.replace("12", "40").replace("5 km", "9 miles").replace("3 apples", "7 apples")
    third = QUESTION.replace("12", "41").replace("5 km", "8 feet").replace("3 apples", "6 apples")
    moved = QUESTION.replace("rope to", "rope then to")  # splits the copy into two alignments
    short = "the 7 red boats sail north"
    rows = [
        (1, f"{QUESTION} {filler(50)} {other}"), (2, f"{other} {QUESTION}"), (3, f"{other} {third}"), (4, f"{moved} {filler(3)} {other} {third}"),
        (5, " ".join(short.replace("7", str(n)) for n in range(2, 7))), (6, filler(300)), (7, f"{QUESTION[:40]} {filler(90)} {other[:40]}"),
    ]
    got = found(documents(spark, rows), bench(spark, [(70, QUESTION), (71, short)]))
    assert set(got) == {(1, 70), (2, 70), (3, 70), (4, 70), (5, 71)}
    assert [got[i, 70]["changed"] for i in (1, 2, 3)] == [False, False, True] and got[1, 70]["coverage"] == 1


def test_nothing_on_either_side(spark):
    docs, items = documents(spark, [(1, QUESTION)]), bench(spark, [(1, QUESTION)])
    assert found(documents(spark, []), items) == {} and found(docs, bench(spark, [])) == {}
    assert dc.clean(docs, bench(spark, [])).count() == 1


DENSE = "Order 3, 7, 12, 19, 24, 31, 45 from least to greatest"


def test_items_of_numbers_and_short_items_are_found_as_copies(spark):
    sums = "Compute 3 + 4 - 5 * 6 / 2"
    items = spark.createDataFrame([("dense", DENSE), ("sums", sums), ("short", "Name the capital"), ("one", "Why")], "item_id string, text string")
    rows = [
        ("a", f"some words before {DENSE} and words behind"), ("b", sums), ("c", DENSE.replace("19", "20").replace("7,", "8,")), ("d", "name the CAPITAL"),
        ("e", "please name the capital now"), ("f", "why"), ("g", "why not"), (None, "x " * 3000 + sums),
    ]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert set(found(docs, items)) == {("a", "dense"), ("b", "sums"), ("d", "short"), ("f", "one"), (None, "sums")}
    assert sorted(str(r["doc_id"]) for r in dc.clean(docs, items).collect()) == ["c", "e", "g"]


def test_a_run_stands_in_a_row(spark):
    """Thirteen words in a row are found; as many windows of the item scattered over a document are not."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    item = [word() for _ in range(60)]
    filler = lambda n: [word() for _ in range(n)]
    scattered = sum((filler(40) + item[i : i + 8] for i in range(0, 48, 8)), [])
    dense = item[:20] + "4 5 6 7 8".split() + item[25:]
    rows = [(1, filler(50) + item[20:33] + filler(50)), (2, scattered), (3, filler(9) + item[20:32] + filler(9)), (4, filler(30) + dense[15:28] + filler(5))]
    docs = documents(spark, [(i, " ".join(w)) for i, w in rows])
    assert set(found(docs, bench(spark, [(70, " ".join(item)), (71, " ".join(dense))]))) >= {(1, 70), (4, 71)}
    assert not {d for d, _ in found(docs, bench(spark, [(70, " ".join(item))]))} & {2, 3}


def slow_occurrences(doc, item, form):
    """(windows of the item matched, longest run at one alignment) by comparing every window with every other."""
    def read(text):
        r = dc.Reading(__import__("pyarrow").array([text]))
        words = [r.bare[i] for i in r.at]
        slot = r.forms[form][1]
        kinds = r.kind
        out = []
        for i in range(len(words) - 7):
            filled = [bool(slot[i + j]) for j in range(8)]
            template = 8 - sum(filled) >= 5
            out.append(tuple(("slot", int(kinds[i + j])) if template and filled[j] else words[i + j] for j in range(8)) + (template,))
        return out

    d, w = read(doc), read(item)
    pairs = {(j - i, i) for i, x in enumerate(w) for j, y in enumerate(d) if x == y}
    best = 0
    for a in {a for a, _ in pairs}:
        places = sorted(i for b, i in pairs if b == a)
        run = 0
        for k, i in enumerate(places):
            run = run + 1 if k and places[k - 1] == i - 1 else 1
            best = max(best, run)
    return len({i for _, i in pairs}), len(w), best


def test_windows_and_runs_equal_the_slow_version(spark):
    rng = random.Random(21)
    vocabulary = ["red", "blue", "Anna", "Peter", "7", "12", "kg", "and", "of", "the", "sea", "runs", "3.5", "km"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(9, 30))) for _ in range(12)]
    docs = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40)) + texts[i % 12].split()[rng.randint(0, 4) : rng.randint(12, 30)] + rng.choices(vocabulary, k=9)) for i in range(40)]
    got = found(documents(spark, list(enumerate(docs))), bench(spark, list(enumerate(texts))))
    may = set()
    for i, d in enumerate(docs):
        for j, t in enumerate(texts):
            for form in (0, 1):
                windows, total, run = slow_occurrences(d, t, form)
                if total and (windows >= total / 2 or run >= 6):
                    may.add((i, j))
    assert set(got) <= may and len(may) > 20
    sure = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(texts) if f" {t.lower()} " in f" {d.lower()} "}
    assert sure <= set(got)
