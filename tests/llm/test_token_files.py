import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomlab.llm import token_files as tf
from tests.llm.helpers import documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(5)
    bits = ["The", "the", "thé", "École,", "don't", "x'll", "a\x1cb", "\xa0", " ", "​", "é", "İ", "ΑΣ.", "ſ", "ß", "Ünï!?", "#", "!!", "12,5", "<|endoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>", "<|EndOf", "\n", "\t", "日本語", "😀", "́", "ﬁ", "...", "a.b", "Å"]
    out = [None, "", " \n", "#"] + [" ".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(200)]
    return out + ["".join(rng.choices(bits, k=8)) for _ in range(200)] + [" ".join(rng.choices(bits[:5], k=40_000))]


def test_word_tokenizer_equals_the_library(monkeypatch):
    library = Tokenizer.from_file(PATH)
    own = tf.WordTokenizer(PATH)
    monkeypatch.setattr(tf, "REMEMBERED", 300)
    for some in (texts(), texts()[::-1]):
        for i in range(0, len(some), 7):
            part = [t or "" for t in some[i : i + 7]]
            ids, sizes = own.ids(pa.array(part))
            want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
            assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("length", [16, 2048])
def test_round_trip(spark, tmp_path, length):
    library = Tokenizer.from_file(PATH)
    rows = [(i * 7 % 601, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, "same id"), (3, "same id"), (3, "again")]
    docs = documents(spark, rows).withColumn("start", F.lit("clash")).withColumn("place", F.lit(1)).repartition(5)
    folder = f"file://{tmp_path}/out"
    shards = tf.write_shards(docs, folder, PATH, 2, length)
    got = tf.read_back(shards).collect()
    assert len(got) == len(rows)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [d for d, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    want = {}
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at, seen = 0, {}
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        seen.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    for s in shards.collect():
        reader = tf.open_arrow(s["shard"] + ".arrow")
        batches = [reader.get_batch(i) for i in range(reader.num_record_batches)]
        assert all(b.num_rows == tf.BATCH for b in batches[:-1])
        assert all(pa.types.is_fixed_size_list(b.schema.field(0).type) and b.schema.field(0).type.list_size == length for b in batches)
        assert sum(b.column(1).values.true_count for b in batches) == s["tokens"]


def test_empty_table(spark):
    assert tf.token_files(documents(spark, []), PATH).count() == 0


def test_control_strings_in_any_letter_case_equal_the_library():
    library, own = Tokenizer.from_file(PATH), tf.WordTokenizer(PATH)
    rng = random.Random(11)
    control = [t.content for t in library.get_added_tokens_decoder().values()]
    odd = lambda c: "".join(rng.choice([x.lower(), x.upper()]) for x in c)
    bits = ["say", "Now", "<|", "|>", "a<", "Ünï", "12,5", "\n", "  "]
    texts = ["say <|EndOfText|> now"] + ["".join(rng.choice([odd(rng.choice(control)), rng.choice(control), rng.choice(bits), " "]) for _ in range(rng.randint(1, 9))) for _ in range(10_000)]
    ids, sizes = own.ids(pa.array(texts))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_text_ids(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two words"), ("a", None), (None, "x")], "doc_id string, text string")
    got = tf.token_files(docs, PATH, 2, 16, f"{tmp_path}/out").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, "a", "b"] and [r["start"] for r in got] == [0, 2, 3]
