import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loomlab.llm import decontaminate, langid
from tests.llm.helpers import documents
from tests.llm.test_mixing import brute_taken
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_run_matches_a_slow_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    accepted = {r["doc_id"] for r in langid.identify(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= 0.4)).select("doc_id").collect()}
    rows = sorted((r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect() if r["doc_id"] in accepted)
    component = brute_components([(d, brute_fingerprint(t)) for d, t, _, _ in rows])
    rows = [r for r in rows if component[r[0]] == {r[0]}]
    plain = lambda t: " " + " ".join(w for w in (decontaminate.reading(x)[2] for x in re.split(r"[\x20\x09-\x0D]+", t)) if w) + " "
    items = [plain(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i in plain(r[1]) for i in items)]
    size, _, taken = brute_taken(rows)
    library, want, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for (d, t, _, _), n, k in zip(rows, size, taken):
        for _ in range(int(k / n + 0.5) if n else 0):
            ids = library.encode(t, add_special_tokens=False).ids + [2]
            want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == want and len(want) > 50


def test_stages_keep_columns_and_stand_empty_tables(spark, folder):
    docs = documents(spark, []).withColumn("fp", F.lit("clash")).withColumn("mix_pass", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


def test_messy_rows(spark, folder):
    rows = [(1, None), (2, ""), (3, "123"), (None, "words of no id that stand alone here"), (5, "the same text twice over and over"), (5, "the same text twice over and over"), (7, "x " * 30_000, None, None)]
    docs = documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns and kept.count() <= 3 * len(rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(rows)
