import re

from pyspark.sql import functions as F

from loomlab.llm import licenses
from tests.llm.helpers import documents


def test_canonical_words():
    read = licenses.Canonical(['The "Licence",\n\n  VERSION 2.0 — v2.0 (organisation)', "Copyright (c) 2020 Me\nkept line\n# (C) Me too\nend", ""])
    assert [read.words[i] for i in read.at] == ["the", "license", "20", "20", "organization", "kept", "line", "end"]
    assert read.counts.tolist() == [5, 3, 0]


def test_known_texts_are_told_apart():
    digests = {}
    for name, _, text in licenses.known_texts():
        read = licenses.Canonical([text])
        assert digests.setdefault(read.digest(0, len(read.at)), name) == name


def test_scan(spark):
    mit = "The MIT Licence\n\nCopyright (c) 1999 Somebody\n\n" + licenses.MIT_TEXT
    wrapped = "Copyright 2001 X. All rights reserved.\n" + re.sub(r"\s+", "\n * ", licenses.MIT_TEXT.lower().replace(",", " , "))
    rows = [
        (1, mit), (2, wrapped), (3, "words before. Released under the MIT License. words behind\nand licensed under CC BY-NC 4.0."), (4, "a licence of no kind"),
        (5, None), (6, ""), (7, licenses.MIT_TEXT.replace("free of charge", "for a fee")), (8, "Copyright only"), (None, "This work is licenced under the GNU General Public Licence, version 3."),
        (9, "x " * 200_000 + "Licensed under the Apache License, Version 2.0. " * 2), (10, "GPLv3? licensed under GPLv3"), (10, "GPLv3? licensed under GPLv3"),
        (11, licenses.APACHE_HEADER),
    ]
    docs = documents(spark, rows).withColumn("row", F.lit("clash")).withColumn("license", F.lit("clash"))
    got = {(r["doc_id"], r["license"]): (r["kind"], r["matches"], r["whole"]) for r in licenses.scan(docs).collect()}
    assert got.pop((2, "MIT")) == ("text", 1, True) and got.pop((1, "MIT")) == ("text", 1, False)
    assert got.pop((3, "MIT")) == ("notice", 1, False) and got.pop((3, "CC-BY-NC-4.0")) == ("notice", 1, False)
    assert got.pop((None, "GPL-3.0")) == ("notice", 1, False) and got.pop((9, "Apache-2.0")) == ("notice", 2, False)
    assert got.pop((10, "GPL-3.0")) == ("notice", 2, False) and got.pop((11, "Apache-2.0"))[2] is True
    assert got == {}


def test_matches_plain_search_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plain = lambda t: " " + " ".join(w for w in (licenses.canonical(x)[0] for x in re.split(r"[\x20\x09-\x0D]+", licenses.without_copyright(t))) if w) + " "
    known = {(n, plain(t)) for n, _, t in licenses.known_texts()}
    want = set()
    for r in docs.select("doc_id", "text").collect():
        text = plain(r["text"])
        if "licens" in text or "under" in text:
            want |= {(r["doc_id"], n) for n, t in known if t in text}
    assert {(r["doc_id"], r["license"]) for r in licenses.scan(docs).collect()} == want and len(want) > 5


def test_nothing_to_scan_or_to_know(spark):
    assert licenses.scan(documents(spark, [])).count() == 0
    assert licenses.scan(documents(spark, [(1, "MIT License")]), known=[]).count() == 0


def test_matches_do_not_depend_on_partitions(spark):
    rows = [(1, "Released under the MIT License.")] * 4 + [(None, "under GPLv3, licensed under GPLv3")] * 3
    docs = documents(spark, rows)
    for n in (1, 2, 4, 7):
        got = {(r["doc_id"], r["license"]): r["matches"] for r in licenses.scan(docs.repartition(n)).collect()}
        assert got == {(1, "MIT"): 4, (None, "GPL-3.0"): 3}


def test_gnu_headers_identifiers_and_long_texts(spark, tmp_path):
    header = "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version. */"
    own = "one two three four five six seven eight nine ten " * 300
    rows = [("a", header), ("b", "# SPDX-License-Identifier: GPL-3.0-or-later\nx"), ("c", "SPDX-License-Identifier: LGPL-2.1-only"), ("d", licenses.UNLICENSE_TEXT), ("e", own + "end"), (None, header)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r["doc_id"], r["license"]): r["kind"] for r in licenses.scan(docs).collect()}
    assert got == {("a", "GPL-3.0-or-later"): "header", ("b", "GPL-3.0-or-later"): "notice", ("c", "LGPL-2.1-only"): "notice", ("d", "Unlicense"): "text", (None, "GPL-3.0-or-later"): "header"}
    name, kind, n, begins, digest = licenses.known_row("Own-1.0", "text", own)
    assert n == 3000 and {r["doc_id"] for r in licenses.scan(docs, known=[("Own-1.0", "text", own)]).collect()} == {"e"}
    whole = {r[0]: r for r in licenses.known_rows() if r[1] == "text"}
    assert {"GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Apache-2.0", "CC0-1.0"} <= set(whole)
