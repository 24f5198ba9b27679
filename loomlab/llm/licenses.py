"""License scans: canonical texts of known licences and notices, looked up by digest.

Texts are read as canonical words: small letters, no punctuation, one spelling for equivalent words, no copyright lines.
The words of a whole licence text, or notice, have one digest, wherever they stand in a document and however its lines
are broken. Tasks find places where a known text's first words stand, by a rolling hash; the digests of as many canonical words
from there as the whole text has are then hash-joined to the known digests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlab.llm import license_digests
from loomlab.llm.common import coded_words, rolling, text_parts

#: Spellings that licence texts use for the same word.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense",
    "organisation": "organization", "organisations": "organizations", "authorise": "authorize", "authorised": "authorized",
    "recognise": "recognize", "recognised": "recognized", "favour": "favor", "favourable": "favorable", "behaviour": "behavior",
    "honour": "honor", "merchantibility": "merchantability", "acknowledgement": "acknowledgment", "judgement": "judgment",
    "programme": "program", "centre": "center", "wilful": "willful", "fulfil": "fulfill", "instalment": "installment",
    "percent": "per-cent", "noncommercial": "non-commercial", "copyrightholder": "copyright-holder", "whilst": "while", "utilise": "utilize",
}
#: A line that states a copyright; a wrapped licence text may well begin a line with the word alone.
COPYRIGHT = re.compile(
    r"^[ \t#/*;%-]*(?:copyright[ \t]*(?:\(c\)|©|:|by\b|\d{4})|\(c\)[ \t]*(?:\d{4}|[A-Z])|©|all rights reserved)[^\n]*$", re.IGNORECASE | re.MULTILINE
)
HINT = re.compile(r"copyright|\(c\)|©|all rights reserved", re.IGNORECASE)
PUNCTUATION = re.compile(r"[\W_]+")
VERSION = re.compile(r"v(?:ersion)?\.?(\d.*)")

#: Places are found by the first words of a known text.
ANCHOR = 8

#: Names that notices use, by SPDX identifier.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0"],
    "MIT": ["MIT License", "MIT license (MIT)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
NOTICES = ["licensed under {}", "released under {}", "distributed under {}", "available under {}", "published under {}", "licensed under the terms of {}"]

#: Whole licence texts without title and copyright line.
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted"""
ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""


UNLICENSE_TEXT = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: The GNU licences by SPDX identifier, name and version, and the words of their header.
GNU = [
    ("GPL-2.0", "GNU General Public License", "2"), ("GPL-3.0", "GNU General Public License", "3"),
    ("LGPL-2.0", "GNU Library General Public License", "2"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3"), ("AGPL-3.0", "GNU Affero General Public License", "3"),
]
GNU_HEADERS = [
    ("or-later", "under the terms of the {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version"),
    ("or-later", "under the terms of the {} version {} or later as published by the Free Software Foundation"),
    ("only", "under the terms of the {} version {} as published by the Free Software Foundation"),
    ("only", "under the terms of the {}, version {} only, as published by the Free Software Foundation"),
]


def known_texts() -> list[tuple[str, str, str]]:
    """(licence, kind, text): whole texts, headers, and the notices that the templates give for each name."""
    out = [
        ("MIT", "text", MIT_TEXT),
        ("ISC", "text", ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. " + ISC_DISCLAIMER),
        ("0BSD", "text", ISC_GRANT + ". " + ISC_DISCLAIMER),
        ("BSD-2-Clause", "text", "\n".join([BSD_HEAD, BSD_DISCLAIMER])),
        ("BSD-3-Clause", "text", "\n".join([BSD_HEAD, BSD_THIRD, BSD_DISCLAIMER])),
        ("Unlicense", "text", UNLICENSE_TEXT),
        ("Apache-2.0", "header", APACHE_HEADER),
    ]
    for spdx, name, version in GNU:
        out += [(f"{spdx}-{which}", "header", words.format(name, version)) for which, words in GNU_HEADERS]
        out += [(f"{spdx}-{which}", "notice", f"SPDX-License-Identifier: {spdx}-{which}") for which in ("only", "or-later")]
    for spdx, names in NAMES.items():
        out.append((spdx, "notice", f"SPDX-License-Identifier: {spdx}"))
        for name in names:
            for notice in NOTICES:
                out += [(spdx, "notice", notice.format(n)) for n in (name, f"the {name}", f"a {name}")]
    return out


@lru_cache(maxsize=1 << 18)
def canonical(word: str) -> tuple[str, int]:
    """(canonical word, code) of a word between white space; empty for the word "version" and for mere punctuation."""
    low = word.lower()
    bare = PUNCTUATION.sub("", low)
    bare = EQUIVALENT.get(bare, bare)
    versioned = VERSION.fullmatch(bare)
    bare = "" if bare == "version" else versioned[1] if versioned else bare
    return bare, xxhash.xxh64_intdigest(bare.encode("utf-8", "replace"))


def without_copyright(text: str) -> str:
    return COPYRIGHT.sub("", text) if HINT.search(text) else text


class Canonical:
    """The canonical words of a part of texts."""

    def __init__(self, texts: list[str]):
        words, at, counts = coded_words(pa.array([without_copyright(t) for t in texts], pa.large_string()))
        read = [canonical(w) for w in words]
        real = np.fromiter((bool(w) for w, _ in read), bool, len(read))[at]
        owner = np.repeat(np.arange(len(counts)), counts)[real]
        self.words, self.at, self.owner = [w for w, _ in read], at[real], owner
        self.counts = np.bincount(owner, minlength=len(counts))
        self.codes = np.fromiter((c for _, c in read), np.uint64, len(read))[self.at]

    def digest(self, first: int, width: int) -> str:
        return hashlib.sha256(" ".join(self.words[i] for i in self.at[first : first + width]).encode("utf-8", "replace")).hexdigest()


def known_row(name: str, kind: str, text: str) -> tuple[str, str, int, int, str] | None:
    """(licence, kind, canonical words, rolling hash of the first words, digest of all) of a known text; None without words."""
    read = Canonical([text])
    n = len(read.at)
    width = min(n, ANCHOR)
    return (name, kind, n, int(rolling(read.codes[:width], np.array([width]), width)[1][0]), read.digest(0, n)) if n else None


def known_rows(texts: list[tuple[str, str, str]] | None = None) -> list[tuple[str, str, int, int, str]]:
    """The rows of texts, by default of those in this module and of the long ones that are kept as digests only."""
    rows = [r for t in (known_texts() if texts is None else texts) if (r := known_row(*t))]
    return rows + ([(name, "text", n, begins, digest) for name, n, begins, digest in license_digests.WHOLE_TEXTS] if texts is None else [])


def scan(docs: DataFrame, known: list[tuple[str, str, str]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, kind, matches, whole) for each document and known licence text or notice in it.

    ``matches`` counts the places, places that begin or end together once; ``whole`` is true where the document's entire
    canonical text is the known one. Documents without any have no row. Null, empty and blank texts match nothing; a
    null id stays null; repeated rows of one id and text add up; an empty table or an empty list of known
    texts gives no rows. Ids keep their type, whatever it is. Other columns are not read. The list of known texts goes along with the tasks.
    """
    spark = docs.sparkSession
    # rolling hash of a text's first words -> lengths of the texts that begin so, by the number of these words
    anchors: dict[int, dict[int, set[int]]] = {}
    rows = {}
    for name, kind, n, begins, digest in known_rows(known):
        anchors.setdefault(min(n, ANCHOR), {}).setdefault(begins, set()).add(n)
        rows[digest] = (name, kind)
    table = spark.createDataFrame([(d, n, k) for d, (n, k) in sorted(rows.items())], "digest string, license string, kind string")
    wanted = {n: np.array(sorted(x), np.uint64) for n, x in anchors.items()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_rows = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, before = batch.column("doc_id"), seen_rows
            seen_rows += batch.num_rows
            for at, texts in text_parts(batch.column("text")):
                own = Canonical([t or "" for t in texts.to_pylist()])
                starts = np.cumsum(own.counts) - own.counts
                found = []
                for width, known_hashes in wanted.items():
                    first, seen = rolling(own.codes, own.counts, width)
                    place = np.minimum(np.searchsorted(known_hashes, seen), len(known_hashes) - 1)
                    hit = known_hashes[place] == seen
                    for f, h in zip(first[hit].tolist(), seen[hit].tolist()):
                        i = int(own.owner[f])
                        for n in anchors[width][h]:
                            stop = int(f + n - starts[i])
                            if stop <= own.counts[i]:
                                found.append((at + i, own.digest(f, n), stop - n, stop, n == own.counts[i]))
                if found:
                    rows, digests, begun, stops, whole = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(rows)), pa.array([before + r for r in rows], pa.int64()), pa.array(digests), pa.array(begun, pa.int64()), pa.array(stops, pa.int64()), pa.array(whole)],
                        ["doc_id", "row", "digest", "start", "stop", "whole"],
                    )

    texts = docs.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    places = texts.mapInArrow(find, f"doc_id {kind}, row long, digest string, start long, stop long, whole boolean").join(table, "digest")
    # a row's number, of its partition and place in it, and the end of the place tell the places of one document's rows apart
    # of those that begin together the longest is one place, and so are those that end together
    longest = places.groupBy("doc_id", "license", "row", "start").agg(F.max("whole").alias("whole"), F.min("kind").alias("kind"), F.max("stop").alias("stop"))
    ends = longest.groupBy("doc_id", "license", "row", "stop").agg(F.max("whole").alias("whole"), F.min("kind").alias("kind"))
    return ends.groupBy("doc_id", "license").agg(F.min("kind").alias("kind"), F.count("*").alias("matches"), F.max("whole").alias("whole"))
