import gzip
import hashlib
import base64
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomlab.llm import warc

PAGES = "page_id long, url string, html string"


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None:
            h = h or ""
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        told = first.get(h or "")
        revisit = told is not None and told != i and len(data) >= least
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), sha, "revisit" if revisit else "response", told if revisit else None))
    return sorted(out, key=str)


def rows_of(found):
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in found.collect()), key=str)


def sample():
    rng = random.Random(3)
    bits = ["<p>é</p>", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 5\r\n\r\n", "日本", "x" * 500, "\0", "😀"]
    rows = [(i, f"http://a.b/{i}?q=é ü\n%41", "".join(rng.choices(bits, k=rng.randint(0, 9)))) for i in range(150)]
    rows += [(200 + i, None, "same page") for i in range(60)] + [(-5, "", "same page"), (300, "u", None), (301, "u", ""), (302, "u", None)]
    return rows + [(None, "no id", "same page"), (None, "no id", "only without an id"), (400, "u", "again"), (400, "u", "again"), (401, "long", "long word " * 600_000)]


def test_records_round_trip_through_monolithic_and_normal_archives(spark, tmp_path):
    rows = sample()
    pages = spark.createDataFrame(rows, PAGES).withColumn("offset", F.lit("clash")).withColumn("sha", F.lit(1)).repartition(7)
    found = warc.archive(pages, f"{tmp_path}/out", archive_bytes=300_000)
    assert rows_of(found) == expected(rows)
    for r in found.where("record_type = 'response' and page_id >= 0 and page_id < 150").collect():
        files, path = warc.place(r["archive"])
        with files.open_input_file(path) as f:
            f.seek(r["offset"])
            member = f.read(r["length"])
        text = gzip.decompress(member)  # one whole member, and nothing else
        assert text.endswith(("".join(dict((i, h) for i, _, h in rows)[r["page_id"]]).encode()) + b"\r\n\r\n")


def test_least_bytes_and_string_ids(spark, tmp_path):
    rows = [("a b%+/é", "u", "tiny"), ("c", "u", "tiny"), ("d", "u", "larger page"), ("e>", "u", "larger page")]
    found = warc.archive(spark.createDataFrame(rows, "id string, url string, body string"), f"{tmp_path}/o", page_id="id", html="body", least_bytes=5)
    got = {r["id"]: (r["record_type"], r["refers_to"]) for r in found.collect()}
    assert got == {"a b%+/é": ("response", None), "c": ("response", None), "d": ("response", None), "e>": ("revisit", "d")}


def test_empty_table(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], PAGES), f"{tmp_path}/e").collect() == []


def normalised(data):
    out, index = io.BytesIO(), io.BytesIO()
    records, fault = warc.normalise_stream(io.BytesIO(data), out, index)
    lines = list(warc.index_lines(io.BytesIO(index.getvalue())))
    return records, fault, out.getvalue(), lines


def records(n):
    return [warc.page_record(str(i), "http://x/", bytes([i % 251]) * (i * 977 % 70_000), None, False, "1970-01-01T00:00:00Z") for i in range(n)]


@pytest.mark.parametrize("chunk", [1, 7, 4096, 1 << 18])
def test_normaliser_equals_records(monkeypatch, chunk):
    some = records(25)
    monkeypatch.setattr(warc, "CHUNK", chunk)
    for data in (gzip.compress(b"".join(some)), b"".join(map(gzip.compress, some)), gzip.compress(b"".join(some[:9])) + gzip.compress(b"".join(some[9:])) + bytes(1000)):
        n, fault, out, lines = normalised(data)
        assert (n, fault) == (25, None)
        assert [gzip.decompress(out[x["offset"] : x["offset"] + x["length"]]) for x in lines] == some
        assert sum(x["length"] for x in lines) == len(out)


def test_a_stream_that_breaks_off_keeps_what_came_before():
    some = records(25)
    whole = gzip.compress(b"".join(some))
    n, fault, out, lines = normalised(whole[: len(whole) // 2])
    assert 0 < n < 25 and "breaks off" in fault and gzip.decompress(out) == b"".join(some[:n])
    n, fault, out, _ = normalised(gzip.compress(b"".join(some[:3]) + some[3][:-200]))
    assert n == 3 and fault and gzip.decompress(out) == b"".join(some[:3])
    assert normalised(gzip.compress(some[0] + b"rubbish\r\n\r\n"))[:2] == (1, "a record doesn't begin with its version")
    assert normalised(gzip.compress(some[0]) + b"not gzip")[:1] == (1,)
    assert normalised(b"")[:2] == (0, None)


def test_a_broken_archive_is_a_row(spark, tmp_path):
    good, bad = tmp_path / "good.warc.gz", tmp_path / "bad.warc.gz"
    good.write_bytes(gzip.compress(b"".join(records(5))))
    bad.write_bytes(gzip.compress(b"".join(records(5)))[:-400])
    listed = spark.createDataFrame([(f"file://{good}", 0), (f"file://{bad}", 1)], "archive string, place long")
    found = {r["place"]: r for r in warc.normalise(listed, f"file://{tmp_path}/n").collect()}
    assert found[0]["records"] == 5 and found[0]["fault"] is None
    assert found[1]["records"] < 5 and found[1]["fault"]


def test_inflating_holds_chunks_only():
    data = gzip.compress(bytes(1 << 26))
    assert max(map(len, warc.inflated(io.BytesIO(data)))) <= warc.CHUNK
    assert zlib.crc32(b"".join(warc.inflated(io.BytesIO(data)))) == zlib.crc32(bytes(1 << 26))
