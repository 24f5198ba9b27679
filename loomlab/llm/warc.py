"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record with an index of offsets.

A monolithic archive is one gzip stream, so that nothing in it can be read without inflating all before it. The
normaliser inflates such a stream once, from its start to its end, cuts it into records by their declared lengths, and
writes each record again as a gzip member of its own. Beside the new archive it writes ``<archive>.index``, a JSON line
per record with the offset and length of its member, so that a record is read by one seek. An inflated stream is never
held: a record's bytes go from the one compressor to the other in chunks.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlab.llm.common import stored
from loomlab.llm.files import one_task_each, place
from loomlab.session import qualified, scratch

CHUNK = 1 << 18
#: Bytes of one record that a task holds before it spools to the task's own disk.
SPOOL = 1 << 24
#: A header block beyond this is not one.
MOST_HEADER = 1 << 20
GZIP = 31  # zlib's window bits for a gzip wrapper
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "archive string, place long, records long"
NORMALISED = "source string, place long, archive string, records long, fault string"
READ = (
    "archive string, offset long, length long, type string, record_id string, target_uri string, "
    "payload_bytes long, payload_digest string, refers_to string"
)


def digest(data: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str | None) -> str:
    return f"<urn:page:{quote(key, safe='')}>" if key is not None else "<urn:no-page>"


def key_of(identifier: str | None) -> str | None:
    """The key in a record id of :func:`record_id`."""
    found = re.fullmatch(r"<urn:page:(.*)>", identifier or "")
    return unquote(found[1]) if found else None


def block(kind: str, fields: list[tuple[str, str]], content_type: str, body: list[bytes]) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields), f"Content-Type: {content_type}", f"Content-Length: {sum(map(len, body))}"]
    return b"".join(["\r\n".join(head).encode(), b"\r\n\r\n", *body, b"\r\n\r\n"])


def page_record(key: str | None, uri: str | None, payload: bytes, refers: str | None, revisit: bool, date: str) -> bytes:
    """A response with the payload, or a revisit with the response's HTTP header alone."""
    sha = f"sha1:{digest(payload)}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Record-ID", record_id(key)), ("WARC-Date", date)]
    if uri:  # a URI has neither white space nor control characters
        fields.append(("WARC-Target-URI", quote(uri, safe="%!*'();:@&=+$,/?#[]~-._")))
    fields.append(("WARC-Payload-Digest", sha))
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers))]
    return block("revisit" if revisit else "response", fields, "application/http; msgtype=response", [http] if revisit else [http, payload])


class Fault(ValueError):
    """A stream that breaks off or doesn't follow the format; what was read before it stands."""


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, in chunks; zeros behind the last one are padding."""
    inflate, begun = zlib.decompressobj(GZIP), False
    while data := source.read(CHUNK):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):
                break
            begun = True
            try:
                out = inflate.decompress(data, CHUNK)
            except zlib.error as problem:
                raise Fault(f"gzip: {problem}") from problem
            if out:
                yield out
            if inflate.eof:
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(GZIP), False
            else:
                data = inflate.unconsumed_tail
    if begun:  # what the last input held back
        if out := inflate.flush():
            yield out
        if not inflate.eof:
            raise Fault("gzip: the stream breaks off")


class Stream:
    """Bytes taken from chunks, a bounded number at a time."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, b"", 0

    def more(self) -> bool:
        data = next(self.chunks, None)
        if data is None:
            return False
        self.held, self.at = self.held[self.at :] + data, 0
        return True

    def head(self) -> bytes | None:
        """The next block up to its blank line, line ends between records skipped; None at the end."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.held):
                break
            if not self.more():
                return None
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if len(self.held) - self.at > MOST_HEADER or not self.more():
                raise Fault("a record's header doesn't end")
        out, self.at = self.held[self.at : end + 4], end + 4
        return out

    def body(self, size: int) -> Iterator[bytes]:
        while size:
            if self.at == len(self.held) and not self.more():
                raise Fault("a record breaks off")
            part = self.held[self.at : self.at + min(size, CHUNK)]
            self.at += len(part)
            size -= len(part)
            yield part


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's header, names in lower case; folded lines are joined."""
    first, _, rest = head.decode("utf-8", "replace").partition("\r\n")
    if not first.startswith("WARC/"):
        raise Fault("a record doesn't begin with its version")
    pairs = (line.partition(":") for line in re.sub(r"\r\n[ \t]+", " ", rest).split("\r\n") if line)
    found = {k.strip().lower(): v.strip() for k, _, v in pairs}
    if not re.fullmatch(r"\d+", found.get("content-length", "")):
        raise Fault("a record has no length")
    return found


def normalise_stream(source: BinaryIO, out, index) -> tuple[int, str | None]:
    """Rewrites ``source`` record by record; ``(records, fault)``. A record that breaks off is not written."""
    stream, offset, records = Stream(inflated(source)), 0, 0
    try:
        while (head := stream.head()) is not None:
            named = fields(head)
            deflate = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            with tempfile.SpooledTemporaryFile(SPOOL) as member:
                member.write(deflate.compress(head))
                for part in stream.body(int(named["content-length"])):
                    member.write(deflate.compress(part))
                member.write(deflate.compress(b"\r\n\r\n"))
                member.write(deflate.flush())
                length = member.tell()
                member.seek(0)
                while part := member.read(CHUNK):
                    out.write(part)
            line = {"offset": offset, "length": length, "type": named.get("warc-type"), "record_id": named.get("warc-record-id")}
            line |= {"target_uri": named.get("warc-target-uri"), "digest": named.get("warc-payload-digest"), "refers_to": named.get("warc-refers-to")}
            index.write(json.dumps(line, ensure_ascii=False).encode() + b"\n")
            offset += length
            records += 1
    except Fault as problem:
        return records, str(problem)
    return records, None


def index_lines(source: BinaryIO) -> Iterator[dict]:
    left = b""
    while data := source.read(CHUNK):
        *lines, left = (left + data).split(b"\n")
        yield from map(json.loads, lines)


def read_member(archive, offset: int, length: int) -> tuple[dict[str, str], bytes, int, str]:
    """``(fields, HTTP header, bytes of the payload, its SHA-1 in base32)`` of the record in one member."""
    archive.seek(offset)
    left, chunks = [length], []

    class Member:
        def read(self, n: int) -> bytes:
            data = archive.read(min(n, left[0]))
            left[0] -= len(data)
            return data

    stream = Stream(inflated(Member()))
    named = fields(stream.head() or b"")
    size = int(named["content-length"])
    http = b""
    if named.get("content-type", "").startswith("application/http"):
        http = stream.head() or b""
    sha, rest = hashlib.sha1(), size - len(http)
    for part in stream.body(rest):
        sha.update(part)
    return named, http, rest, base64.b32encode(sha.digest()).decode()


def write_monolithic(records: DataFrame, folder: str, archive_bytes: int, date: str) -> DataFrame:
    """Writes ``(key, uri, payload, refers, revisit)`` rows as archives of one gzip stream; the stored list of them.

    Each task writes its rows as they come and begins another archive behind ``archive_bytes`` bytes of records. The
    list names only the files of attempts that ended well.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = place(folder)
        files.create_dir(inner, recursive=True)
        held: dict = {}

        def begin() -> None:
            held.update(name=uuid.uuid4().hex, deflate=zlib.compressobj(6, zlib.DEFLATED, GZIP), records=0, bytes=0)
            held["out"] = files.open_output_stream(f"{inner}/{held['name']}.whole.warc.gz", compression=None)
            held["out"].write(held["deflate"].compress(block("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)], "application/warc-fields", [b"format: WARC File Format 1.1\r\n"])))

        def end() -> pa.RecordBatch:
            held["out"].write(held["deflate"].flush())
            held["out"].close()
            row = {"archive": [f"{folder}/{held['name']}.whole.warc.gz"], "place": [int(held["name"][:15], 16)], "records": [held["records"]]}
            held.clear()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for row in batch.slice(i, 64).to_pylist():
                    if not held:
                        begin()
                    data = page_record(row["key"], row["uri"], row["payload"].encode(), row["refers"], row["revisit"], date)
                    held["out"].write(held["deflate"].compress(data))
                    held["records"] += 1
                    held["bytes"] += len(data)
                    if held["bytes"] >= archive_bytes:
                        yield end()
        if held:
            yield end()

    return stored(records.mapInArrow(write, WRITTEN), "warc-written")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each ``(archive, place)`` of a list as an archive of one member per record, with its index.

    ``place`` is any number to deal the archives out by. The stored result has a row per archive: the new archive
    (its index is ``<archive>.index``), the records in it, and ``fault``: null, or why the stream could not be read to
    its end; the records before that point are kept. Streams of several members and zeros behind the last one are read
    as well, so an archive that is normal already comes out the same.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, inner = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                files.create_dir(inner, recursive=True)
                name = f"{uuid.uuid4().hex}.warc.gz"
                there, path = place(row["archive"])
                with (
                    there.open_input_stream(path, compression=None) as source,
                    files.open_output_stream(f"{inner}/{name}", compression=None) as out,
                    files.open_output_stream(f"{inner}/{name}.index", compression=None) as index,
                ):
                    records, fault = normalise_stream(source, out, index)
                yield pa.RecordBatch.from_pylist(
                    [{"source": row["archive"], "place": row["place"], "archive": f"{folder}/{name}", "records": records, "fault": fault}],
                    pa.schema([("source", pa.string()), ("place", pa.int64()), ("archive", pa.string()), ("records", pa.int64()), ("fault", pa.string())]),
                )

    return stored(one_task_each(archives.select("archive", "place"), "place").mapInArrow(rewrite, NORMALISED), "warc-normalised")


def read_back(normalised: DataFrame) -> DataFrame:
    """A row per response and revisit of the listed archives, each read by its offset alone.

    ``payload_bytes`` and ``payload_digest`` are counted from a response's payload, which has to agree with its header;
    those of a revisit, which has no payload, are what its headers say of the payload it stands for. ``refers_to`` is
    the id of the record that a revisit names.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = pa.schema([(n, pa.int64() if n in ("offset", "length", "payload_bytes") else pa.string()) for n in names])
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                files, path = place(uri)
                rows: list[dict] = []
                with files.open_input_file(path) as archive, files.open_input_stream(f"{path}.index", compression=None) as index:
                    for line in index_lines(index):
                        if line["type"] not in ("response", "revisit"):
                            continue
                        named, http, size, found = read_member(archive, line["offset"], line["length"])
                        told = named.get("warc-payload-digest", "").removeprefix("sha1:")
                        if line["type"] == "revisit":
                            length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                            size, found = int(length[1]) if length else None, told or None
                        elif told and told != found:
                            raise ValueError(f"{uri} at {line['offset']}: the payload is not that of its digest")
                        row = {"archive": uri, "offset": line["offset"], "length": line["length"], "type": line["type"], "record_id": named.get("warc-record-id"), "target_uri": named.get("warc-target-uri")}
                        rows.append(row | {"payload_bytes": size, "payload_digest": found, "refers_to": named.get("warc-refers-to")})
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, kinds)

    return one_task_each(normalised.select("archive", "place"), "place").mapInArrow(read, READ)


def with_revisits(pages: DataFrame, page_id: str, url: str, html: str, least_bytes: int) -> DataFrame:
    """``(key, uri, payload, refers, revisit)`` of each page: later pages with a payload revisit its smallest id.

    Payloads are compared by SHA-1, length and a second hash. Only payloads that occur twice or more are joined back, so
    the pages themselves are not shuffled while those are few enough to be sent along, and a payload of very many pages is
    one row of the smaller side.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").cast("string").alias("uri"), payload.alias("payload"))
    keys = ["sha", "size", "hash"]
    rows = rows.withColumns({"sha": F.sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload"), "hash": F.xxhash64("payload")})
    several = rows.groupBy(*keys).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    several = several.where((F.col("n") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull()).drop("n")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    return rows.join(several, keys, "left").select(
        F.col("id").cast("string").alias("key"), "uri", "payload", F.when(revisit, F.col("first").cast("string")).alias("refers"), revisit.alias("revisit")
    )


def archive(
    pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, archive_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Writes a record per row of ``pages``, normalises the archives, and returns what they say about each record.

    Columns: the id, under its own name and type, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``,
    ``target_uri``, ``archive``, ``offset`` and ``length``. Of rows with equal payloads of at least ``least_bytes``
    bytes that with the smallest id is the response and the others revisit it. A null payload is an empty one. A row
    with a null id revisits a payload that an id has, and else is a response with a null id; rows that repeat the id and
    the payload of a response are responses too. A null or empty URL is left out of its record; characters that a URI
    cannot hold are percent-encoded. Other columns are not read. An empty table writes no archive and gives no rows.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or scratch(spark, "warc"))
    written = write_monolithic(with_revisits(pages, page_id, url, html, least_bytes), folder, archive_bytes, date)
    found = read_back(normalise(written, folder))
    kind = pages.schema[page_id].dataType
    key = lambda column: F.when(column != F.lit("<urn:no-page>"), F.url_decode(F.regexp_replace(F.regexp_extract(column, "^<urn:page:(.*)>$", 1), r"\+", "%2B")))
    return found.select(
        key(F.col("record_id")).cast(kind).alias(page_id), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        key(F.col("refers_to")).cast(kind).alias("refers_to"), "target_uri", "archive", "offset", "length",
    )
