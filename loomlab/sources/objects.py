"""Objects, media files, database tables and exported shards as DataFrames."""

from __future__ import annotations

import io
import logging
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlab.sources.samples import BATCH_BYTES, BATCH_ROWS, file_system, listed, spread

log = logging.getLogger(__name__)

# The media files of the lab.
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mkv", ".mov", ".webm")
LINE_BUFFER = 1 << 16
BLOCK_BYTES = 1 << 23
SOURCE_TYPES = ("huggingface", "s3", "postgres", "video", "audio")


def object_scan(spark: SparkSession, prefix: str, pattern: str | None = None, content: bool = True) -> DataFrame:
    """(key, bytes, data) of every object below a prefix; without content only metadata is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    columns = [F.col("path").alias("key"), F.col("length").alias("bytes")]
    return reader.load(prefix).select(*columns, *([F.col("content").alias("data")] if content else []))


def _glob(pattern: str) -> str:
    """The regular expression of a file name pattern with ``* ? [a-z] [!a] {a,b}`` and ``\\``, as Hadoop reads it."""
    out, at, inside, choices = "", 0, False, 0
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "\\" and at < len(pattern):
            out += re.escape(pattern[at])
            at += 1
        elif inside:
            out += "^" if c in "!^" and out.endswith("[") else "\\[" if c == "[" else c
            inside = c != "]"
        elif c == "[":
            out, inside = out + c, True
        elif c in "{}" or c == "," and choices:
            choices += {"{": 1, "}": -1, ",": 0}[c]
            out += {"{": "(?:", "}": ")", ",": "|"}[c]
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
    return f"(?s)/{out.replace('.*', '[^/]*')}$"


def _ranges(spark: SparkSession, prefix: str, pattern: str | None, range_bytes: int) -> DataFrame:
    """(key, bytes, offset) of the ranges of every object below a prefix, those of a block of ``BLOCK_BYTES`` one after the other in one task."""
    if re.search(r"[*?\[{]", prefix):
        found = object_scan(spark, prefix, pattern, content=False)
    else:
        found = listed(spark, prefix)
        found = found.where(F.col("key").rlike(_glob(pattern))) if pattern else found
    steps = lambda first, last, width: F.explode(F.sequence(first, last, F.lit(width).cast("long")))
    last, block = F.greatest(F.col("bytes") - 1, F.lit(0)).cast("long"), range_bytes * max(1, BLOCK_BYTES // range_bytes)
    blocks = spread(found.withColumn("block", steps(F.lit(0).cast("long"), last, block)), "key", "block")
    return blocks.withColumn("offset", steps(F.col("block"), F.least(F.col("block") + (block - 1), last), range_bytes)).drop("block")


def object_ranges(spark: SparkSession, prefix: str, pattern: str | None = None, range_bytes: int = 1 << 23) -> DataFrame:
    """(key, bytes, offset, data, error): every object below a prefix in ranges of at most ``range_bytes``.

    Tasks list the objects and deal the ranges; a task opens an object through the file system that its URI names, once for
    the ranges that follow each other, and holds one range, or short ones up to ``BATCH_BYTES``, so no object has to fit
    a row. What cannot be read is a row with the error.
    """
    kinds = pa.schema([("key", pa.string()), ("bytes", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source, held, size = None, None, [], 0
        for batch in batches:
            for row in batch.to_pylist():
                data, error = None, None
                try:
                    if row["key"] != opened:
                        if source is not None:
                            source.close()
                        opened, source = None, None
                        store, path = file_system(row["key"])
                        opened, source = row["key"], store.open_input_file(path)
                    data = source.read_at(min(range_bytes, max(row["bytes"] - row["offset"], 0)), row["offset"])
                except Exception as problem:  # a broken object must not end the job
                    error = f"{type(problem).__name__}: {problem}"
                held.append({**{k: row[k] for k in ("key", "bytes", "offset")}, "data": data, "error": error})
                size += len(data or b"")
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, kinds)
                    held, size = [], 0
        if source is not None:
            source.close()
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)

    return _ranges(spark, prefix, pattern, range_bytes).mapInArrow(read, "key string, bytes bigint, offset bigint, data binary, error string")


def object_lines(spark: SparkSession, prefix: str, pattern: str | None = None, range_bytes: int = 1 << 23) -> DataFrame:
    """(key, line, error): the lines of every object below a prefix, many tasks to an object.

    A task returns the lines that begin in its range and reads on for the end of the last one. What cannot be read is a row
    with the error, after the lines before it.
    """

    def lines(uri: str, start: int) -> Iterator[bytes]:
        store, path = file_system(uri)
        with store.open_input_file(path) as source:
            source.seek(max(start - 1, 0))
            text = io.BufferedReader(source, LINE_BUFFER)
            at = start if not start else start - 1 + len(text.readline())  # the line that goes on here is another task's
            while at < start + range_bytes and (line := text.readline()):
                at += len(line)
                yield line.rstrip(b"\r\n")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("key", pa.string()), ("line", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                found = lines(row["key"], row["offset"])
                try:
                    while held := list(islice(found, FRAMES_PER_BATCH)):
                        yield pa.RecordBatch.from_pydict({"key": [row["key"]] * len(held), "line": held, "error": [None] * len(held)}, kinds)
                except Exception as problem:  # a broken object must not end the job
                    yield pa.RecordBatch.from_pydict({"key": [row["key"]], "line": [None], "error": [f"{type(problem).__name__}: {problem}"]}, kinds)

    return _ranges(spark, prefix, pattern, range_bytes).mapInArrow(read, "key string, line binary, error string")


def media_files(spark: SparkSession, path: str, extensions=VIDEO_EXTENSIONS) -> DataFrame:
    """Media files below a path, by extension in any case; contents stay unread."""
    found = object_scan(spark, path, content=False)
    pattern = "(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"
    return found.where(F.lower("key").rlike(pattern)).select(F.col("key").alias("path"), F.col("bytes").alias("length"))


def discover_media(spark: SparkSession, sources: list[dict], extensions=VIDEO_EXTENSIONS) -> DataFrame:
    """Media files of all configured sources; unknown source types are skipped with a warning."""
    found = []
    for source in sources:
        kind = source.get("type", "local")
        if kind == "local":
            found.append(media_files(spark, source["path"], extensions))
        elif kind == "s3":
            found.append(media_files(spark, f"s3a://{source['bucket']}/{source.get('prefix', '')}", extensions))
        else:
            log.warning("unknown source type: %s", kind)
    if not found:
        return spark.createDataFrame([], "path string, length bigint")
    return reduce(lambda a, b: a.unionByName(b), found)


def jdbc_scan(
    spark: SparkSession,
    url: str,
    sql: str,
    batch_size: int = 1000,
    split: tuple[str, int, int, int] | None = None,
    **options: str,
) -> DataFrame:
    """Rows of a database query, fetched in batches; ``split`` = (column, low, high, parts) reads in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", str(batch_size)).options(**options)
    if split is None:
        return reader.option("query", sql).load()
    column, low, high, parts = split
    return (
        reader.option("dbtable", f"({sql}) q")
        .option("partitionColumn", column)
        .option("lowerBound", str(low))
        .option("upperBound", str(high))
        .option("numPartitions", str(parts))
        .load()
    )


def hub_scan(spark: SparkSession, path: str, split: str = "train", transform: Callable | None = None) -> DataFrame:
    """One split of exported Parquet shards; splits are partition folders, so others stay unread."""
    rows = spark.read.parquet(path).where(F.col("split") == split)
    return rows.transform(transform) if transform else rows


def open_source(spark: SparkSession, kind: str, batch_size: int | None = None, transform: Callable | None = None, **options) -> DataFrame:
    """A source by type. ``batch_size`` is the rows that a database source fetches at a time."""
    if kind not in SOURCE_TYPES:
        raise ValueError(f"Unknown source type: {kind}. Choose from {list(SOURCE_TYPES)}")
    if kind == "huggingface":
        rows = hub_scan(spark, options["name"], options.get("split", "train"))
    elif kind == "s3":
        base = options.get("path") or f"s3a://{options['bucket']}/{options.get('prefix', '')}"
        rows = object_ranges(spark, base, options.get("pattern"), options["range_bytes"]) if "range_bytes" in options else object_scan(spark, base, options.get("pattern"))
    elif kind == "postgres":
        rows = jdbc_scan(spark, options["db_url"], options["query"], options.get("fetch", batch_size or 1000), options.get("split"))
    else:
        rows = object_scan(spark, options["path"], options.get("pattern"))
        if "decoder" in options:
            rows = decode_keyframes(rows.select(F.col("key").alias("path"), F.col("data").alias("content")), options["decoder"])
    return rows.transform(transform) if transform else rows


FRAME_SCHEMA = "source string, pts bigint, frame binary, error string"
FRAMES_PER_BATCH = 512
Decoder = Callable[[bytes], Iterator[tuple[int, bool, bytes]]]


def decode_keyframes(files: DataFrame, decoder: Decoder) -> DataFrame:
    """Keyframes of each file (path, content) through a decoder of (pts, is key, pixels).

    A file that cannot be read gives a row with the error, after the keyframes read before it,
    instead of ending the job. Frames leave in small batches, so no file is held decoded.
    """

    def frame_rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for pts, key, frame in decoder(bytes(content)):
                if key:
                    yield path, pts, frame, None
        except Exception as problem:  # a broken file must not end the job
            yield path, None, None, str(problem)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = chain.from_iterable(map(frame_rows, batch["path"], batch["content"]))
            while held := list(islice(rows, FRAMES_PER_BATCH)):
                out = pd.DataFrame(held, columns=["source", "pts", "frame", "error"])
                out["pts"] = out["pts"].astype("Int64")
                yield out

    return files.select("path", "content").mapInPandas(decode, FRAME_SCHEMA)
