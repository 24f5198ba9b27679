"""Exported samples: caption files with optional sidecars, record tables and tar shards."""

from __future__ import annotations

import io
import json
import os
import re
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlab.operators.ordered import global_index, running
from loomlab.session import materialize, qualified

# Names and defaults of the exported files.
SIDECAR_SUFFIX = ".audio.json"
SHARD_FORMAT = "shard-%06d.tar"
SAMPLES_PER_SHARD = 1000
EXPORT_FPS = 24
EXPORT_RESOLUTION = (256, 256)
EXPORT_AUDIO_RATE = 16000
# What a task hands on at once of the files it reads.
BATCH_BYTES = 1 << 20
BATCH_ROWS = 512
LISTED_ROWS = 10_000
# Fixed value: subfolders of sample files.
FOLDERS = 256

CAPTION = "clip_id string, visual string, audio string, speech string, duration_seconds double, fps int"
# Characters that a URI holds by their code only.
UNSAFE = re.compile(r"[\s\x00-\x20\x7f-\xa0\"#%<>?\[\\\]^`{|}]")
SIDECAR = "audio_tokens array<array<int>>, codec string, num_codebooks int"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, text) of listed JSON files, names as in a URI, in batches of bounded size.

    Files without a value are left out; bytes that are no text become text that is no JSON.
    """
    held, size = [], 0
    one = lambda: pa.RecordBatch.from_pydict({"name": pa.array([n for n, _ in held], pa.string()), "text": pa.array([t for _, t in held], pa.string())})
    for batch in batches:
        for key in batch.column("key").to_pylist():
            store, path = file_system(key)
            with store.open_input_file(path) as source:
                data = source.read()
            try:
                text = data.decode(json.detect_encoding(data))
            except UnicodeDecodeError:
                text = "?"
            if text.strip(" \t\r\n"):
                held.append((UNSAFE.sub(lambda c: quote(c[0]), key.rpartition("/")[2]), text))
                size += len(data)
            if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                yield one()
                held, size = [], 0
    if held:
        yield one()


def _json_files(spark: SparkSession, folder: str, suffix: str, schema: str, but: str | None = None) -> DataFrame:
    """The values of the JSON files below a folder whose names end in ``suffix``, and not in ``but``, with their stem.

    Tasks list the subfolders and open the files. A file is an object or an array of them; one that is neither is a row
    of nulls, an empty one no row. The rows are stored: a join or a sort would open each file anew, and the size of
    what tasks read is not known before.
    """
    files = listed(spark, folder).where(F.endswith("key", F.lit(suffix)))
    files = files.where(~F.endswith("key", F.lit(but))) if but else files
    texts = spread(files.select("key"), "key").mapInArrow(_texts, "name string, text string")
    kind = T.ArrayType(T.StructType.fromDDL(schema))
    values = F.from_json("text", kind)
    values = F.when(~F.exists(values, lambda v: v.isNull()), values)
    stem = F.regexp_replace("name", suffix.replace(".", r"\.") + "$", "")
    rows = texts.select(F.explode(F.coalesce(values, F.array(F.lit(None).cast(kind.elementType)))).alias("value"), stem.alias("stem"))
    return materialize(spark, rows.select("value.*", "stem"), "json-files")


def read_captions(spark: SparkSession, folder: str, schema: str = CAPTION) -> DataFrame:
    """Caption files below a folder with their stem; sidecar files are not captions."""
    return _json_files(spark, folder, ".json", schema, but=SIDECAR_SUFFIX)


def read_sidecars(spark: SparkSession, folder: str, schema: str = SIDECAR) -> DataFrame:
    return _json_files(spark, folder, SIDECAR_SUFFIX, schema)


def with_sidecar(samples: DataFrame, sidecars: DataFrame, key: str) -> DataFrame:
    """Every sample with its sidecar columns if it has one, ordered by name."""
    return samples.join(sidecars, key, "left").orderBy(key)


def publish_records(samples: DataFrame, sidecar_columns: list[str], has_sidecar) -> DataFrame:
    """Flat record table with defaults; codec columns only where there is a sidecar."""
    return samples.select(
        "clip_id",
        F.coalesce("visual", F.lit("")).alias("visual_caption"),
        F.coalesce("audio", F.lit("")).alias("audio_label"),
        F.coalesce("speech", F.lit("")).alias("speech_transcript"),
        F.coalesce("duration_seconds", F.lit(0.0)).alias("duration_seconds"),
        F.coalesce("fps", F.lit(EXPORT_FPS)).alias("fps"),
        *[F.when(has_sidecar, F.col(c)).alias(c) for c in sidecar_columns],
    )


def write_records(records: DataFrame, path: str, rows_per_file: int | None = None, shard_bytes: int | None = None, order: str | None = None) -> None:
    """Parquet shards of bounded size; an empty table is an error, found by counting what was written.

    Either a file has at most ``rows_per_file`` rows, or, in folders ``shard=n`` in the sequence of the integer key
    ``order``, rows of at most ``shard_bytes`` bytes as JSON, the size that a reader has to hold.
    """
    seen = Observation("records")
    counted = lambda rows: rows.observe(seen, F.count(F.lit(1)).alias("n"))
    if shard_bytes is None:
        counted(records).write.option("maxRecordsPerFile", rows_per_file or 0).parquet(path)
    else:
        size = F.octet_length(F.to_json(F.struct(*records.columns)))
        placed = counted(shards_of_bytes(records, order, size, shard_bytes))
        placed.repartition("shard").sortWithinPartitions("shard", order).drop("shard_name").write.partitionBy("shard").parquet(path)
    if not seen.get["n"]:
        raise ValueError("no samples to publish")


def export_captions(captions: DataFrame, fps: int = EXPORT_FPS, resolution=EXPORT_RESOLUTION, audio_rate: int = EXPORT_AUDIO_RATE) -> DataFrame:
    """Captions with the export settings added."""
    return captions.withColumns(
        {
            "fps": F.lit(fps),
            "resolution": F.array(*[F.lit(v) for v in resolution]),
            "audio_sample_rate": F.lit(audio_rate),
        }
    )


def json_stream(spark: SparkSession, folder: str, schema: T.StructType | str, streaming: bool = False) -> DataFrame:
    """The JSON files of a folder, as a batch or as a stream of arriving files."""
    reader = spark.readStream.option("maxFilesPerTrigger", "1000") if streaming else spark.read
    return reader.schema(schema).option("pathGlobFilter", "*.json").json(folder)


# tar shards ----------------------------------------------------------------------------------


def assign_shards(samples: DataFrame, order: str, per_shard: int = SAMPLES_PER_SHARD, width: int | None = None) -> DataFrame:
    """Shard number and name of each sample, counted over all samples in key order."""
    shard = F.expr(f"_index div {per_shard}")
    placed = global_index(samples, order, "_index", width).withColumn("shard", shard)
    return placed.withColumn("shard_name", F.format_string(SHARD_FORMAT, F.col("shard"))).drop("_index")


def shards_of_bytes(samples: DataFrame, order: str, size: Column, shard_bytes: int) -> DataFrame:
    """Shard number and name of each sample, in key order, such that no shard's sizes add up to more than ``shard_bytes``.

    A running sum of bytes is cut at even steps. A shard can begin with the end of a sample that the step before it
    cut through, so a step is shorter than a shard by the largest sample. Numbers without samples are left out.
    """
    sized = samples.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long"))
    largest = sized.agg(F.max("_size").alias("m")).first()["m"] or 0
    if largest > shard_bytes // 2:
        raise ValueError(f"a sample of {largest} bytes in shards of {shard_bytes}: a shard has to hold two of the largest")
    step = shard_bytes - largest
    placed = running(sized, [], order, {"_upto": ("sum", F.col("_size"))}, measure=samples.select(order))
    placed = placed.withColumn("shard", F.expr(f"greatest(_upto - 1, 0L) div {step}L"))
    return placed.withColumn("shard_name", F.format_string(SHARD_FORMAT, F.col("shard"))).drop("_size", "_upto")


def shard_summary(placed: DataFrame, order: str) -> DataFrame:
    return placed.groupBy("shard", "shard_name").agg(
        F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last")
    )


def file_system(uri: str):
    """The file system of a URI and the path within it; ``s3a`` and ``s3n`` are names of ``s3``."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def spread(rows: DataFrame, *keys: str | Column) -> DataFrame:
    """Short rows that stand for much work, dealt to a number of tasks: adaptive execution would join those by the rows' size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out as well."""
    kept = name.startswith(("_common_metadata", "_metadata"))
    return not kept and (name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name)


def _rooted(spark: SparkSession, folder: str) -> str:
    """``folder`` as the URI that Spark's readers give it; nothing is written, as a source may be read only."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", folder):
        local = spark.sparkContext.master.startswith("local")
        base = "file:" if local else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/")
        folder = base + os.path.abspath(folder)
    return re.sub(r"^file:/*", "file:/", folder).rstrip("/")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(key, bytes) of the files below a folder, or of the one file, listed by tasks: one lists the folder, many its subfolders.

    Nothing of the list is on the driver. Hidden files are left out, as in Spark's readers.
    """
    root = _rooted(spark, folder)

    def found(uri: str, deep: bool) -> Iterator[pa.RecordBatch]:
        left = [uri]
        while left:
            at = left.pop()
            store, path = file_system(at)
            infos = store.get_file_info(fs.FileSelector(path))
            infos = [i for i in infos if not _hidden(i.base_name)]
            if deep:
                left += [f"{at}/{i.base_name}" for i in infos if i.type == fs.FileType.Directory]
                infos = [i for i in infos if i.type != fs.FileType.Directory]
            for start in range(0, len(infos), LISTED_ROWS):
                some = infos[start : start + LISTED_ROWS]
                yield batch_of([f"{at}/{i.base_name}" for i in some], [i.size for i in some])

    def batch_of(keys: list[str], sizes: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "bytes": pa.array(sizes, pa.int64())})

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _ in range(batch.num_rows):
                store, path = file_system(root)
                info = store.get_file_info(path)
                if info.type == fs.FileType.NotFound:
                    raise FileNotFoundError(root)
                if info.type == fs.FileType.File:
                    yield batch_of([root], [info.size])
                else:
                    yield from found(root, deep=False)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(batch.column("bytes").is_valid())
            for uri in batch.filter(batch.column("bytes").is_null()).column("key").to_pylist():
                yield from found(uri, deep=True)

    kind = "key string, bytes bigint"
    return spread(spark.range(1).mapInArrow(top, kind), "key").mapInArrow(below, kind)


def _bytes(value) -> bytes:
    return value.encode() if isinstance(value, str) else bytes(value)


def write_tar_shards(placed: DataFrame, order: str, files: dict[str, str], folder: str) -> DataFrame:
    """Write one tar per shard into a shared folder; returns (shard_name, n, bytes), bytes those of the members.

    ``files`` maps a file suffix to the text or binary column it holds. Rows come sorted by shard, and a task appends
    them to the open tar as they come, so it holds one Arrow batch (``spark.sql.execution.arrow.maxRecordsPerBatch`` rows)
    and never a shard. Each attempt writes drafts of its own and moves them into place, so a lost or repeated task
    leaves whole shards only.
    """
    folder = qualified(placed.sparkSession, folder)
    kept = list(dict.fromkeys(["shard_name", order, *files.values()]))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        name, n, size, draft, sink, tar = None, 0, 0, None, None, None

        def close() -> pa.RecordBatch:
            tar.close()
            sink.close()
            store.move(draft, f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"shard_name": [name], "n": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard_name"] != name:
                    if name is not None:
                        yield close()
                    name, n, size = row["shard_name"], 0, 0
                    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
                    sink = store.open_output_stream(draft)
                    tar = tarfile.open(fileobj=sink, mode="w|")
                for suffix, column in files.items():
                    if row[column] is not None:
                        data = _bytes(row[column])
                        info = tarfile.TarInfo(f"{row[order]}{suffix}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
                        size += len(data)
                n += 1
        if name is not None:
            yield close()

    rows = placed.select(*kept).repartition("shard_name").sortWithinPartitions("shard_name", order)
    return rows.mapInArrow(write, "shard_name string, n bigint, bytes bigint")


def read_tar_shards(shards: DataFrame, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(shard_name, member, data) of the members of each listed shard, with the columns ``keep`` of the list.

    A task reads whole shards, member by member. What the list knows of a shard goes along: a join of the members with the
    list would take them for as small as their names, and broadcast them.
    """
    folder = qualified(shards.sparkSession, folder)
    fields = [T.StructField("shard_name", T.StringType()), T.StructField("member", T.StringType()), T.StructField("data", T.BinaryType())]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)

        def some(batch: pa.RecordBatch, i: int, members: list[str], data: list[bytes]) -> pa.RecordBatch:
            listed = {c: batch.column(c).take(pa.array([i] * len(members), pa.int64())) for c in ("shard_name", *keep)}
            return pa.RecordBatch.from_pydict({"shard_name": listed["shard_name"], "member": pa.array(members, pa.string()), "data": pa.array(data, pa.binary()), **{c: listed[c] for c in keep}})

        for batch in batches:
            for i, name in enumerate(batch.column("shard_name").to_pylist()):
                with store.open_input_stream(f"{base}/{name}") as source, tarfile.open(fileobj=source, mode="r|") as tar:
                    members, data, size = [], [], 0
                    for member in tar:
                        members.append(member.name)
                        data.append(tar.extractfile(member).read())
                        tar.members.clear()  # it would remember every member
                        size += member.size
                        if size >= BATCH_BYTES or len(members) >= BATCH_ROWS:
                            yield some(batch, i, members, data)
                            members, data, size = [], [], 0
                    if members:
                        yield some(batch, i, members, data)

    schema = T.StructType([*fields, *[shards.schema[c] for c in keep]])
    return spread(shards.select("shard_name", *keep), "shard_name").mapInArrow(read, schema)


def write_sample_files(samples: DataFrame, name: str, files: dict[str, str], folder: str) -> int:
    """Writes a file ``<name><suffix>`` per sample and suffix whose column has a value; returns how many.

    The files lie in ``FOLDERS`` subfolders, by a checksum of their name: tasks that make files in one folder wait for each
    other, and one task has to list it.
    """
    folder = qualified(samples.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        made = set()
        for batch in batches:
            written = 0
            for row in batch.to_pylist():
                at = f"{base}/{zlib.crc32(str(row[name]).encode()) % FOLDERS:03x}"
                for suffix, column in files.items():
                    if row[column] is not None:
                        if at not in made:
                            store.create_dir(at, recursive=True)
                            made.add(at)
                        with store.open_output_stream(f"{at}/{row[name]}{suffix}") as out:
                            out.write(_bytes(row[column]))
                        written += 1
            yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

    done = samples.select(*dict.fromkeys([name, *files.values()])).mapInArrow(write, "n bigint")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]


def iterate_tar(path: str) -> Iterator[tuple[str, bytes]]:
    """Members of one shard, for checks."""
    with tarfile.open(path) as tar:
        for member in tar:
            yield member.name, tar.extractfile(member).read()
