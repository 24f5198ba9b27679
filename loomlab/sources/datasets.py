"""Tabular datasets: catalog lookup, reading and writing in four formats."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

TABULAR = ("csv", "parquet", "json", "jsonl")


def find_dataset(catalog: DataFrame, name_or_id: str) -> dict:
    """The first catalog row, in list order, with that name or id."""
    hit = catalog.where((F.col("name") == name_or_id) | (F.col("id") == name_or_id)).orderBy("position").first()
    if hit is None:
        raise ValueError(f"Dataset {name_or_id!r} not found")
    return hit.asDict()


def files_by_lines(spark: SparkSession, path: str, whole) -> tuple[list[str], list[str]]:
    """(files whose every line stands alone, other files) below ``path``: one parallel aggregate over the lines of text.

    ``whole`` says of a line (a column) whether it can be read without its neighbors. The driver holds the file names,
    as it does for any scan.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), whole(F.col("value")).alias("whole"))
    found = lines.groupBy("file").agg(F.min("whole").alias("whole")).collect()
    return sorted(r["file"] for r in found if r["whole"]), sorted(r["file"] for r in found if not r["whole"])


def csv_line(line: Column) -> Column:
    """No cell goes on in the next line: quotes, doubled ones too, come in pairs."""
    return (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 0


def json_line(line: Column) -> Column:
    """Blank, or a whole value."""
    return (F.trim(line, F.lit(" \t\r\n")) == "") | F.try_parse_json(line).isNotNull()


def read_by_lines(spark: SparkSession, path: str, whole, read) -> DataFrame:
    """``read(paths, multi_line)`` over the files below ``path``: those of whole lines are split among tasks, others are not."""
    alone, joined = files_by_lines(spark, path, whole)
    parts = [read(files, multi_line) for files, multi_line in ((alone, False), (joined, True)) if files]
    if not parts:  # files without a line
        return read([path], False)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def read_dataset(spark: SparkSession, path: str, fmt: str, schema=None) -> DataFrame | str:
    """A lazy scan; formats that are not tabular come back as their path.

    Cells of ``csv`` may hold line breaks, and ``json`` may be arrays, objects or lines. A first pass over the lines tells
    which files many tasks can share; a file in which a value goes over several lines is read by one. ``jsonl`` is one
    object per line and, like ``parquet``, needs no such pass. Without a schema text formats are inferred, which costs
    another pass; the catalog's schema avoids it.
    """
    if fmt not in TABULAR:
        return path
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        options = dict(header=True, inferSchema=schema is None, escape='"', nullValue="\0", emptyValue="")
        return read_by_lines(spark, path, csv_line, lambda files, multi: reader.csv(files, multiLine=multi, **options))
    if fmt == "json":
        return read_by_lines(spark, path, json_line, lambda files, multi: reader.json(files, multiLine=multi))
    return spark.read.parquet(path) if fmt == "parquet" else reader.json(path)


def load_dataset(spark: SparkSession, catalog: DataFrame, name_or_id: str, fmt: str | None = None, schema=None):
    """Look a dataset up by name or id and scan it."""
    entry = find_dataset(catalog, name_or_id)
    return read_dataset(spark, entry["path"], (fmt or entry.get("format") or "csv").lower(), schema)


def format_of(path: str) -> str:
    extension = os.path.splitext(path)[1].lower().lstrip(".")
    return extension if extension in TABULAR else "csv"


def gather_arrays(array_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with the objects of :func:`json_arrays`."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.BufferOutputStream()  # the array's UTF-8, once: as strings it would be held several times, and wider

        def one() -> pa.RecordBatch:
            held.write(b"]")
            text = held.getvalue()
            ends = pa.array([0, text.size], pa.int32()).buffers()[1]
            return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, ends, text)], ["value"])

        for batch in batches:
            for value in batch.column("value"):
                text = value.as_buffer()
                if held.tell() and held.tell() + text.size > array_bytes:
                    yield one()
                    held = pa.BufferOutputStream()
                held.write(b",\n" if held.tell() else b"[")
                held.write(text)
        if held.tell():
            yield one()

    return gather


def json_arrays(df: DataFrame, array_bytes: int) -> DataFrame:
    """Arrays of the rows as JSON objects, one array per row of text: at most ``array_bytes`` and one object long."""
    objects = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    return objects.mapInArrow(gather_arrays(array_bytes), "value string")


def save_dataset(
    df: DataFrame, path: str, name: str, fmt: str | None = None, description: str | None = None, array_bytes: int = 1 << 26
) -> dict:
    """Write a frame and return its catalog entry; rows are counted while they are written.

    ``jsonl`` is one object per line. ``json`` is files of one array each, which any JSON reader takes; tasks write
    their own, and begin another behind ``array_bytes`` bytes.
    """
    fmt = fmt or format_of(path)
    if fmt not in TABULAR:
        raise ValueError(f"format {fmt!r} is not one of {TABULAR}")
    seen = Observation(f"rows of {name}")
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if fmt == "csv":
        counted.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif fmt == "parquet":
        counted.write.parquet(path)
    elif fmt == "json":
        json_arrays(counted, array_bytes).write.option("maxRecordsPerFile", 1).text(path)
    else:
        counted.write.json(path, ignoreNullFields=False)
    return {"name": name, "format": fmt, "path": path, "description": description, "row_count": seen.get["n"]}


def backfill_catalog(catalog: DataFrame, computed: DataFrame) -> DataFrame:
    """Fill a missing schema, and with it a missing row count, from computed statistics."""
    known = computed.select("id", F.col("schema").alias("_schema"), F.col("row_count").alias("_rows"))
    rows = F.when(F.col("schema").isNull(), F.coalesce("row_count", "_rows")).otherwise(F.col("row_count"))
    joined = catalog.join(known, "id", "left").withColumn("row_count", rows)
    return joined.withColumn("schema", F.coalesce("schema", "_schema")).drop("_schema", "_rows")
