"""Schema inference over text cells, on a lattice of its own.

Spark's ``inferSchema`` reads dates and takes empty cells as null; here an empty cell makes the
column text, only integers and floats merge, and all rows decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlab.sources.datasets import csv_line, read_by_lines

# What a strict number parser accepts.
INTEGER = r"^[+-]?\d+$"
FLOAT = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"


#: A bit per type a cell can have.
BITS = {"int64": 1, "float64": 2, "boolean": 4, "string": 8}


def cell_bit(cell: Column) -> Column:
    """The bit of a cell's type; a cell that is empty or missing is text."""
    text = F.trim(cell, F.lit(" \t\r\n"))
    return (
        F.when(cell.isNull() | (text == ""), BITS["string"])
        .when(text.rlike(INTEGER) & text.try_cast("bigint").isNotNull(), BITS["int64"])  # a failed cast costs more than a pattern
        .when(text.rlike(FLOAT), BITS["float64"])
        .when(F.lower(text).isin("true", "false"), BITS["boolean"])
        .otherwise(BITS["string"])
    )


def column_type(bits: Column) -> Column:
    """The type of a column from the bits of its cells: one stays, integers and floats become float64, else text."""
    return (
        F.when(bits == BITS["int64"], "int64")
        .when(bits.isin(BITS["float64"], BITS["int64"] | BITS["float64"]), "float64")
        .when(bits == BITS["boolean"], "boolean")
        .otherwise("string")
    )


def cell_type(cell: Column) -> Column:
    return column_type(cell_bit(cell))


def infer_schema(cells: DataFrame, order: list[str], tolerant: bool = False, sample_rows: int | None = None) -> DataFrame:
    """(position, name, type, nullable, row_count) of a frame of text columns.

    All columns outside ``order`` are cells. Each column folds to the bits of its cells' types, in the one scan that
    counts the rows too; from ``sample_rows`` rows, the first in ``order``, where the caller asks for that, while the
    count stays that of all rows. ``tolerant`` ignores empty cells instead of reading them as text. Without rows every
    column is text.
    """
    names = [c for c in cells.columns if c not in order]

    def bits(c: str) -> Column:
        blank = F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`"), F.lit(" ")) == "")
        bit = cell_bit(F.col(f"`{c}`"))
        return F.when(~blank, bit) if tolerant else bit

    def read(rows: DataFrame) -> DataFrame:
        return rows.select(*[bits(c).alias(f"b{i}") for i, c in enumerate(names)])

    count, folds = F.count(F.lit(1)).alias("row_count"), F.array(*[F.bit_or(f"b{i}") for i in range(len(names))]).alias("bits")
    if sample_rows is None:
        found = read(cells).agg(count, folds)
    else:
        total = cells.agg(count)
        found = read(cells.orderBy(*order).limit(sample_rows)).agg(folds).select(total.scalar().alias("row_count"), "bits")
    named = F.arrays_zip(F.array(*[F.lit(c) for c in names]).alias("name"), F.col("bits"))
    return found.select("row_count", F.posexplode(named).alias("position", "c")).select(
        "position", "c.name", column_type(F.col("c.bits")).alias("type"), F.lit(True).alias("nullable"), "row_count"
    )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV as text cells with the file position of each row; rows of wrong arity are dropped.

    Files without a line break inside a cell are split among tasks, others are read by one task each.
    """
    header = spark.read.csv(path, header=True, escape='"', multiLine=True).columns
    fields = [T.StructField(c, T.StringType()) for c in header]
    schema = T.StructType([*fields, T.StructField("_bad", T.StringType())])
    # Without column pruning the reader sees the arity of every row, whatever columns a query uses.
    reader = spark.read.schema(schema).option("columnPruning", "false")
    place = {
        "_file": F.col("_metadata.file_path"),
        "_block": F.col("_metadata.file_block_start"),
        "_row": F.monotonically_increasing_id(),
    }
    options = dict(header=True, escape='"', columnNameOfCorruptRecord="_bad", nullValue="\0", emptyValue="")
    placed = read_by_lines(spark, path, csv_line, lambda files, multi: reader.csv(files, multiLine=multi, **options).withColumns(place))
    # Spark refuses a scan of the corrupt-record column alone, so a count has to read a cell too.
    touched = F.when(F.length(f"`{header[0]}`") < 0, F.col(f"`{header[0]}`"))
    return placed.where(F.coalesce("_bad", touched).isNull()).drop("_bad")


def infer_csv_schema(spark: SparkSession, path: str, tolerant: bool = False, sample_rows: int | None = None) -> DataFrame:
    return infer_schema(read_cells(spark, path), ["_file", "_block", "_row"], tolerant, sample_rows)
