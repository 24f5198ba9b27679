"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlab.session import materialize

#: A word is a run of anything but ASCII white space; both as regular expressions Java and Python read alike.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def fresh(columns, *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``columns``, whatever the letter case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written once below the shared folder and read back: lost executors lose none of it."""
    return materialize(df.sparkSession, df, purpose)


def coded_words(texts):
    """(distinct words, index of each word among them, number of words per text) of an Arrow array of texts, by ASCII space."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if "" in words:  # stands before leading and behind trailing space
        real = at != words.index("")
        owner = np.repeat(np.arange(len(counts)), counts)[real]
        at, counts = at[real], np.bincount(owner, minlength=len(counts))
    return words, at, counts


def text_parts(texts, limit: int = 1 << 22):
    """(first row, slice) of an Arrow array of texts, about ``limit`` bytes at a time; a longer text is a part of its own."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), limit, side="right")))
        yield at, texts.slice(at, n)
        at += n


def rolling(codes, counts, width: int):
    """(first word, hash) of every window of ``width`` words that lies in one text; ``codes`` are 64-bit word codes."""
    import numpy as np

    n = len(codes) - width + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        out ^= out >> np.uint64(29)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return first, out[first]
