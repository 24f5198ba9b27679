"""Files that tasks write and read themselves, on whatever file system the shared folder lies."""

from __future__ import annotations

import re

import pyarrow.fs
from pyspark.sql import DataFrame


def place(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI as a cluster names it, and the path in it; ``s3a`` and ``s3n`` are names of ``s3``."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return pyarrow.fs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else f"file://{uri}")


def one_task_each(listed: DataFrame, order: str) -> DataFrame:
    """The rows of a stored list of files, each in a partition of its own: small as the list is, the work behind a row is not."""
    return listed.repartitionByRange(max(1, listed.count()), order)
