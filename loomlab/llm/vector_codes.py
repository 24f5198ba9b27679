"""Product codes of vectors: codebooks fitted to all rows, entries looked up in a geometric near-neighbor access tree.

A vector is cut into equal parts; each part is replaced by the index of its nearest entry in that part's codebook. The
entries of a codebook form a tree. A node takes a few entries, spread far apart, as split points and gives every other
entry to its nearest one. For each pair of split point and child it keeps the range of distances between the point
and the entries below the child, the child's own split point included. For a query at distance ``d`` from a split point,
with an entry known at distance ``r``, a child can't hold an entry as near as ``r`` if ``d - r`` is above the
child's range or ``d + r`` below it.

All coordinates are whole numbers and squared distances exact. Roots are rounded so that a test only ever errs
towards looking: ranges and sums outwards, differences inwards. A child goes only if it lies strictly beyond, so every
entry at the smallest distance is looked at, and the tie goes to the lower index by comparing squares.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlab.llm.common import stored
from loomlab.llm.vectors import comparable, matrix

#: Split points of a node.
SPLITS = 4
#: Parts looked up at a time in a task.
ROWS = 1 << 15
LARGEST = (1 << 63) - 1


def squares(queries: np.ndarray, point: np.ndarray) -> np.ndarray:
    apart = queries - point
    return np.einsum("ij,ij->i", apart, apart)


def root_low(square):
    """At most the square root."""
    return np.maximum(np.floor(np.sqrt(np.asarray(square, np.float64))) - 1, 0)


def root_high(square):
    """At least the square root."""
    return np.ceil(np.sqrt(np.asarray(square, np.float64))) + 1


@dataclass
class Node:
    points: list[int]
    children: list[Node | None] = field(default_factory=list)
    #: low[i, j], high[i, j]: distances from split point i to the entries of child j
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def entries(self) -> list[int]:
        return [*self.points, *(e for c in self.children if c for e in c.entries())]


def build(entries: np.ndarray, members: list[int] | None = None, splits: int = SPLITS) -> Node:
    """The tree over the rows of an integer matrix."""
    members = list(range(len(entries))) if members is None else members
    points, apart = [members[0]], squares(entries[members], entries[members[0]])
    while len(points) < min(splits, len(members)):
        taken = np.isin(members, points)
        points.append(members[int(np.argmax(np.where(taken, -1, apart)))])
        apart = np.minimum(apart, squares(entries[members], entries[points[-1]]))
    below: list[list[int]] = [[] for _ in points]
    for m in members:
        if m not in points:
            below[int(np.argmin([squares(entries[[m]], entries[p])[0] for p in points]))].append(m)
    node = Node(points, [build(entries, b, splits) if b else None for b in below])
    groups = [[p, *b] for p, b in zip(points, below)]
    reach = [[squares(entries[g], entries[p]) for g in groups] for p in points]
    node.low = np.array([[root_low(r.min()) for r in line] for line in reach])
    node.high = np.array([[root_high(r.max()) for r in line] for line in reach])
    return node


def nearest(tree: Node, entries: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(index, squared distance, distances computed)`` of the nearest entry of each query; ties go to the lower index."""
    best = np.full(len(queries), LARGEST, np.int64)
    index = np.full(len(queries), len(entries), np.int64)
    looked = 0

    def visit(node: Node, rows: np.ndarray) -> None:
        nonlocal looked
        alive = np.ones((len(rows), len(node.points)), bool)
        for i, point in enumerate(node.points):
            at = np.flatnonzero(alive[:, i])
            if not len(at):
                continue
            some = rows[at]
            square = squares(queries[some], entries[point])
            looked += len(some)
            better = (square < best[some]) | ((square == best[some]) & (point < index[some]))
            best[some[better]], index[some[better]] = square[better], point
            radius = root_high(best[some])
            beyond = (root_low(square) - radius)[:, None] > node.high[i]
            short = (root_high(square) + radius)[:, None] < node.low[i]
            alive[at] &= ~(beyond | short)
        for i, child in enumerate(node.children):
            if child is not None and (some := rows[alive[:, i]]).size:
                visit(child, some)

    if len(queries) and len(entries):
        visit(tree, np.arange(len(queries)))
    return index, best, looked


def cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(part, row, position) of a matrix of vectors."""
    return np.ascontiguousarray(vectors.reshape(len(vectors), parts, -1).swapaxes(0, 1), dtype=np.int64)


def improved(rows: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows: each entry becomes the floored mean of the parts assigned to it.

    Tasks add up the parts of their rows, so a row of sums per entry and coordinate leaves a task, whatever its size.
    """
    parts, count, length = codebooks.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build(book) for book in codebooks]
        total, members = np.zeros((parts, count, length), np.int64), np.zeros((parts, count), np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                for p, queries in enumerate(cut(matrix(batch.column("v").slice(i, ROWS), parts * length), parts)):
                    index, _, _ = nearest(trees[p], codebooks[p], queries)
                    members[p] += np.bincount(index, minlength=count)
                    order = np.argsort(index, kind="stable")
                    used, first = np.unique(index[order], return_index=True)
                    total[p, used] += np.add.reduceat(queries[order], first, axis=0)
        p, e = np.nonzero(members)
        if len(p):
            yield pa.RecordBatch.from_pydict({
                "part": np.repeat(p, length), "entry": np.repeat(e, length), "at": np.tile(np.arange(length), len(p)),
                "total": total[p, e].ravel(), "members": np.repeat(members[p, e], length),
            })

    found = rows.select("v").mapInArrow(sums, "part long, entry long, at long, total long, members long")
    found = found.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("members").alias("members"))
    out = codebooks.copy()
    for row in found.collect():  # a row per coordinate of the codebooks
        out[row["part"], row["entry"], row["at"]] = int(row["total"]) // row["members"]
    return out


def fit(rows: DataFrame, key: str, parts: int, count: int, rounds: int, length: int) -> np.ndarray:
    """Codebooks (part, entry, position) of the integer vectors ``v``."""
    first = rows.orderBy(F.col(key).asc_nulls_last(), "v").limit(count).select("v").collect()
    codebooks = cut(np.array([r["v"] for r in first], np.int64).reshape(-1, length), parts)
    for _ in range(rounds):
        codebooks = improved(rows, codebooks)
    return codebooks


def compress(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = 8, count: int = 16, rounds: int = 6, scale: int = 4096,
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of each row whose vector can be coded.

    Components become ``floor(scale * x)``. The first codebook is made of the vectors with the ``count`` smallest ids
    (fewer if there are fewer rows; null ids come last, equal ids in order of their vectors), and each round reads all
    rows. ``code`` has two hex digits per part, ``error`` is the exact squared distance to the coded vector,
    ``label_error`` its sum over rows with an equal label, null labels together, and ``codebooks_sha256`` the digest of
    all entries in decimals. Rows go whose vector is null, has a component that is null or not finite, or has another
    number of components than the kept vector with the smallest id; if that number is no positive multiple of
    ``parts``, nothing can be cut and there are no rows. Components are held within the range in which a part's
    squared distance is an exact 64-bit number (for parts of 8, whole numbers up to 2**28). Repeated rows stay; other
    columns are not read. The driver holds the codebooks, and sums for them, alone.
    """
    if not 0 < count <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = rows.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{label}`").alias("group"), F.col(f"`{vector}`").alias("v"))
    kind, group = (rows.schema[c].dataType.simpleString() for c in ("id", "group"))
    schema = f"`{vec_id}` {kind}, code string, error long, label_error long, codebooks_sha256 string"
    most = lambda n: min(math.isqrt((1 << 62) // max(1, n // parts)) // 2, (1 << 31) - 1)
    rows, length = comparable(rows, "id", "v", scale, most, "integer-vectors")
    if not length or length % parts:
        return rows.sparkSession.createDataFrame([], schema)
    codebooks = fit(rows, "id", parts, count, rounds, length)
    sha = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [build(book) for book in codebooks]
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                indexes, errors = np.empty((some.num_rows, parts), np.uint8), np.zeros(some.num_rows, np.int64)
                for p, queries in enumerate(cut(matrix(some.column("v"), length), parts)):
                    indexes[:, p], square, _ = nearest(trees[p], codebooks[p], queries)
                    errors += np.minimum(square, LARGEST - errors)
                codes = [r.tobytes().hex() for r in indexes]
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("group"), pa.array(codes, pa.string()), pa.array(errors)], ["id", "group", "code", "error"])

    coded = stored(rows.mapInArrow(code, f"id {kind}, group {group}, code string, error long"), "vector-codes")
    sums = coded.groupBy("group").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = sums.select(F.col("group").alias("of"), F.least("total", F.lit(LARGEST)).cast("long").alias("label_error"))
    return coded.join(sums, F.col("group").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(vec_id), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256")
    )
