"""Hard negatives by inner product, over an R-tree packed by sort-tile-recursive order.

Rows are dealt to slabs by ranges of the first coordinate, ordered by the second inside a slab, and cut into blocks of
consecutive rows; a task packs one block further, tile by tile over the coordinates that spread most, down to leaves.
Each node of the tree, from the slab to the leaf, keeps the smallest box around its rows. A box bounds the inner
product with a query: each coordinate of the query takes the box's upper or lower face by its sign, which gives the
interval's upper end, and the other face for the lower end.

A search asks for the ``k`` best rows inside a window of scores. Boxes wait in a queue, best upper bound first; a box is
dropped for a query's window if its interval lies outside the window or strictly below the ``k``-th best score found so
far. A box that reaches that score exactly is opened, as an equal score may have a smaller id. Queries that share a block
go down its tree together, so a box is opened once for all that still need it. Each query first searches the block it
lies in itself; what it finds there prunes the slabs and blocks it is sent to afterwards.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlab.llm.common import stored
from loomlab.llm.vectors import comparable, matrix

#: Numbers beyond this either way are held there: an inner product of up to 8,192 components then is a 64-bit number.
MOST = 1 << 25
#: Rows of a leaf and children of an inner node.
LEAF, FANOUT = 64, 8
#: Slabs at most: the driver holds one box for each, and sends them to the tasks.
SLABS = 1024
#: Queries that meet one block in one task.
MET = 20_000
LOWEST, NO_ID = -(1 << 63), (1 << 63) - 1
FOUND = "query long, place int, score long, id long"


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of integer matrices, without rounding: by floating point only where every sum is exact."""
    high = lambda m: int(np.abs(m).max(initial=0))
    if high(x) * high(y) * max(1, x.shape[1]) < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x.astype(np.int64) @ y.astype(np.int64).T


def interval(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of each query with any point of each box."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return exact(up, low) + exact(down, high), exact(up, high) + exact(down, low)


def packed(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[int]]:
    """(order of rows, first row of each leaf): sort-tile-recursive packing.

    A tile of ``p`` leaves over ``d`` coordinates is sorted by the coordinate that spreads most of those left, and cut
    into ``ceil(p ** (1 / d))`` slabs of whole leaves, each of which goes on with the other coordinates.
    """
    tiles: list[np.ndarray] = []

    def tile(rows: np.ndarray, left: list[int]) -> None:
        leaves = -(-len(rows) // leaf)
        if leaves <= 1 or not left:
            tiles.extend(rows[i : i + leaf] for i in range(0, len(rows), leaf))
            return
        spread = np.ptp(points[rows][:, left], axis=0)
        axis = left[int(np.argmax(spread))]
        rows = rows[np.argsort(points[rows, axis], kind="stable")]
        slabs = max(2, int(np.ceil(leaves ** (1 / len(left)))))
        step = -(-leaves // slabs) * leaf
        for i in range(0, len(rows), step):
            tile(rows[i : i + step], [a for a in left if a != axis])

    if len(points):
        tile(np.arange(len(points)), list(range(points.shape[1])))
    sizes = np.array([len(t) for t in tiles], np.int64)
    return np.concatenate([np.empty(0, np.int64), *tiles]), (np.cumsum(sizes) - sizes).tolist()


class Tree:
    """The boxes over one block of rows, leaves first, and what its leaves hold."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        order, starts = packed(points)
        self.points, self.ids, self.labels, self.rows = points[order], ids[order], labels[order], rows[order]
        self.starts = [*starts, len(order)]
        low = np.array([self.points[a:b].min(axis=0) for a, b in zip(self.starts, self.starts[1:])])
        high = np.array([self.points[a:b].max(axis=0) for a, b in zip(self.starts, self.starts[1:])])
        self.levels = [(low, high)]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            cuts = range(0, len(low), FANOUT)
            self.levels.append((np.array([low[i : i + FANOUT].min(axis=0) for i in cuts]), np.array([high[i : i + FANOUT].max(axis=0) for i in cuts])))

    def search(self, queries: np.ndarray, labels: np.ndarray, own: np.ndarray, asked: np.ndarray, low: np.ndarray, high: np.ndarray, kth: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), a line of ``k`` per window, the best first and unused places at the end.

        Window ``w`` belongs to query ``asked[w]`` and takes scores from ``low[w]`` to ``high[w]``; ``kth[w]`` is a
        score that ``k`` rows elsewhere reach, so only rows that reach it matter. Rows have the query's label if
        ``same``, else another, and are never the row ``own``.
        """
        scores = np.full((len(asked), k), LOWEST, np.int64)
        ids = np.full((len(asked), k), NO_ID, np.int64)
        floor = np.maximum(low, kth)
        if not len(asked) or not len(self.points):
            return scores, ids
        queue: list = []

        def push(level: int, nodes: range, windows: np.ndarray) -> None:
            box_low, box_high = self.levels[level]
            members, at = np.unique(asked[windows], return_inverse=True)
            least, most = interval(queries[members], box_low[nodes.start : nodes.stop], box_high[nodes.start : nodes.stop])
            for j, node in enumerate(nodes):
                ends = most[at, j]
                keep = (ends >= np.maximum(floor[windows], scores[windows, -1])) & (least[at, j] <= high[windows])
                if keep.any():
                    heapq.heappush(queue, (-int(ends[keep].max()), level, node, windows[keep], ends[keep]))

        push(len(self.levels) - 1, range(1), np.arange(len(asked)))
        while queue:
            _, level, node, windows, ends = heapq.heappop(queue)
            windows = windows[ends >= np.maximum(floor[windows], scores[windows, -1])]  # the k-th best may have risen since
            if not len(windows):
                continue
            if level:
                push(level - 1, range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0]))), windows)
                continue
            a, b = self.starts[node], self.starts[node + 1]
            members, at = np.unique(asked[windows], return_inverse=True)
            allowed = (labels[members][:, None] == self.labels[a:b]) == same
            allowed &= own[members][:, None] != self.rows[a:b]
            all_found = exact(queries[members], self.points[a:b])
            found = all_found[at]
            bar = np.maximum(floor[windows], scores[windows, -1])
            w, r = np.nonzero((found >= bar[:, None]) & (found <= high[windows][:, None]) & allowed[at])
            if len(w):
                self.take(scores, ids, windows[w], found[w, r], self.ids[a:b][r], k)
        return scores, ids

    @staticmethod
    def take(scores: np.ndarray, ids: np.ndarray, window: np.ndarray, score: np.ndarray, found: np.ndarray, k: int) -> None:
        """Keeps the ``k`` best of each window that has something new."""
        touched = np.unique(window)
        window = np.concatenate([np.repeat(touched, k), window])
        score = np.concatenate([scores[touched].ravel(), score])
        found = np.concatenate([ids[touched].ravel(), found])
        order = np.lexsort((found, -1 - score, window))  # ~score: the lowest number has no opposite
        window, score, found = window[order], score[order], found[order]
        first = np.searchsorted(window, touched)
        at = first[:, None] + np.arange(k)
        scores[touched], ids[touched] = score[at], found[at]


def in_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` (id, label, v, and more) stored with ``slab``, ``run`` and ``row``: block ``run`` of a slab, and a number of its own."""
    count = rows.count()
    slabs = min(SLABS, max(1, -(-count // (2 * block_rows))))
    first, second = F.get("v", F.lit(0)), F.get("v", F.lit(1))
    rows = rows.repartitionByRange(slabs, first, F.xxhash64("id", "v")).sortWithinPartitions(second, "id")
    rows = rows.withColumn("slab", F.spark_partition_id())
    names = rows.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            slab = batch.column("slab").to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((place // block_rows).astype(np.int32)), pa.array((slab << 40) + place)], [*names, "run", "row"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return stored(rows.mapInArrow(cut, f"{kinds}, run int, row long"), "blocks")


def slab_boxes(blocks: DataFrame, length: int) -> list:
    """(slab, blocks in it, lower corner, upper corner) of each slab."""

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            slab, points = batch.column("slab").to_numpy(), matrix(batch.column("v"), length)
            for s in np.unique(slab).tolist():
                some, last = points[slab == s], int(batch.column("run").to_numpy()[slab == s].max())
                old = found.get(s, [last, some[0], some[0]])
                found[s] = [max(old[0], last), np.minimum(old[1], some.min(axis=0)), np.maximum(old[2], some.max(axis=0))]
        for s, (last, low, high) in found.items():
            yield pa.RecordBatch.from_pydict({"slab": pa.array([s] * length, pa.int32()), "at": pa.array(range(length), pa.int32()), "last": pa.array([last] * length, pa.int32()), "low": low, "high": high})

    found = blocks.select("slab", "run", "v").mapInArrow(corners, "slab int, at int, last int, low int, high int")
    found = found.groupBy("slab", "at").agg(F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = found.groupBy("slab").agg(F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("box"))
    return [(r["slab"], r["last"] + 1, [x["low"] for x in r["box"]], [x["high"] for x in r["box"]]) for r in found.collect()]


def meet(blocks: DataFrame, queries: DataFrame, length: int, k: int, same: bool, count: int) -> DataFrame:
    """What ``queries`` find in the block (``slab``, ``run``) that each of them names: at most ``k`` rows per window and block."""
    parts = max(1, -(-count // MET))
    share = F.pmod(F.xxhash64("query"), F.lit(parts)).cast("int")
    queries = queries.select("slab", "run", share.alias("share"), "query", "v", "label", "windows")
    rows = blocks.select("slab", "run", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("share"), "id", "label", "row", "v")

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        kinds = pa.schema([("query", pa.int64()), ("place", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])
        if not asked.num_rows or not held.num_rows:
            return kinds.empty_table()
        asked, held = asked.combine_chunks(), held.combine_chunks()
        numbers = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        tree = Tree(matrix(held.column("v").combine_chunks(), length), numbers(held, "id"), numbers(held, "label"), numbers(held, "row"))
        lists = asked.column("windows").combine_chunks()
        owner = np.repeat(np.arange(asked.num_rows), np.diff(lists.offsets.to_numpy()))
        windows = {c: lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("place", "low", "high", "kth")}
        scores, ids = tree.search(matrix(asked.column("v").combine_chunks(), length), numbers(asked, "label"), numbers(asked, "query"), owner, windows["low"], windows["high"], windows["kth"], k, same)
        w, at = np.nonzero(scores > LOWEST)
        return pa.Table.from_arrays([pa.array(numbers(asked, "query")[owner[w]]), pa.array(windows["place"][w].astype(np.int32)), pa.array(scores[w, at]), pa.array(ids[w, at])], schema=kinds)

    key = ["slab", "run", "share"]
    return queries.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(search, FOUND)


def sent_on(queries: DataFrame, boxes: list, length: int) -> DataFrame:
    """``queries`` once for each block, but their own, of the slabs whose box can hold something for one of their windows."""
    slabs, counts = (np.array([b[i] for b in boxes], np.int64) for i in (0, 1))
    low, high = (np.array([b[i] for b in boxes], np.int64).reshape(len(boxes), length) for i in (2, 3))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, most = interval(matrix(batch.column("v"), length), low, high)
            lists = batch.column("windows")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            window = {c: lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("low", "high", "kth")}
            fits = (most[owner] >= np.maximum(window["low"], window["kth"])[:, None]) & (least[owner] <= window["high"][:, None])
            wanted = np.zeros((batch.num_rows, len(slabs)), bool)
            np.logical_or.at(wanted, owner, fits)
            q, s = np.nonzero(wanted)
            to = pa.StructArray.from_arrays([pa.array(slabs[s].astype(np.int32)), pa.array(counts[s].astype(np.int32))], ["slab", "blocks"])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(q, minlength=batch.num_rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), to)], [*batch.schema.names, "to"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema)
    found = queries.mapInArrow(choose, f"{kinds}, to array<struct<slab:int,blocks:int>>")
    found = found.withColumn("to", F.explode("to")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("to.blocks") - 1)))
    found = found.where((F.col("to.slab") != F.col("slab")) | (F.col("other") != F.col("run")))
    return found.select("query", "v", "label", "windows", F.col("to.slab").alias("slab"), F.col("other").alias("run"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each (query, place), with ``rank`` from 1."""
    order = Window.partitionBy("query", "place").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(blocks: DataFrame, queries: DataFrame, boxes: list, length: int, k: int, same: bool) -> DataFrame:
    """``(query, place, score, id, rank)``: the ``k`` best rows for each window of ``queries``, stored.

    ``queries`` has query (a ``row`` of ``blocks``), slab, run, v, label, and ``windows``: (place, low, high) each.
    """
    count = queries.count()
    near = lambda kth: F.transform("windows", lambda w: F.struct(w["place"].alias("place"), w["low"].alias("low"), w["high"].alias("high"), kth(w).alias("kth")))
    own = stored(meet(blocks, queries.withColumn("windows", near(lambda w: F.lit(LOWEST))), length, k, same, count), "found-near")
    bars = own.groupBy("query", "place").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    bars = bars.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("place", "kth"))).alias("bars"))
    far = queries.join(bars, "query", "left")
    far = far.withColumn("windows", near(lambda w: F.coalesce(F.try_element_at("bars", w["place"]), F.lit(LOWEST)))).drop("bars")
    rest = meet(blocks, sent_on(far, boxes, length), length, k, same, count)
    return stored(best(own.unionByName(rest), k), "found")


def mine(
    rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, least_pct: int = 50, most_pct: int = 95, scale: int = 256, block_rows: int = 8192,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``: hard negatives of the anchors.

    Components become ``floor(scale * x)`` and a score is the inner product of two vectors. Higher scores come first,
    then smaller ids. Each row for which ``anchor`` holds has as positives its best ``positives`` other rows with its
    label; for each of them, the best ``negatives`` rows with another label are returned whose score lies between
    ``least_pct`` and ``most_pct`` percent of the positive's, both included. Fewer are returned where there are fewer,
    none for a positive below zero.

    Rows take no part whose label or vector is null, whose vector has a component that is null or not finite, or has
    another number of components than that of the row with the smallest id. A row with a null id ranks behind equal
    scores and is returned as null. Repeated rows are rows of their own: they are each other's positives, and each
    repeat of an anchor has results. Numbers are held within 2**25 either way. Other columns are not read.
    """
    rows = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), anchor.alias("anchor"), F.col(f"`{vector}`").alias("v"))
    rows, length = comparable(rows.where(F.col("label").isNotNull()), "id", "v", scale, lambda n: MOST, "integer-vectors")
    blocks = in_blocks(rows.withColumn("id", F.coalesce("id", F.lit(NO_ID))), block_rows)
    if length == 0:  # no row is left, or vectors have no components and so no order
        blocks = blocks.limit(0)
    boxes = slab_boxes(blocks, length)
    window = lambda place, low, high: F.struct(place.cast("int").alias("place"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    anchors = stored(blocks.where("anchor").select(F.col("row").alias("query"), "id", "slab", "run", "label", "v"), "anchors")
    whole = F.array(window(F.lit(0), F.lit(LOWEST + 1), F.lit(NO_ID)))
    alike = search(blocks, anchors.withColumn("windows", whole), boxes, length, positives, True)
    alike = alike.select("query", F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))

    score = F.col("positive_score")
    reach = [F.expr(f"(positive_score * {least_pct} + 99) div 100"), F.expr(f"positive_score * {most_pct} div 100")]  # rounded inwards
    windows = alike.where(score >= 0).groupBy("query").agg(F.collect_list(window(F.col("place"), *reach)).alias("windows"))
    other = search(blocks, anchors.join(windows, "query"), boxes, length, negatives, False)
    named = lambda c, name: F.nullif(F.col(c), F.lit(NO_ID)).alias(name)
    return other.join(alike, ["query", "place"]).join(anchors.select("query", F.col("id").alias("anchor")), "query").select(
        named("anchor", "anchor_id"), named("positive_id", "positive_id"), F.col("rank").cast("int").alias("rank"),
        named("id", "negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
