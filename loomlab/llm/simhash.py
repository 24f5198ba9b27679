"""SimHash near-duplicates: fingerprints, links within a few bits by pigeonring filtering, components.

The 64 bits are cut into ``m = max_bits + 1`` segments laid out as a ring. If two fingerprints differ in at most
``max_bits`` bits, the ring has a segment from which every chain of ``l`` consecutive segments differs in at most
``floor(l * max_bits / m) = l - 1`` bits. Chains of three segments give the join keys: the first segment is equal, and
either the second too while a third of the next one is (no difference, then at most two), or a half of each of the next
two is (at most one, then at most one more). Longer chains are tested inside a bucket before the full distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlab.llm.common import fresh, stored
from loomlab.llm.components import components

#: Members of one bucket that a task compares at a time; larger buckets are dealt out as pairs of such parts.
BUCKET_PART = 20_000
#: Rows of a table that may be sent to every task: 24 bytes each.
SMALL_ROWS = 50_000
ALL = (1 << 64) - 1


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text, unsigned; zero for a text without words."""
    words = (text or b"").lower().split()  # of bytes: only A-Z and only ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: -shingle] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[shingle - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int) -> Column:
    """The SimHash of a text column as a signed long, computed on Arrow batches."""

    @F.arrow_udf("long")
    def udf(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts), np.uint64)
        for i in range(0, len(texts), 256):  # a few texts at a time as Python objects
            part = texts.slice(i, 256).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            out[i : i + len(part)] = [fingerprint(t, shingle) for t in part]
        return pa.array(out.view(np.int64))

    # never null, and known to be: else a join on it tests for null first and so computes it twice
    return F.coalesce(udf(F.coalesce(text, F.lit(""))), F.lit(0).cast("long"))


def segments(max_bits: int) -> list[int]:
    """The masks of the ring's segments."""
    cuts = np.linspace(0, 64, max_bits + 2).round().astype(int).tolist()
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _split(mask: int, parts: int) -> list[int]:
    bits = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(bits, parts)]


def key_masks(max_bits: int) -> list[tuple[int, int]]:
    """(start of the chain, bits that must be equal) for each way a viable chain of up to three segments can look."""
    ring = segments(max_bits)
    m, out = len(ring), []
    for i in range(m):
        first, second = ring[i], ring[(i + 1) % m]
        if m == 2:
            out += [(i, first | h) for h in _split(second, 2)]
        elif m > 2:
            third = ring[(i + 2) % m]
            out += [(i, first | second | t) for t in _split(third, 3)]
            out += [(i, first | h | g) for h in _split(second, 2) for g in _split(third, 2)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(members: np.ndarray, chain: list[np.uint64]) -> Iterator[tuple[int, int]]:
    """Links that span the components of one bucket, found breadth first: no pair is looked at twice."""
    left = members
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = np.arange(len(left))
            differ = left ^ one
            for length, mask in enumerate(chain, 1):  # chains of 2, 3 ... segments, then the full distance
                fits = np.bitwise_count(differ & mask) <= length
                near, differ = near[fits], differ[fits]
            if len(near):
                found = left[near]
                yield from ((int(one), int(x)) for x in found)
                todo.extend(found)
                left = np.delete(left, near)


def linked(fingerprints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links ``(u, v)`` spanning the components of distinct fingerprints (column ``fp``) within ``max_bits`` bits.

    A bucket holds the distinct fingerprints that agree on one key; a bucket with more than ``BUCKET_PART`` members is
    dealt out as pairs of parts, so that every two members still meet in some task. Tasks keep one bucket part at a
    time and return a spanning forest of it, never its pairs.
    """
    masks = key_masks(max_bits)
    if not masks:  # only equal fingerprints link
        return fingerprints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    keys = F.array(*[
        F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("value"))
        for i, (_, mask) in enumerate(masks)
    ])
    rows = fingerprints.select("fp", F.inline(keys))
    sizes = rows.groupBy("way", "value").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET_PART)
    large = stored(sizes.select("way", "value", F.ceil(F.col("n") / BUCKET_PART).cast("int").alias("parts")), "buckets")
    if large.count() <= SMALL_ROWS:
        large = F.broadcast(large)
    rows = rows.join(large, ["way", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    meet = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(own, o).alias("a"), F.greatest(own, o).alias("b")))
    rows = rows.select("fp", "way", "value", F.inline(meet))
    rows = rows.repartition("way", "value", "a", "b").sortWithinPartitions("way", "value", "a", "b", "fp")
    ring = segments(max_bits)
    chains = []
    for start, _ in masks:
        turn = [ring[(start + j) % len(ring)] for j in range(len(ring))]
        chains.append([np.uint64(sum(turn[: j + 1])) for j in range(1, len(turn))])

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(fp: np.ndarray, way: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
            links = [x for a, b in zip(starts.tolist(), ends.tolist()) if b - a > 1 for x in _forest(fp[a:b], chains[way[a]])]
            both = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

        held: list[np.ndarray] = [np.empty(0, np.uint64)] + [np.empty(0, np.int64)] * 4
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fp", "way", "value", "a", "b")]
            new[0] = new[0].view(np.uint64)
            held = [np.concatenate(x) for x in zip(held, new)]
            turns = np.zeros(max(0, len(held[0]) - 1), bool)
            for x in held[1:]:
                turns |= x[1:] != x[:-1]
            edges = np.concatenate(([0], np.flatnonzero(turns) + 1))
            if len(edges) > 1:  # the last bucket may go on in the next batch
                yield forest(held[0], held[1], edges[:-1], edges[1:])
                held = [x[edges[-1] :] for x in held]
        if len(held[0]):
            yield forest(held[0], held[1], np.array([0]), np.array([len(held[0])]))

    return rows.mapInArrow(buckets, "u long, v long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``max_bits`` bits. Copies share a fingerprint
    and meet as one. A null or blank text has fingerprint zero and links like any other; fewer words than ``shingle``
    are one shingle; a row with a null id gets the component of its fingerprint, null if no row of it has an id;
    repeated rows stay; an empty table gives no rows. Other columns of ``docs`` are not read.
    """
    prints = stored(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint_column(F.col(f"`{text}`"), shingle).alias("fp")), "fingerprints")
    return prints.join(component_table(prints, max_bits), "fp").select("doc_id", "fp", "component_id")


def component_table(prints: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, root, component_id)`` for each distinct ``fp`` of ``(doc_id, fp)`` rows; ``root`` is a fingerprint."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(linked(distinct.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return stored(placed.join(smallest, "root").select("fp", "root", "component_id"), "components")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, or any one of the repeated rows with this id.

    Cases are as in :func:`near_duplicates`; a component without any id keeps one row. Texts are fingerprinted once: a row
    whose id no other row has is found again by its id. Only rows without an id, or with an id that repeats, are
    fingerprinted again to be found by their fingerprint.
    """
    own, fp, root, component = fresh(docs.columns, "own_id", "fp", "root", "component_id")
    ident, columns = F.col(f"`{doc_id}`"), [F.col(f"`{c}`") for c in docs.columns]
    prints = stored(docs.select(ident.alias("doc_id"), fingerprint_column(F.col(f"`{text}`"), shingle).alias("fp")), "fingerprints")
    where = component_table(prints, max_bits)
    ids = prints.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("fp").alias("fp"))
    alone = (F.col("n") == 1) & F.col("doc_id").isNotNull()
    stay = ids.where(alone).join(where, "fp").where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(own))
    out = docs.join(stay, ident == F.col(own), "left_semi").select(*columns)
    others = stored(ids.where(~alone).select(F.col("doc_id").alias(own)), "repeated-ids")
    if others.isEmpty():
        return out
    places = where.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(component))
    again = docs.join(others, ident.eqNullSafe(F.col(own)), "left_semi").withColumn(fp, fingerprint_column(F.col(f"`{text}`"), shingle))
    one = again.join(places, fp).where(ident.eqNullSafe(F.col(component))).dropDuplicates([root])
    return out.union(one.select(*columns))
