"""Benchmark decontamination by templates: numbers, names and units become typed slots, and slots must agree.

Benchmark items and documents are read as words. A word is a literal, a number, a unit (a unit's name behind a number) or
a name (a capital followed by small letters). Windows of ``width`` words become templates in two forms: numbers and units
as slots, and names too. Equal templates meet in a hash join. A match counts only if the item's slot values map to the
document's consistently: a re-parameterised question replaces each value by one other value. Windows with too few literal words to
be templates, such as lists of numbers, take part with their plain words: they match copies and nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlab.llm.common import coded_words, fresh, rolling, stored, text_parts

#: Unit names, lower case, as they stand behind a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons oz lb lbs pound pounds ml cl l "
    "liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years km/h mph m/s hz khz mhz ghz w kw mw v kv a ma j kj cal kcal n pa kpa bar c f k °c °f b kb mb gb "
    "tb usd eur gbp dollar dollars euro euros cent cents percent meter meters metre metres kilometer kilometers kilogram "
    "kilograms gram grams degree degrees".split()
)
NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:%|[a-zA-Z°/]{1,4})?")
LITERAL, NUM, UNIT_WORD, PROPER = 0, 1, 2, 3
SLOT_CODES = {NUM: 1, UNIT_WORD: 2, PROPER: 3}
WIDTH = 8
#: A template needs so many literal words of eight; shorter ones in proportion.
LITERALS = 5
#: Items of fewer words are found where they are the whole document; items shorter than the width are one window.
MIN_WORDS = 5
#: Cells of the table of benchmark windows that every task holds, 2 MB of bits whatever the benchmark's size.
CELLS = 1 << 24
#: Part of an item's windows, or words in a row, that make a document contaminated.
COVERAGE, RUN_WORDS = 0.5, 13
#: Ways to cut a document's matches into occurrences of an item; see :func:`occurrences`.
DOCUMENT, ALIGNED, BAND, SHIFTED_BAND = 0, 1, 2, 3
#: Part of an item's slots whose value has the occurrence's usual value for it.
AGREEMENT = 0.8


@lru_cache(maxsize=1 << 17)
def reading(word: str) -> tuple[int, int, str]:
    """(code of the literal, kind, bare word) of a word."""
    bare = word.strip(".,;:!?\"'()[]{}<>«»„“”‘’…")
    low = bare.lower()
    if low in UNITS:
        kind = UNIT_WORD
    elif bare.isalpha():
        kind = PROPER if bare[0].isupper() and bare[1:].islower() else LITERAL
    else:
        kind = NUM if NUMBER.fullmatch(bare) else LITERAL
    return xxhash.xxh64_intdigest(low.encode("utf-8", "replace")) | 4, kind, low


class Reading:
    """Codes and kinds of the words of a part of texts; words of punctuation alone are left out."""

    def __init__(self, texts: pa.Array):
        words, at, counts = coded_words(texts)
        read = [reading(w) for w in words]
        blank = np.fromiter((not r[2] for r in read), bool, len(read))
        if blank.any():
            real = ~blank[at]
            owner = np.repeat(np.arange(len(counts)), counts)[real]
            at, counts = at[real], np.bincount(owner, minlength=len(counts))
        self.bare, self.at, self.counts = [r[2] for r in read], at, counts
        code = np.fromiter((r[0] for r in read), np.uint64, len(read))[at]
        kind = np.fromiter((r[1] for r in read), np.int8, len(read))[at]
        # a unit's name is a unit only right behind a number of the same text
        owner = np.repeat(np.arange(len(counts)), counts)
        behind = np.zeros(len(at), bool)
        behind[1:] = (kind[:-1] == NUM) & (owner[1:] == owner[:-1])
        kind[(kind == UNIT_WORD) & ~behind] = LITERAL
        self.kind, self.owner, self.code = kind, owner, code.copy()
        plain = code.copy()
        for k in (NUM, UNIT_WORD):
            plain[kind == k] = SLOT_CODES[k]
        typed = plain.copy()
        typed[kind == PROPER] = SLOT_CODES[PROPER]
        self.forms = [(plain, kind % PROPER != LITERAL), (typed, kind != LITERAL)]

    def windows(self, form: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, hash, whether it is a template) of all windows; those with too few literal words are hashed as they are."""
        code, slot = self.forms[form]
        first, hashes = rolling(code, self.counts, width)
        filled = np.concatenate(([0], np.cumsum(slot)))
        enough = width - (filled[first + width] - filled[first]) >= LITERALS * width / WIDTH
        if width < MIN_WORDS:
            enough[:] = False
        if not enough.all():
            hashes = np.where(enough, hashes, ~rolling(self.code, self.counts, width)[1])
        if width < MIN_WORDS:  # so short an item has to be the whole text
            whole = self.counts[self.owner[first]] == width
            first, hashes, enough = first[whole], hashes[whole], enough[whole]
        return first, hashes * np.uint64(2) + np.uint64(form), enough

    def slots(self, form: int, first: int, width: int) -> tuple[list[int], list[str]]:
        """(places in the window, values) of a window's slots."""
        places = np.flatnonzero(self.forms[form][1][first : first + width])
        return places.tolist(), [self.bare[self.at[first + p]] for p in places]


WINDOW = "way int, hash long, place int, slots array<int>, vals array<string>"


def _rows(read: Reading, way: int, form: int, width: int, first: np.ndarray, hashes: np.ndarray, template: np.ndarray, starts: np.ndarray) -> dict:
    slots = [read.slots(form, f, width) if t else ([], []) for f, t in zip(first.tolist(), template.tolist())]
    return {
        "way": pa.array([way] * len(first), pa.int32()), "hash": pa.array(hashes.view(np.int64)),
        "place": pa.array(first - starts[read.owner[first]], pa.int32()),
        "slots": pa.array([s for s, _ in slots], pa.list_(pa.int32())), "vals": pa.array([v for _, v in slots], pa.list_(pa.string())),
    }


def item_windows(items: DataFrame) -> DataFrame:
    """All templates of rows (item, text): (item, words, way, hash, place, slots, vals); ``way`` is 2 * width + form."""

    def read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                read = Reading(batch.column("text").slice(i, 1))
                n = len(read.at)
                if not n:
                    continue
                width = min(n, WIDTH)
                for form in (0, 1):
                    first, hashes, template = read.windows(form, width)
                    rows = _rows(read, 2 * width + form, form, width, first, hashes, template, np.zeros(1, np.int64))
                    same = pa.array(np.full(len(first), i))
                    yield pa.RecordBatch.from_pydict({"item": batch.column("item").take(same), "words": pa.array([n] * len(first), pa.int32()), **rows})

    return stored(items.mapInArrow(read_items, f"item {items.schema['item'].dataType.simpleString()}, words int, {WINDOW}"), "item-windows")


def cells(windows: DataFrame) -> np.ndarray:
    """A bit for each cell that some window falls into; built by the tasks, of fixed size."""
    cell = F.col("hash").bitwiseAND(CELLS - 1)
    rows = windows.select(F.shiftright(cell, 6).alias("at"), F.expr(f"shiftleft(1L, cast((hash & {CELLS - 1}) % 64 as int))").alias("bit"))
    rows = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(CELLS // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def document_windows(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Templates of rows (doc_id, text_key, text) that may be the benchmark's: those whose cell is taken.

    The tasks hold the cells only, never the benchmark; the hash join that follows is exact.
    """
    ways = sorted(r["way"] for r in windows.select("way").distinct().collect())  # two forms of at most WIDTH widths
    shared = docs.sparkSession.sparkContext.broadcast(cells(windows))

    def read_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for at, texts in text_parts(batch.column("text"), 1 << 21):
                read = Reading(texts)
                starts = np.cumsum(read.counts) - read.counts
                for way in ways:
                    width, form = divmod(way, 2)
                    first, hashes, template = read.windows(form, width)
                    cell = hashes & np.uint64(CELLS - 1)
                    hit = (bits[cell >> np.uint64(6)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)
                    first, hashes, template = first[hit], hashes[hit], template[hit]
                    if len(first):
                        own = pa.array(at + read.owner[first])
                        rows = _rows(read, way, form, width, first, hashes, template, starts)
                        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(own), "text_key": batch.column("text_key").take(own), **rows})
        reading.cache_clear()  # workers live on for other tasks
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(read_docs, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, {WINDOW}")


def occurrences(met: DataFrame) -> DataFrame:
    """``met`` once for each occurrence (kind, at) that a matched window may belong to.

    Windows of one copy have one alignment, the item's beginning in the document. Bands of half the item's words, and the
    same bands shifted by half their width, also hold a copy whose alignment moves by up to a quarter of the item, and no
    two copies. All matches of a document are one occurrence more, for copies that are torn further apart.
    """
    align = F.col("doc_place") - F.col("place")
    band = F.greatest(F.floor(F.col("words") / 2), F.lit(1))
    spot = lambda kind, at: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"))
    spots = [spot(DOCUMENT, F.lit(0)), spot(ALIGNED, align), spot(BAND, F.floor(align / band)), spot(SHIFTED_BAND, F.floor((align + F.floor(band / 2)) / band))]
    return met.select("*", F.inline(F.array(*spots)))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, text_key, item_id, windows, coverage, agreement, changed) of each document and item of it found.

    A document holds an item if the windows they share are half of the item's, or cover ``RUN_WORDS`` words in a row, and
    if the slots agree, in one occurrence of the item or in the whole document; a document that holds an item twice with
    different values holds it. The occurrence with the most windows is told, an unchanged one first. ``changed`` is true where a slot's value differs, so the question was re-parameterised.
    ``text_key`` is a hash of the text; repeated rows are found once. Null and blank texts and items match nothing, and
    an item of fewer than ``MIN_WORDS`` words only a document of just these words; ids keep their type; a null id of either side stays null; an empty table on either side gives no rows. Windows of an item that
    occur several times are counted once. Other columns are not read.
    """
    items = benchmark.where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").alias("text")).distinct()
    windows = item_windows(items)
    texts = docs.where(F.col(f"`{text}`").isNotNull())
    texts = texts.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_key"), F.col(f"`{text}`").alias("text"))
    found = document_windows(texts, windows).withColumnsRenamed({"place": "doc_place", "slots": "doc_slots", "vals": "doc_vals"})
    per_item = windows.groupBy("item", "way").agg(F.countDistinct("place").alias("all"))
    met = stored(found.join(windows, ["way", "hash"]).where(F.col("slots") == F.col("doc_slots")), "met-windows")
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc"), "text_key", F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("of")]
    met = occurrences(met.select("*", *key))
    group = ["doc", "text_key", "of", "way", "kind", "at"]
    # each slot of the item, by its place, with the value it has in the document; the usual value of each item value
    pairs = met.select(*group, "place", F.inline(F.arrays_zip("slots", "vals", "doc_vals")))
    pairs = pairs.select(*group, (F.col("place") + F.col("slots")).alias("slot"), "vals", "doc_vals").distinct()
    usual = pairs.groupBy(*group, "vals", "doc_vals").agg(F.count("*").alias("n"))
    usual = usual.groupBy(*group, "vals").agg(F.max("n").alias("most"), F.sum("n").alias("n"), F.max(F.col("vals") != F.col("doc_vals")).alias("changed"))
    usual = usual.groupBy(*group).agg((F.sum("most") / F.sum("n")).alias("agreement"), F.max("changed").alias("changed"))
    hits = met.groupBy(*group).agg(
        F.array_sort(F.collect_set("place")).alias("places"), F.max("words").alias("words"), F.max("doc_id").alias("doc_id"), F.max("item").alias("item"),
    )
    hits = hits.withColumn("windows", F.size("places").cast("long"))  # at most as many as the item has words
    # places in a row at one alignment: so many words of the item stand in the document as they do in the item
    run = F.aggregate(
        "places", F.struct(F.lit(-2).alias("last"), F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, p: F.struct(p.alias("last"), F.when(p == a["last"] + 1, a["now"] + 1).otherwise(1).alias("now"), F.greatest(a["most"], F.when(p == a["last"] + 1, a["now"] + 1).otherwise(1)).alias("most")),
    )["most"]
    hits = hits.withColumn("run", F.when(F.col("kind") == ALIGNED, run).otherwise(0)).drop("places")
    hits = hits.join(per_item.withColumnRenamed("item", "own"), (F.col("item").eqNullSafe(F.col("own"))) & (hits["way"] == per_item["way"])).drop("own", per_item["way"])
    hits = hits.join(usual, group, "left").withColumn("agreement", F.coalesce("agreement", F.lit(1.0))).withColumn("changed", F.coalesce("changed", F.lit(False)))
    hits = hits.withColumn("coverage", F.col("windows") / F.col("all"))
    enough = (F.col("coverage") >= COVERAGE) | (F.col("run") >= RUN_WORDS - WIDTH + 1)
    hits = hits.where(enough & (F.col("agreement") >= AGREEMENT))
    best = hits.groupBy("doc", "text_key", "of").agg(F.max_by(F.struct("doc_id", "item", "windows", "coverage", "agreement", "changed"), F.struct("coverage", "windows", ~F.col("changed"), "agreement", "way")).alias("b"))
    return best.select(
        F.col("b.doc_id").alias("doc_id"), "text_key", F.col("b.item").alias("item_id"), F.col("b.windows").alias("windows"),
        F.col("b.coverage").alias("coverage"), F.col("b.agreement").alias("agreement"), F.col("b.changed").alias("changed"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **columns: str) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; cases as in :func:`contaminated`."""
    key, id_, hash_ = fresh(docs.columns, "text_key", "bad_id", "bad_key")
    bad = stored(contaminated(docs, benchmark, doc_id, text, **columns).select(F.col("doc_id").alias(id_), F.col("text_key").alias(hash_)).distinct(), "contaminated")
    marked = docs.withColumn(key, F.xxhash64(F.col(f"`{text}`")))
    out = marked.join(bad, F.col(f"`{doc_id}`").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(hash_)), "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
