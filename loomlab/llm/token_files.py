"""Token ids as Arrow files: fixed-size lists of ids and masks that readers map and address without copying.

One shard is a pair of Arrow IPC files. ``<shard>.arrow`` has record batches of ``BATCH`` rows, each row a sequence of
``length`` ids (``input_ids``) and as many mask bits (``mask``, set for an id and not for padding); ids of a vocabulary
below 65,536 take two bytes. All batches but the last
are equally long, so sequence ``i`` is row ``i % BATCH`` of batch ``i // BATCH``. ``<shard>.index.arrow`` tells for each
document its id, where its ids begin in the shard, and how many there are. Documents follow one another without gaps;
only a shard's last sequence is padded.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomlab.llm.common import stored
from loomlab.llm.files import place
from loomlab.session import qualified, scratch

#: Sequences in a record batch.
BATCH = 256
#: Texts are handed to the tokenizer in parts of about so many bytes; a longer text is a part of its own.
PART_BYTES = 1 << 21
#: Words that a task remembers the ids of; the memory is emptied when it is full.
REMEMBERED = 800_000
#: What the tokenizer never splits: Latin letters in lower case, or punctuation.
UNSPLIT = re.compile(r"[a-zß-öø-ÿ]+|[.,;:!?]+")
#: Punctuation between a letter and white space, which the tokenizer takes for a token of its own.
TRAILING = "([a-zß-öø-ÿ])([.,;:!?]+)([ \\t\\n\\v\\f\\r]|$)"
#: Letters whose lower case Arrow and the tokenizer may see differently; such texts are only split.
FOREIGN = "[\u0130\u0250-\U0010ffff]"


class WordTokenizer:
    """Ids of whole texts, for tokenizers that lower case, drop white space, and treat the words between on their own.

    Texts are split at ASCII white space, and the distinct words of a part are looked up. The ids of each word are kept
    in one flat array, so that a text's ids are gathered by array operations. New words that the tokenizer doesn't split
    are handed to it as one text, which is cut again behind the tokens that end a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # the tokenizer looks for its control strings before it lower cases, so a text with one in capitals stays as it is
        control = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.foreign = "|".join([FOREIGN, *(f"(?i:{re.escape(c)})" for c in control)])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.offsets, self.sizes = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, need = len(self.known), len(self.known) + len(words)
        if need > len(self.offsets):
            more = np.empty(need, np.int32)
            self.offsets, self.sizes = np.concatenate([self.offsets, more]), np.concatenate([self.sizes, more])
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(self.used + len(ids), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.offsets[first:need] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first:need] = sizes
        self.known.update(zip(words, range(first, need)))
        self.used += len(ids)

    def learn(self, words: list[str]) -> None:
        whole = [w for w in words if UNSPLIT.fullmatch(w)]
        ids = np.array(self.encode([" ".join(whole)])[0], np.uint32)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(whole):
            self.keep(whole, ids, np.diff(stops, prepend=0))
        rest = [w for w in words if w not in self.known]
        lists = self.encode(rest)
        self.keep(rest, np.fromiter((i for x in lists for i in x), np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text)"""
        if len(self.known) > REMEMBERED:
            self.forget()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        foreign = pc.match_substring_regex(texts, self.foreign)
        texts = pc.if_else(foreign, texts, pc.replace_substring_regex(pc.utf8_lower(texts), TRAILING, r"\1 \2\3"))
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if new:
            self.learn(new)
        known = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        at = known[coded.indices.to_numpy()]
        sizes, offsets = self.sizes[at], self.offsets[at]
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int32)))  # a text has fewer ids than bytes
        flat = self.flat[np.repeat(offsets - ends[:-1].astype(np.int32), sizes) + np.arange(ends[-1], dtype=np.int32)]
        stops = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        return flat, np.diff(ends[np.concatenate(([0], stops)).astype(np.int64)]).astype(np.int64)


@lru_cache(maxsize=1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts, about PART_BYTES at a time."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    at = 0
    while at < len(texts):
        total = np.cumsum(sizes[at:])
        n = max(1, int(np.searchsorted(total, PART_BYTES, side="right")))
        yield texts.slice(at, n)
        at += n


class Shard:
    """One shard in the making: sequences are written as they fill, under a name of this attempt only."""

    def __init__(self, folder: str, length: int, largest_id: int):
        self.kind = np.uint16 if largest_id < 1 << 16 else np.uint32
        self.files, self.folder = place(folder)
        self.name, self.length = uuid.uuid4().hex, length
        self.left, self.tokens, self.index = np.empty(0, self.kind), 0, []
        fixed = lambda kind: pa.list_(pa.field("item", kind, nullable=False), length)
        self.schema = pa.schema([pa.field("input_ids", fixed(pa.from_numpy_dtype(self.kind))), pa.field("mask", fixed(pa.bool_()))])
        self.files.create_dir(self.folder, recursive=True)
        self.out = self.files.open_output_stream(f"{self.folder}/{self.name}.arrow")
        self.writer = pa.ipc.new_file(self.out, self.schema)

    def sequences(self, ids: np.ndarray, mask: np.ndarray) -> None:
        cell = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(0 if x is ids else 1).type)
        self.writer.write_batch(pa.RecordBatch.from_arrays([cell(ids), cell(mask)], schema=self.schema))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.tokens + np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.index.append((doc_ids, pa.array(starts), pa.array(sizes)))
        self.tokens += len(ids)
        self.left = np.concatenate([self.left, ids.astype(self.kind)])
        step = BATCH * self.length
        whole = len(self.left) // step * step
        for i in range(0, whole, step):
            self.sequences(self.left[i : i + step], np.ones(step, bool))
        self.left = self.left[whole:]

    def close(self) -> None:
        size = -(-len(self.left) // self.length) * self.length
        if size:
            ids, mask = np.zeros(size, self.kind), np.zeros(size, bool)
            ids[: len(self.left)], mask[: len(self.left)] = self.left, True
            self.sequences(ids, mask)
        self.writer.close()
        self.out.close()
        columns = [pa.concat_arrays(x) for x in zip(*self.index)]
        table = pa.table(dict(zip(("doc_id", "start", "n_tokens"), columns)))
        with self.files.open_output_stream(f"{self.folder}/{self.name}.index.arrow") as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table, max_chunksize=1 << 16)


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, length: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts in ascending order of id; returns the stored list of shards.

    Rows are dealt by ranges of (id, text), so equal rows may meet in one range but their order never matters, and each
    task writes one shard. The list names only shards of tasks that ended well, so what a lost or repeated task left
    behind is never read. The list has shard, place (the order of shards), documents and tokens.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    spread = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), spread.asc()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), spread.asc(), "text")
    rows = rows.withColumn("place", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, number = tokenizer(tokenizer_path), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if shard is None:
                shard, number = Shard(folder, length, max(end_id, len(encoder.ends) - 1)), batch.column("place")[0].as_py()
            doc_ids, at = batch.column("doc_id"), 0
            for texts in parts(batch.column("text")):
                ids, sizes = encoder.ids(texts)
                ends = np.cumsum(sizes)
                shard.add(doc_ids.slice(at, len(texts)), np.insert(ids, ends, np.uint32(end_id)), sizes + 1)
                at += len(texts)
        if shard is not None:
            shard.close()
            pa.default_memory_pool().release_unused()
            n = sum(len(x[0]) for x in shard.index)
            yield pa.RecordBatch.from_pydict({"shard": [f"{folder}/{shard.name}"], "place": pa.array([number], pa.int32()), "documents": pa.array([n], pa.int64()), "tokens": pa.array([shard.tokens], pa.int64())})

    return stored(rows.mapInArrow(write, "shard string, place int, documents long, tokens long"), "shards")


def open_arrow(path: str) -> pa.ipc.RecordBatchFileReader:
    """A shard's file: mapped into memory where it is a local or mounted file, else read by ranges."""
    files, inner = place(path)
    return pa.ipc.open_file(pa.memory_map(inner) if isinstance(files, pyarrow.fs.LocalFileSystem) else files.open_input_file(inner))


def span(reader: pa.ipc.RecordBatchFileReader, start: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of ``count`` tokens from ``start``: touches only the batches that hold them."""
    length = reader.schema.field("input_ids").type.list_size
    step, ids, mask, stop = BATCH * length, [], [], start + count
    while start < stop:
        batch = reader.get_batch(start // step)
        a, b = start % step, min(step, start % step + stop - start)
        ids.append(batch.column(0).values.to_numpy()[a:b])
        mask.append(batch.column(1).values.slice(a, b - a).to_numpy(zero_copy_only=False))
        start += b - a
    return (ids[0], mask[0]) if len(ids) == 1 else (np.concatenate(ids), np.concatenate(mask))


def read_back(shards: DataFrame, id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files of the listed shards.

    ``start`` counts the ids of all documents before it, in all shards before its own. One row per shard is all that the
    window without a partition sees.
    """
    ahead = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    listed = shards.withColumn("ahead", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)))
    listed = stored(listed.select("shard", "ahead"), "shard-starts")
    listed = listed.repartition(max(1, shards.count()), "shard")  # files are read in tasks of their own, small as the list is

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, index = open_arrow(f"{shard}.arrow"), open_arrow(f"{shard}.index.arrow")
                for i in range(index.num_record_batches):
                    rows = index.get_batch(i)
                    sums = []
                    for start, n in zip(rows.column("start").to_pylist(), rows.column("n_tokens").to_pylist()):
                        ids, mask = span(data, start, n)
                        if not mask.all():
                            raise ValueError(f"{shard}: padding inside a document")
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    starts = pc.add(rows.column("start"), before)
                    yield pa.RecordBatch.from_arrays([rows.column("doc_id"), starts, rows.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 2048, folder: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` as token files and returns what the files say about each document.

    Null and empty texts have the end id alone. Null ids come first; rows with equal ids follow one another in order of
    a hash of their text, then the text. Other columns are not read. An empty table writes no shard and gives no rows.
    """
    folder = qualified(docs.sparkSession, folder or scratch(docs.sparkSession, "token-files"))
    return read_back(write_shards(docs, folder, tokenizer_path, end_id, length, doc_id, text), docs.schema[doc_id].dataType.simpleString())
