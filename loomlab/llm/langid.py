"""Language ID: each document as a mixture of languages, its proportions estimated by expectation maximisation.

Each language has a distribution over hashed byte trigrams, counted over all learning documents. A document is cut into
segments of ``SEGMENT`` trigrams; a segment has a likelihood under each language, and the document's proportions
maximise the likelihood of the mixture. Of the nested sets of its strongest languages the document gets the one whose
likelihood, less a penalty for each further language, is best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlab.llm.common import fresh

#: Trigrams are hashed into so many buckets; a model has one number for each bucket and language.
BUCKETS = 1 << 16
SEGMENT = 48
#: Texts are worked on in parts of about so many bytes divided by the number of languages.
PART = 1 << 23
#: Added to every count.
SMOOTHING = 0.5
#: Natural log units that a further language must gain, beside half the log of the number of segments.
PENALTY = 12.0
ROUNDS = 25
UNKNOWN = "und"
#: Bound of the model that the tasks hold: ``BUCKETS`` floats for each language, so 128 MB in all.
MOST_LANGUAGES = 512
#: ASCII characters other than letters become spaces.
PLAIN = bytes(b if b >= 128 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """The hashed trigrams of the bytes of a text in lower case, with a space at either end."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(PLAIN) + b" ", np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.uint32)
    return ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2_654_435_761)) >> np.uint32(16)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows (text, lang): added up in the tasks, so that a task sends each number once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for i in range(0, batch.num_rows, 256):
                for lang, text in zip(langs[i : i + 256], batch.column("text").slice(i, 256).to_pylist()):
                    total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    grams = trigrams(text)
                    if len(grams) > BUCKETS // 8:
                        total += np.bincount(grams, minlength=BUCKETS)
                    else:
                        np.add.at(total, grams, 1)
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some])], ["lang", "bucket", "n"])

    return docs.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by bucket and language) from rows (text, lang).

    The driver gets one number for each bucket and language, whatever the number of documents. More languages than
    ``MOST_LANGUAGES`` are a ValueError, raised before any text is read: such values are no languages.
    """
    known = docs.select("lang").where(F.col("lang").isNotNull()).distinct().limit(MOST_LANGUAGES + 1).count()
    if known > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn from")
    rows = counts(docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang"))
    table = rows.toArrow()
    names = np.array(table.column("lang").to_pylist(), object)
    langs = sorted(set(names))
    model = np.zeros((BUCKETS, len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    model[table.column("bucket").to_numpy(), [place[n] for n in names]] = table.column("n").to_numpy()
    model = np.log((model + SMOOTHING) / (model + SMOOTHING).sum(axis=0))
    return langs, model.astype(np.float32)


def segment_likelihoods(grams: list[np.ndarray], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihoods by segment and language, first segment of each document); each document has a trigram at least."""
    sizes = np.array([-(-len(g) // SEGMENT) for g in grams])
    firsts = np.cumsum(sizes) - sizes
    out, step = np.empty((sizes.sum(), model.shape[1])), SEGMENT * max(1, (1 << 20) // model.shape[1] // SEGMENT)
    for g, first in zip(grams, firsts):
        for i in range(0, len(g), step):
            part = g[i : i + step]
            at = first + i // SEGMENT
            sums = np.add.reduceat(model[part], np.arange(0, len(part), SEGMENT), axis=0, dtype=np.float64)
            out[at : at + len(sums)] = sums
    return out, firsts


def proportions(like: np.ndarray, firsts: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihood) of each document by expectation maximisation from ``start``; zeros stay zeros."""
    sizes = np.diff(np.append(firsts, len(like)))
    best = like.max(axis=1, keepdims=True)
    odds, share = np.exp(like - best), start
    for _ in range(rounds):
        part = odds * np.repeat(share, sizes, axis=0)
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        share = np.add.reduceat(part, firsts, axis=0) / sizes[:, None]
    # a segment of which no chosen language explains anything keeps a finite likelihood
    mixed = np.log(np.maximum((odds * np.repeat(share, sizes, axis=0)).sum(axis=1), 1e-300))
    return share, np.add.reduceat(mixed, firsts)


def choose(like: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Each document's proportions over the language set of the best penalised likelihood."""
    n, k = len(firsts), like.shape[1]
    sizes = np.diff(np.append(firsts, len(like)))
    full, _ = proportions(like, firsts, np.full((n, k), 1 / k))
    # rank 0: the strongest language; ties by the total likelihood, then in order of the languages
    total = np.add.reduceat(like, firsts, axis=0)
    rank = np.empty((n, k), int)
    np.put_along_axis(rank, np.lexsort((np.broadcast_to(np.arange(k), (n, k)), -total, -np.round(full, 9)), axis=1), np.arange(k)[None], axis=1)
    best = np.zeros((n, k))
    score = np.full(n, -np.inf)
    for m in range(1, k + 1):
        fine = (m - 1) * (PENALTY + 0.5 * np.log(sizes))
        # likelihoods are relative to the best language of each segment, so no mixture has more than 0
        open_ = np.flatnonzero(-fine > score)
        if not len(open_):
            continue
        some = like if len(open_) == n else like[np.repeat(np.isin(np.arange(n), open_), sizes)]
        at = np.cumsum(sizes[open_]) - sizes[open_]
        start = np.where(rank[open_] < m, np.maximum(full[open_], 1e-6), 0)
        share, value = proportions(some, at, start / start.sum(axis=1, keepdims=True), ROUNDS if m > 1 else 0)
        value = value - fine[open_]
        better = value > score[open_]
        best[open_[better]], score[open_[better]] = share[better], value[better]
    return best


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode category L): numbers such as ½ and Ⅷ are none."""
    return any(map(str.isalpha, text))


def predictor(docs: DataFrame, langs: list[str], model: np.ndarray, text: str):
    """A column function: struct (lang_pred, score, mixture) of a text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,mixture:string>")
    def udf(texts: pa.Array) -> pa.Array:
        table, answer = shared.value, []

        def flush(part: list[tuple[int, np.ndarray]]) -> None:
            if part:
                share = choose(*segment_likelihoods([g for _, g in part], table))
                for (i, _), p in zip(part, share):
                    shown = sorted(((float(v), langs[j]) for j, v in enumerate(p) if v >= 0.005), key=lambda x: (-x[0], x[1]))
                    answer[i] = (langs[int(p.argmax())], min(1.0, float(p.max())), ",".join(f"{x}:{v:.2f}" for v, x in shown))

        part, held = [], 0
        for i in range(0, len(texts), 256):
            for t in texts.slice(i, 256).to_pylist():
                answer.append((UNKNOWN, 0.0, ""))
                if t and langs and has_letter(t):
                    part.append((len(answer) - 1, trigrams(t)))
                    held += len(part[-1][1])
                    if held > PART // len(langs):
                        flush(part)
                        part, held = [], 0
        flush(part)
        columns = [pa.array(x, k) for x, k in zip(zip(*answer), (pa.string(), pa.float64(), pa.string()))] if answer else [pa.array([], k) for k in (pa.string(), pa.float64(), pa.string())]
        return pa.StructArray.from_arrays(columns, ["lang_pred", "score", "mixture"])

    return udf(F.col(f"`{text}`"))


def held_out(doc_id: Column) -> Column:
    """Whether a document must not be learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with held_out, lang_pred, score and mixture.

    Learns from the texts of the documents with a ``lang`` that are not held out, and predicts from the text alone.
    ``lang_pred`` is the language of the largest proportion and ``score`` this proportion; a text that is null or has no
    letter, or any text if nothing was learned, is ``und`` with score 0. Equal texts get equal answers. More values of
    ``lang`` than ``MOST_LANGUAGES`` are an error. An empty table gives no rows. The new columns get a trailing ``_`` where ``docs`` has their name.
    """
    out = held_out(F.col(f"`{doc_id}`"))
    langs, model = fit(docs.where(~out).select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")))
    names = fresh(docs.columns, "held_out", "lang_pred", "score", "mixture", "answer")
    found = docs.withColumn(names[0], out).withColumn(names[4], predictor(docs, langs, model, text))
    for name, field in zip(names[1:4], ("lang_pred", "score", "mixture")):
        found = found.withColumn(name, F.col(names[4])[field])
    return found.drop(names[4])


def accepted(docs: DataFrame, min_score: float = 0.4, **columns: str) -> DataFrame:
    """The rows of ``docs`` whose language is found: not ``und``, and of a proportion of ``min_score`` at least."""
    _, pred, score = fresh(docs.columns, "held_out", "lang_pred", "score")
    found = identify(docs, **columns)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
