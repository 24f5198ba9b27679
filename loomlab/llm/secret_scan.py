"""Secret scans: written patterns, and strings that stand a battery of tests for randomness.

Tokens of the alphabets that keys are written in are tested for uniform use of their inferred alphabet (chi-squared), for
the number of runs of its lower and upper half, and for serial correlation; a token's value is the smallest of the
three p-values, times three. Plain words are the decoys: how many of them stand the battery, by length, says how many
of the other tokens do so by chance. The bar of each length is the lowest that keeps the share of false finds small.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlab.llm.common import fresh, stored

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
HINT = re.compile(r"passw|secret|token|api", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # whole runs: a run is found from its first character
KINDS = ["assign", "access", "hex", "random"]
#: What the battery sees: tokens of key alphabets, and the pieces of a token between its separators.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{12,}")
PIECE = re.compile(r"[A-Za-z0-9]{12,}")
MIN_LENGTH = 12
#: Lower ends of the length classes.
LENGTHS = [12, 16, 20, 24, 32, 40, 48, 64, 96, 128]
#: Bars that a p-value can pass.
BARS = [0.001, 0.01, 0.05, 0.1, 0.25, 0.5]
#: Share of false finds that is allowed, and decoys that a length class must have to speak for itself.
FALSE_SHARE, DECOYS = 0.05, 50
#: Inferred encodings, the narrowest first: fixed alphabets in their order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
SETS = {name: frozenset(letters) for name, letters in ALPHABETS.items()}
RANKS = {name: np.array([letters.find(chr(b)) for b in range(256)], np.int64) for name, letters in ALPHABETS.items()}


def encoding(token: str) -> str | None:
    used = frozenset(token)
    return next((name for name, letters in SETS.items() if used <= letters), None)


def pieces(first: int, token: str) -> list[tuple[int, str]]:
    """(start, string) of what is tested of a token: all of it where one alphabet holds it, and its parts between separators.

    A key that hangs on path words by ``/``, ``-``, ``_`` or ``+`` is such a part; the bars of the length classes decide
    on short ones, and of nested finds the longest is told.
    """
    bare = token.strip("+/_-")
    out = [(m.start() + first, m[0]) for m in PIECE.finditer(token)]
    if len(bare) >= MIN_LENGTH and encoding(bare) and all(p != bare for _, p in out):
        out.append((first + token.index(bare), bare))
    return out


def is_decoy(token: str) -> bool:
    """A plain word: small letters, the first one may be a capital, or capitals alone."""
    return token.isalpha() and (token[1:].islower() or token.isupper())


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """P(Z >= z) of the normal distribution, to seven digits."""
    x = np.abs(z) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * series * np.exp(-x * x)
    return np.where(z >= 0, half, 1 - half)


def battery(tokens: list[str], alphabet: str) -> np.ndarray:
    """The p-value of each token against random symbols of the alphabet."""
    k = len(ALPHABETS[alphabet])
    n = np.array([len(t) for t in tokens], np.int64)
    x = RANKS[alphabet][np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
    owner = np.repeat(np.arange(len(n)), n)
    firsts = np.cumsum(n) - n
    times = np.bincount(owner * k + x, minlength=len(n) * k).reshape(len(n), k)
    chi = (times.astype(float) ** 2).sum(axis=1) * k / n - n
    # with few symbols per class the statistic has mean k - 1 and this variance
    uniform = _upper_tail((chi - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n))
    upper = (x >= k / 2).astype(np.int64)
    same_token = owner[1:] == owner[:-1]
    turns = np.bincount(owner[1:][same_token & (upper[1:] != upper[:-1])], minlength=len(n)) + 1
    ups = np.add.reduceat(upper, firsts)
    mean = 2 * ups * (n - ups) / n + 1
    spread = np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    runs = 2 * _upper_tail(np.abs(turns - mean) / np.sqrt(spread))
    runs = np.where((ups == 0) | (ups == n), 2.0 ** (1 - n.astype(float)), runs)
    away = x - np.repeat(np.add.reduceat(x, firsts) / n, n)
    power = np.maximum(np.add.reduceat(away * away, firsts), 1e-9)
    serial = np.bincount(owner[1:][same_token], weights=(away[1:] * away[:-1])[same_token], minlength=len(n)) / power
    serial = 2 * _upper_tail(np.abs(serial + 1 / n) * np.sqrt(n))
    return np.minimum(1, 3 * np.minimum(uniform, np.minimum(runs, serial)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the written patterns, leftmost and without overlaps in each kind."""
    out = []
    if HINT.search(text):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [(2, m.start(), m.end()) for m in HEX.finditer(text)]


def passed(p: np.ndarray) -> np.ndarray:
    """How many bars each p-value passes."""
    return np.searchsorted(BARS, p, side="right")


FOUND = (
    "struct<base:array<struct<kind:int,first:int,stop:int>>,tests:array<struct<first:int,stop:int,length:int,bars:int>>,"
    "seen:array<struct<length:int,decoy:boolean,bars:int,n:bigint>>>"
)


def scan_texts(texts: list[str]) -> tuple[list, list, dict]:
    """Of each text the base spans and the tested tokens (start, end, length class, bars passed); counts by class."""
    bases, tests = [base_spans(t) for t in texts], [[] for _ in texts]
    by: dict[str, list[tuple[int, int, str]]] = {}
    for i, text in enumerate(texts):
        for m in TOKEN.finditer(text):
            for first, token in pieces(m.start(), m[0]):
                if token.isdigit():  # a number, such as that of an order or a card, is no key
                    continue
                if is_decoy(token):
                    by.setdefault("base36", []).append((i, -1, token.lower()))
                elif name := encoding(token):
                    by.setdefault(name, []).append((i, first, token))
    seen: dict[tuple[int, bool, int], int] = {}
    for name, rows in by.items():
        for a in range(0, len(rows), 4096):
            part = rows[a : a + 4096]
            bars = passed(battery([t for _, _, t in part], name))
            lengths = np.searchsorted(LENGTHS, [len(t) for _, _, t in part], side="right") - 1
            for (i, first, token), length, bar in zip(part, lengths.tolist(), bars.tolist()):
                seen[length, first < 0, bar] = seen.get((length, first < 0, bar), 0) + 1
                if first >= 0:
                    tests[i].append((first, first + len(token), length, bar))
    return bases, tests, seen


def bars_by_length(seen: list[tuple[int, bool, int, int]]) -> list[int | None]:
    """For each length class the index of its bar; None where no bar keeps false finds rare.

    With r the share of decoys above a bar, F the tokens below it and D those above: random tokens fall below it in a
    share of the bar's own value a, the others in a share of 1 - r. So r / (1 - r) * (F - a (F + D)) of the D are false.
    A class with few decoys takes the next shorter class's r, which is no smaller as long tokens are told apart better.
    """
    counts = np.zeros((len(LENGTHS), 2, len(BARS) + 1))
    for length, decoy, bar, n in seen:
        counts[length, int(decoy), bar] += n
    above = counts[:, :, ::-1].cumsum(axis=2)[:, :, ::-1][:, :, 1:]  # passing at least the bar
    out: list[int | None] = []
    share = np.full(len(BARS), 0.99)
    for i in range(len(LENGTHS)):
        decoys = counts[i, 1].sum()
        if decoys >= DECOYS:
            share = np.minimum(share, np.minimum(0.99, (above[i, 1] + 1) / (decoys + 1)))
        total = counts[i, 0].sum()
        false = share / (1 - share) * np.maximum(0, total - above[i, 0] - np.array(BARS) * total)
        fits = [j for j in range(len(BARS)) if above[i, 0][j] and false[j] <= FALSE_SHARE * above[i, 0][j]]
        out.append(fits[0] if fits else None)
    return out


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256, n_random and spans.

    Spans are ``kind:start:end`` in code points, the end exclusive, by start and then in the order of KINDS, joined by
    commas. A random token inside a base span is not told twice. Null texts count as empty; texts without
    finds have the digest of the empty string and an empty ``spans``; repeated rows are found each; an empty table gives
    no rows. The new columns get a trailing ``_`` where ``docs`` has their name. The texts are tested once: the finds are
    stored with the columns of ``docs``, so leave out those that aren't needed, such as the text, by ``keep``.
    """
    keep = docs.columns if keep is None else keep
    names = fresh(docs.columns, "n_assign", "n_access", "n_hex", "base_sha256", "n_random", "spans", "found")

    @F.arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for i in range(0, len(texts), 256):
            part = [t or "" for t in texts.slice(i, 256).to_pylist()]
            bases, tests, seen = scan_texts(part)
            told = [{"length": a, "decoy": b, "bars": c, "n": n} for (a, b, c), n in seen.items()]
            for j in range(len(part)):  # a part's counts stand in its first row
                rows.append({
                    "base": [dict(zip(("kind", "first", "stop"), x)) for x in bases[j]],
                    "tests": [dict(zip(("first", "stop", "length", "bars"), x)) for x in tests[j]],
                    "seen": told if j == 0 else [],
                })
        return pa.array(rows, KIND)

    found = docs.select(*[F.col(f"`{c}`") for c in keep], find(F.col(f"`{text}`")).alias(names[6]))
    return finish(stored(found, "secret-spans"), names, keep)


KIND = pa.struct([
    ("base", pa.list_(pa.struct([("kind", pa.int32()), ("first", pa.int32()), ("stop", pa.int32())]))),
    ("tests", pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32()), ("length", pa.int32()), ("bars", pa.int32())]))),
    ("seen", pa.list_(pa.struct([("length", pa.int32()), ("decoy", pa.bool_()), ("bars", pa.int32()), ("n", pa.int64())]))),
])


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["first"], s["stop"])), ",")


def finish(found: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """The spans and counts, from the stored finds; the bars come from the counts of all texts."""
    counts = found.select(F.inline(F.col(names[6])["seen"])).groupBy("length", "decoy", "bars").agg(F.sum("n").alias("n")).collect()
    bars = bars_by_length([tuple(r) for r in counts])
    bar = F.array(*[F.lit(b + 1 if b is not None else len(BARS) + 1) for b in bars])
    base, tests = F.col(names[6])["base"], F.col(names[6])["tests"]
    inside = lambda t: F.exists(base, lambda b: (b["first"] <= t["first"]) & (t["stop"] <= b["stop"]))
    taken = F.filter(tests, lambda t: (t["bars"] >= F.element_at(bar, t["length"] + 1)) & ~inside(t))
    within = lambda t, u: (u["first"] <= t["first"]) & (t["stop"] <= u["stop"]) & ((u["first"] < t["first"]) | (t["stop"] < u["stop"]))
    taken = F.filter(taken, lambda t: ~F.exists(taken, lambda u: within(t, u)))
    taken = F.transform(taken, lambda t: F.struct(F.lit(3).alias("kind"), t["first"].alias("first"), t["stop"].alias("stop")))
    of = lambda k: F.size(F.filter(base, lambda b: b["kind"] == k)).cast("long")
    values = [of(0), of(1), of(2), F.sha2(_shown(base), 256), F.size(taken).cast("long"), _shown(F.concat(base, taken))]
    return found.select(*[F.col(f"`{c}`") for c in columns], *[v.alias(n) for v, n in zip(values, names)])
