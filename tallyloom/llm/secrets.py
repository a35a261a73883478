"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests takes for keys.

The battery looks at runs of key characters, each side of an inner ``=`` for itself. For each string it infers the encoding (the smallest alphabet
that holds the run: decimal, hex, base 32, letters and digits, base 64) and asks how a random string over that
alphabet would look: chi-squared uniformity of the symbols, runs above and below the middle of the
alphabet, and serial correlation of neighbours. Fisher's sum of the three log p-values is the
string's distance from randomness; small is random.

What is found must be told from words, so its null distribution is words: the distances of all letters of
every text (without words that hold a digit), cut into consecutive strings of the length of each class, as a
histogram with a fixed number of bins. A run's p-value is the share of its length class that look at least as
random, smoothed by the p-value of the next shorter class as if that were ``SHORTER`` strings more. Within each length class, for strings with a digit and
without one each, the Benjamini-Hochberg rule holds the share of false discoveries below ``FALSE_SHARE``; it needs only the counts of the bins, so all of the corpus is counted and nothing
but bins is collected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import base

KINDS = ("assign", "access", "hex", "random")
# The base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
VALUE = re.compile(r"[A-Za-z0-9+/_-]+(?:=+(?![A-Za-z0-9+/_-]))?")
PIECES = re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*"), re.compile(r"[A-Za-z0-9]+=*")
DIGITS = re.compile(r"(?<!\S)[^\s\d]*+\d\S*")
NOT_LETTERS = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())
NULL, WITH_DIGIT, NO_DIGIT = range(3)
"""Groups of counted strings: letters of the texts, and the candidates, which are many more without digits."""

ALPHABETS = {
    "decimal": "0123456789", "hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum_upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "alnum_lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: For each byte a bit for each alphabet that has it, and its place in each.
HELD = np.array([sum(1 << i for i, x in enumerate(ALPHABETS.values()) if chr(b) in x) for b in range(256)])
PLACES = np.array([[max(0, x.find(chr(b))) for b in range(256)] for x in ALPHABETS.values()])
BINS, BIN = 400, 0.1
FALSE_SHARE = 0.01
SHORTER = 300
"""For how many strings of a length class the distribution of the next shorter class counts."""
CLASSES = (16, 20, 24, 32, 48, 64, 128)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the fixed patterns: leftmost, not overlapping within a kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [(m.start(), m.end(), 2) for m in HEX.finditer(text)]


def encoding(run: str) -> str | None:
    """The smallest alphabet that holds the run; padding does not count."""
    symbols = set(run.rstrip("="))
    return next((name for name, letters in ALPHABETS.items() if symbols and symbols <= set(letters)), None)


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def distance(run: str, name: str) -> float:
    """Fisher's -2 * sum of log p of the three tests under randomness over the alphabet."""
    letters = ALPHABETS[name]
    x = [letters.index(c) for c in run.rstrip("=") if c in letters]
    n, k = len(x), len(letters)
    seen = np.bincount(x, minlength=k)
    chi = float(((seen - n / k) ** 2).sum() * k / n)  # one cell a symbol: repeated letters tell words from keys
    cube = ((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
    uniform = 0.5 * math.erfc(cube / math.sqrt(2))
    high = [v * 2 >= k for v in x]
    up = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    if 0 < up < n:
        mean = 1 + 2 * up * (n - up) / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        runs_p = _tail((runs - mean) / spread)
    else:
        runs_p = 2.0 ** (1 - n)
    v = np.array(x, float) - np.mean(x)
    serial = float((v[1:] * v[:-1]).sum() / max((v * v).sum(), 1e-9))
    serial_p = _tail((serial + 1 / n) * math.sqrt(n))
    return -2 * sum(math.log(max(p, 1e-12)) for p in (uniform, runs_p, serial_p))


def length_class(n: int) -> int:
    return max((c for c in CLASSES if c <= n), default=CLASSES[0])


def parts(run: str) -> list[tuple[int, int]]:
    """``(start, end)`` of the strings of a run to test, of the shortest length class at least.

    Names and values part at ``=``; padding stays with its value. What no alphabet holds mixes the signs of
    base 64 with those of base64url: it is cut at the ones, at the others, and at both.
    """
    out = set()
    for value in VALUE.finditer(run):
        if encoding(value[0]):
            out.add(value.span())
            continue
        for piece in PIECES:
            out |= {(value.start() + m.start(), value.start() + m.end()) for m in piece.finditer(value[0])}
    return sorted((a, b) for a, b in out if len(run[a:b].rstrip("=")) >= CLASSES[0])


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """``(start, end, group, class, bin)`` of strings that no fixed pattern touches, with a digit or without.

    Strings of digits only (card and order numbers) are identifiers and no keys.
    """
    out = []
    for m in RUN.finditer(text):
        for a, b in parts(m[0]):
            run, a, b = m[0][a:b], m.start() + a, m.start() + b
            if run.rstrip("=").isdigit() or any(x < b and a < y for x, y, _ in spans):
                continue
            group = WITH_DIGIT if any(c.isdigit() for c in run) else NO_DIGIT
            out.append((a, b, group, length_class(len(run)), min(BINS - 1, int(distance(run, encoding(run)) / BIN))))
    return out


def plain(text: str) -> bytes:
    """All letters of the text's words without digits."""
    return DIGITS.sub(" ", text).encode("ascii", "ignore").translate(None, NOT_LETTERS)


def distances(rows: np.ndarray) -> np.ndarray:
    """``distance`` under ``encoding`` of strings of one length: a matrix of bytes, a row each, that some alphabet holds."""
    m, n = rows.shape
    which = np.bitwise_and.reduce(HELD[rows], axis=1)
    out = np.zeros(m)
    for bit, letters in enumerate(ALPHABETS.values()):
        own = np.flatnonzero(which & -which == 1 << bit)  # the first alphabet that holds all symbols
        if not len(own):
            continue
        k, x = len(letters), PLACES[bit][rows[own]]
        seen = np.bincount((x + k * np.arange(len(own))[:, None]).ravel(), minlength=len(own) * k).reshape(-1, k)
        chi = (seen * seen).sum(1) * k / n - n
        cube = (np.cbrt(chi / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))
        high = x * 2 >= k
        up, runs = high.sum(1), 1 + (high[:, 1:] != high[:, :-1]).sum(1)
        mean = 1 + 2 * up * (n - up) / n
        spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        runs_p = np.where((up > 0) & (up < n), _erfc(np.abs(runs - mean) / spread / math.sqrt(2)), 2.0 ** (1 - n))
        v = x - x.mean(1, keepdims=True)
        serial = (v[:, 1:] * v[:, :-1]).sum(1) / np.maximum((v * v).sum(1), 1e-9)
        serial_p = _erfc(np.abs(serial + 1 / n) * math.sqrt(n / 2))
        out[own] = -2 * sum(np.log(np.maximum(p, 1e-12)) for p in (0.5 * _erfc(cube / math.sqrt(2)), runs_p, serial_p))
    return out


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.fromiter(map(math.erfc, x.tolist()), float, len(x))


def null_counts(texts: list[str | None]) -> dict[int, np.ndarray]:
    """For each length class how many strings of each bin all letters of the texts make, cut one after the other."""
    letters = [plain(t) for t in texts if t]
    out = {}
    for c in CLASSES:
        rows = np.frombuffer(b"".join(x[: len(x) // c * c] for x in letters), np.uint8).reshape(-1, c)
        out[c] = np.zeros(BINS, np.int64)
        for some in np.array_split(rows, max(1, rows.size // 100_000)):
            out[c] += np.bincount(np.minimum(BINS - 1, (distances(some) / BIN).astype(np.int64)), minlength=BINS)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Histogram rows (group, class, bin, n) of a task's texts."""
    counts: dict[tuple, int] = {}
    for batch in base.slices(batches, "text"):
        texts = batch.column("text").to_pylist()
        for c, bins in null_counts(texts).items():
            for place in np.flatnonzero(bins).tolist():
                counts[NULL, c, place] = counts.get((NULL, c, place), 0) + int(bins[place])
        for text in texts:
            for *_, group, size, place in candidates(text or "", base_spans(text or "")):
                counts[group, size, place] = counts.get((group, size, place), 0) + 1
    group, size, place = zip(*counts, strict=True) if counts else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(size, pa.int32()), pa.array(place, pa.int32()),
                                      pa.array(list(counts.values()), pa.int64())], ["group", "size", "bin", "n"])


def limits(rows: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], int]:
    """For each group and length class the last bin that Benjamini-Hochberg takes as keys, -1 for none."""
    counts = {(g, c): np.zeros(BINS) for g in (NULL, WITH_DIGIT, NO_DIGIT) for c in CLASSES}
    for group, size, place, n in rows:
        counts[group, size][place] += n
    out, p, weight = {}, np.ones(BINS), 1
    for c in CLASSES:  # the next shorter words count for some of this length: they look more random
        p = (np.cumsum(counts[NULL, c]) + weight * p) / (counts[NULL, c].sum() + weight)
        weight = SHORTER
        for group in (WITH_DIGIT, NO_DIGIT):
            taken = np.cumsum(counts[group, c])
            good = np.flatnonzero((taken > 0) & (p <= FALSE_SHARE * taken / max(taken[-1], 1)))
            out[group, c] = int(good[-1]) if len(good) else -1
    return out


def _outermost(found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the random kind without those that lie inside another: one string cut in several ways counts once."""
    out: list[tuple[int, int, int]] = []
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b, 3))
    return out


def _scan(kept: list[str], shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch in batches:
            out = []
            for text in batch.column("_text").to_pylist():
                spans = base_spans(text or "")
                spans += _outermost([(a, b) for a, b, group, size, place in candidates(text or "", spans) if place <= last[group, size]])
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, kind)], [*kept, "found"])
    return run


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, found)``: spans (kind, start, end) of every row's text in code points, by start, then kind.

    Kinds: ``assign``, ``access`` and ``hex`` by pattern, ``random`` by the battery. A null or empty text has
    none. All rows come back as often as given; repeated texts count each time in the statistics.
    """
    slim = docs.select(F.col(key), F.col(text).alias("_text"))
    counted = slim.select(F.col("_text").alias("text")).mapInArrow(_count, "group int, size int, bin int, n long")
    rows = counted.groupBy("group", "size", "bin").agg(F.sum("n").alias("n")).collect()  # at most 3 * classes * BINS rows
    shared = docs.sparkSession.sparkContext.broadcast(limits([tuple(r) for r in rows]))
    kind = "found array<struct<kind: string, start: long, end: long>>"
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(kind).fields])
    return slim.mapInArrow(_scan([key], shared), schema)


def joined(found: str = "found", kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the spans of some kinds, joined by commas."""
    own = F.filter(F.col(found), lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    spans = find_secrets(docs, key, text)
    return spans.select(
        key, *[F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(kinds=KINDS[:3]), 256).alias("base_sha256"), joined().alias("spans"))
