"""Byte-pair encoding as a deterministic automaton over tokens, and decoding by its arc labels.

The automaton reads token sequences and accepts exactly those that byte-pair merging produces. It
starts as one state with a loop for every single byte. Each merge ``a b -> ab``, in order of rank, adds
a gadget: the state behind ``a`` splits off a copy without its ``b`` arc, every state with an ``a`` arc
gets an ``ab`` arc beside it, and the state behind ``ab`` starts as a copy of the one behind ``b``. All
arcs with one label end in one state, so a state is named by the token read last, and copies are kept
as copy-on-write: a state knows what it was copied from and when, and the one arc each gadget removed is
a row of a table. Whether an arc is there is read by going back through copies to the two bytes at
the start; arcs met once are kept in a transition table, so all but a few are one look-up.

A word is encoded by running the automaton over its bytes: at each byte exactly one token that ends
there continues the path, as a prefix of a word has one encoding. All distinct words of a batch run
at once, byte by byte, in numpy. The byte automaton that finds tokens (a trie) and the merge table
are compiled once on the driver and sent to the tasks; both are bounded by the vocabulary file.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm import base

NEVER = np.int32(2**31 - 1)
TABLE_BITS = 21
"""Transitions kept by a task: a direct-mapped table of 2**TABLE_BITS entries."""
KNOWN_WORDS = 300_000
"""Distinct segments (mostly words) whose tokens a task keeps before it starts anew."""

# The format's pre-split pattern, and its printable stand-ins for bytes.
PRE_SPLIT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
             r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The byte of each stand-in character: printable ones stand for themselves, the rest from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


class Hashed:
    """A fixed map from non-negative 64-bit keys to 32-bit values, looked up in bulk."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, missing, np.int32)
        self.missing = missing
        at, todo = _slots(keys, self.bits), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] < 0
            _, first = np.unique(at[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = _slots(keys, self.bits)
        out = np.full(len(keys), self.missing, np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self.keys[at]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            more = ~hit & (there >= 0)
            open_, at = open_[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out


@dataclass
class Automaton:
    """Compiled tables: gadgets by token, removed arcs, the byte trie."""

    made: np.ndarray  # rank of the gadget that made a token, -1 for a byte
    left: np.ndarray
    right: np.ndarray
    removed: Hashed  # (state, token) -> rank of the gadget that removed the arc
    step: Hashed  # (trie node, byte) -> node
    token: np.ndarray  # token that ends at a trie node, -1 if none
    special: dict[str, int]

    def __post_init__(self):
        self.seen = np.full(1 << TABLE_BITS, -1, np.int64)

    def _arc(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether the state behind ``u`` has an arc ``t`` once all gadgets are in."""
        ok = np.ones(len(u), bool)
        before = np.full(len(u), NEVER, np.int32)
        at = np.arange(len(u))
        while len(at):
            gone = self.removed.get(u.astype(np.int64) << 32 | t) < before
            ok[at[gone]] = False
            a, b = self.made[u], self.made[t]
            on = ~gone & ((a >= 0) | (b >= 0))
            at, u, t, a, b = at[on], u[on], t[on], a[on], b[on]
            # an arc made last stands beside its left part's, a state made last copies its right part's
            before = np.where(a >= b, a, b + 1).astype(np.int32)
            u, t = np.where(a >= b, self.right[u], u), np.where(b >= a, self.left[t], t)
        return ok

    def arc(self, u: np.ndarray, t: np.ndarray) -> np.ndarray:
        key = u.astype(np.int64) << 32 | t
        slot = _slots(key, TABLE_BITS)
        kept = self.seen[slot]
        out = (kept & 1).astype(bool)
        new = np.flatnonzero(kept >> 1 != key)
        if len(new):
            out[new] = self._arc(u[new], t[new])
            self.seen[slot[new]] = key[new] << 1 | out[new]
        return out

    def encode_words(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each word, flat, with word offsets."""
        size = np.array([len(x) for x in found], np.int64)
        by = np.argsort(-size, kind="stable")
        size = size[by]
        data = np.frombuffer(b"".join(found[i] for i in by), np.uint8)
        place = np.concatenate([[0], np.cumsum(size + 1)])[:-1]  # a word has one more border than bytes
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        last = np.full(int((size + 1).sum()), -1, np.int32)
        back = np.zeros(len(last), np.int32)
        word, start, node = (np.zeros(0, np.int64) for _ in range(3))
        for i in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -i, "left"))  # words longer than i bytes
            on = word < live
            word = np.concatenate([word[on], np.arange(live)])
            start = np.concatenate([start[on], np.full(live, i)])
            node = np.concatenate([node[on], np.zeros(live, np.int64)])
            node = self.step.get(node << 8 | data[first[word] + i]).astype(np.int64)
            on = node >= 0
            word, start, node = word[on], start[on], node[on]
            tok = self.token[node]
            ends = np.flatnonzero(tok >= 0)
            w, s, tok = word[ends], start[ends], tok[ends]
            good = s == 0
            inner = np.flatnonzero(~good)
            good[inner] = self.arc(last[place[w[inner]] + s[inner]], tok[inner])
            last[place[w[good]] + i + 1] = tok[good]
            back[place[w[good]] + i + 1] = s[good]
        ends, owner, out = size.copy(), np.arange(len(size)), []
        while len(owner):
            on = ends > 0
            ends, owner = ends[on], owner[on]
            out.append((owner, ends, last[place[owner] + ends]))
            ends = back[place[owner] + ends].astype(np.int64)
        owner, ends, tok = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        owner = by[owner]
        tidy = np.lexsort((ends, owner))
        counts = np.bincount(owner, minlength=len(found))
        return tok[tidy].astype(np.int32), np.concatenate([[0], np.cumsum(counts)])


@lru_cache(maxsize=2)
def compiled(spec: str) -> Automaton:
    """The automaton of a tokenizer file's text (a byte-level BPE model in the public JSON format)."""
    file = json.loads(spec)
    model, labels = file["model"], arc_labels(spec)
    vocab = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    n = max([*vocab.values(), *special.values()]) + 1
    made, left, right = np.full(n, -1, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    removed = np.zeros(len(pairs), np.int64)
    for rank, (a, b) in enumerate(pairs):
        ab = vocab[a + b]
        made[ab], left[ab], right[ab] = rank, vocab[a], vocab[b]
        removed[rank] = vocab[a] << 32 | vocab[b]
    nodes: dict[int, int] = {}
    ends = {}
    for i in vocab.values():
        if made[i] < 0 and len(labels[i]) != 1:
            continue  # in the vocabulary, but no merge makes it
        at = 0
        for byte in labels[i]:
            at = nodes.setdefault(at << 8 | byte, len(nodes) + 1)
        ends[at] = i
    token = np.full(len(nodes) + 1, -1, np.int32)
    token[list(ends)] = list(ends.values())
    return Automaton(
        made, left, right, Hashed(removed, np.arange(len(pairs), dtype=np.int32), int(NEVER)),
        Hashed(np.array(list(nodes), np.int64), np.array(list(nodes.values()), np.int32), -1), token, special)


class Segments:
    """Texts as rows of cached segments.

    A text may be cut before every space that stands alone between two other characters: the
    pre-split pattern never joins what such a space parts; ``cut`` is for tokenizers with another rule.
    Segments repeat (they are mostly words), so ``fill`` gets only those not met before and gives their
    tokens, flat with offsets.
    """

    def __init__(self, fill, cut=None, given: tuple | None = None):
        self.fill, self.cut = fill, cut or self._cut
        self.given = given or ([], np.zeros(0, np.int32), np.zeros(1, np.int64))  # segments, tokens, offsets
        self.odd = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\0]")
        self.alone = regex.compile(r"(?V1)(?<=\P{White_Space})(?= \P{White_Space})")
        self.forget()

    def forget(self) -> None:
        found, self.tokens, self.offsets = self.given
        self.known: dict[str, int] = dict(zip(found, range(len(found)), strict=True))

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or "  " in text or "\n " in text or " \n" in text or self.odd.search(text):
            return self.alone.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, with text offsets."""
        cut = [self.cut(t) for t in texts]
        if len(self.known) > KNOWN_WORDS + len(self.given[0]):
            self.forget()
        flat = list(chain.from_iterable(cut))
        code = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(code < 0).tolist()
        if missing:
            new = list({flat[i] for i in missing})
            tokens, offsets = self.fill(new)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.offsets = np.concatenate([self.offsets, len(self.tokens) + offsets[1:]])
            self.tokens = np.concatenate([self.tokens, tokens])
            code[missing] = [self.known[flat[i]] for i in missing]
        ids, ends = gathered(self.tokens, self.offsets, code)
        return ids, ends[np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)]


def gathered(tokens: np.ndarray, offsets: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token runs named by ``code`` one behind the other, and their borders."""
    begin, counts = offsets[code], offsets[code + 1] - offsets[code]
    ends = np.concatenate([[0], np.cumsum(counts)])
    total = int(ends[-1])
    return tokens[np.arange(total) - np.repeat(ends[:-1], counts) + np.repeat(begin, counts)], ends


class Encoder:
    """Whole texts to token ids, with the segments met so far."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.special = regex.compile("|".join(map(regex.escape, automaton.special))) if automaton.special else None
        self.pre_split = regex.compile(PRE_SPLIT)
        self.segments = Segments(self._fill)
        self.encode = self.segments.encode

    def _pieces(self, text: str) -> list[str]:
        """Pre-split words; a special token is a word of its own, and no other word has its text."""
        if self.special is None:
            return self.pre_split.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*self.pre_split.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.pre_split.findall(text[at:])

    def _fill(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = self.automaton.special
        plain = self.special is None or not self.special.search("\n".join(segments))
        cut = list(map(self.pre_split.findall if plain else self._pieces, segments))
        code = dict.fromkeys(chain(special, chain.from_iterable(cut)))
        code = dict(zip(code, range(len(code)), strict=True))
        tokens, offsets = self.automaton.encode_words([p.encode() for p in code][len(special):])
        tokens = np.concatenate([np.array(list(special.values()), np.int32), tokens])
        offsets = np.concatenate([np.arange(len(special)), len(special) + offsets])
        sizes = np.array([len(x) for x in cut], np.int64)
        ids, ends = gathered(tokens, offsets, np.fromiter(map(code.__getitem__, chain.from_iterable(cut)), np.int64, int(sizes.sum())))
        return ids, ends[np.concatenate([[0], np.cumsum(sizes)])]


@lru_cache(maxsize=1)
def _encoder(spec: str) -> Encoder:
    """The encoder with the segments that this worker has met, kept from task to task."""
    return Encoder(compiled(spec))


def _encode(text: str, out: str, kept: list[str], spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for part in base.slices(batches, text):
            ids, offsets = encoder.encode([x or "" for x in part.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], base.lists(ids, offsets)], [*kept, out])
    return run


@lru_cache(maxsize=1)
def arc_labels(spec: str) -> list[bytes]:
    """The bytes of each token, all that decoding needs of the file."""
    file, letters = json.loads(spec), byte_letters()
    found = {i: bytes(letters[c] for c in text) for text, i in file["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in file["added_tokens"]}
    return [found.get(i, b"") for i in range(max(found) + 1)]


def _decode(ids: str, out: str, kept: list[str], spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = arc_labels(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [b"".join([labels[i] for i in row or ()]).decode("utf-8", "replace") for row in _rows(part.column(ids))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.string())], [*kept, out])
    return run


def _rows(column: pa.Array) -> Iterator[list[int]]:
    flat, offsets = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0))])
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield flat[a:b].tolist()


def read_spec(path: str) -> str:
    """The tokenizer file's text, read once on the driver (a vocabulary, bounded by its format)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the token ids (array of int) of the whole text.

    The ids are those of the public tokenizers library without added special tokens, truncation and
    padding; the text of a special token is that token. A null or empty text has no ids. All columns and
    rows stay; a column named ``out`` is replaced.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.ArrayType(T.IntegerType()))])
    return docs.select(kept).mapInArrow(_encode(text, out, kept, spec), schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``, the text that the ids spell, special tokens included; null ids give "".

    Bytes that are no UTF-8 become replacement characters. A column named ``out`` is replaced.
    """
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(path))
    kept = [c for c in encoded.columns if c != out]
    schema = T.StructType([*[encoded.schema[c] for c in kept], T.StructField(out, T.StringType())])
    return encoded.select(kept).mapInArrow(_decode(ids, out, kept, spec), schema)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(<key>, n_tokens, ids_sha256, decoded_sha256)`` of the encoded and again decoded texts."""
    ids = encode(docs.select(key, F.col(text).alias("text")), path).drop("text")
    return decode(ids, path).select(
        key, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
