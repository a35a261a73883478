"""Token ids of whole texts by the tokenizers library, a batch of rows at a time, for word-level tokenizers.

For a tokenizer that drops white space, a text's ids are those of its words one behind the other. Words are found
and hashed (128 bits) for a whole batch at once, and one met before costs a look-up. A word not met before goes through the library, or, where the
tokenizer's file has the steps named in ``follows_kinds`` and the word consists of Latin letters, digits and
ASCII signs, through ``Merges``: the file's merges, applied to the pieces of all new words of a batch at once. Tests hold the ids against the library's.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from tallyloom.llm import words
from tallyloom.llm.bpe_automaton import NEVER, Hashed, byte_letters, gathered

MOST_WORDS = 400_000
"""Words that a worker keeps; beyond that it keeps those met most often, half as many at most."""
LONG = 64
"""Longer words go through the library."""
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[10] = BLANK
KIND[33:127] = SIGN
KIND[ord("'")] = OTHER
KIND[48:58] = DIGIT
KIND[[*range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = LETTER
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
"""The pattern that ``KIND`` follows: runs of letters, single digits, runs of signs."""


def follows_kinds(spec: dict) -> bool:
    """Whether the file says: compose, blank, lower-case, cut into ``PIECES``, bytes as letters, merge."""
    before, cut, model = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    kinds = [x.get("type") for x in before.get("normalizers", [])]
    parts = cut.get("pretokenizers", [])
    if kinds != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in parts] != ["Split", "ByteLevel"]:
        return False
    split, letters = parts
    return (model.get("type") == "BPE" and split["pattern"].get("Regex") == PIECES and split.get("behavior") == "Removed"
            and split.get("invert") is True and not letters.get("add_prefix_space") and not letters.get("use_regex"))


class Merges:
    """A file's merges, applied to many short pieces at once: in each round every piece merges its pair of least
    rank, wherever it stands, from left to right. A token comes of one merge, so no pair made by a merge
    ranks before it, and a round may merge all places of the pair."""

    def __init__(self, model: dict):
        ids, letter = model["vocab"], {b: c for c, b in byte_letters().items()}
        end = model.get("end_of_word_suffix") or ""
        self.inner = np.array([ids[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([ids[letter[b] + end] for b in range(256)], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([ids[a] << 24 | ids[b] for a, b in pairs], np.int64)
        self.rank = Hashed(keys, np.arange(len(pairs), dtype=np.int32), NEVER)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        if len(np.unique(self.made)) != len(pairs):
            raise ValueError("two merges make one token")

    def ranks(self, ids: np.ndarray, piece: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at some places; a piece's last token begins none."""
        out = np.full(len(at), NEVER, np.int32)
        inside = np.flatnonzero(at + 1 < len(ids))
        inside = inside[piece[at[inside]] == piece[at[inside] + 1]]
        here = at[inside]
        out[inside] = self.rank.get(ids[here] << 24 | ids[here + 1])
        return out

    def apply(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces of UTF-8 bytes (none of them empty), flat with offsets."""
        ids, piece = self.inner[data], np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        ids[offsets[1:] - 1] = self.last[data[offsets[1:] - 1]]
        rank = self.ranks(ids, piece, np.arange(len(ids)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            gone = np.repeat(best == NEVER, size)
            if gone.any():
                done.append((piece[gone], ids[gone]))
            here = np.flatnonzero((rank == np.repeat(best, size)) & ~gone)
            if len(here):  # of places that overlap, every second one
                run = np.concatenate([[True], (here[1:] != here[:-1] + 1)])
                since = np.arange(len(here)) - np.maximum.accumulate(np.where(run, np.arange(len(here)), 0))
                here = here[since % 2 == 0]
                ids[here] = self.made[rank[here]]
                gone[here + 1] = True
            kept = ~gone
            at = (np.cumsum(kept) - 1)[here]
            ids, piece, rank = ids[kept], piece[kept], rank[kept]
            for changed in (at, at[at > 0] - 1):  # only pairs next to a merge are new
                rank[changed] = self.ranks(ids, piece, changed)
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        owner, found = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(owner, kind="stable")
        return found[by], np.searchsorted(owner[by], np.arange(len(offsets)))


class Numbers:
    """Numbers of words by their hashes: an open table that is searched and filled in bulk."""

    def __init__(self, most: int):
        self.bits = max(4, int(4 * most).bit_length())
        self.h, self.g = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.number = np.full(1 << self.bits, -1, np.int32)

    def get(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Numbers, -1 for a word that is not in the table."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(open_):
            there = self.number[at]
            hit = (there >= 0) & (self.h[at] == h[open_]) & (self.g[at] == g[open_])
            out[open_[hit]] = there[hit]
            more = (there >= 0) & ~hit
            open_, at = open_[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def put(self, h: np.ndarray, g: np.ndarray, number: np.ndarray) -> None:
        """Distinct words that are not in the table."""
        at, todo = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = np.flatnonzero(self.number[at[todo]] < 0)
            _, first = np.unique(at[todo[free]], return_index=True)
            some = todo[free[first]]
            self.h[at[some]], self.g[at[some]], self.number[at[some]] = h[some], g[some], number[some]
            left = np.ones(len(todo), bool)
            left[free[first]] = False
            todo = todo[left]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)


class WordIds:
    """Texts to ids, with the words met so far."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        file = json.loads(spec)
        self.merges = Merges(file["model"]) if follows_kinds(file) else None
        self.special = [t["content"] for t in file["added_tokens"]]
        self.tokens, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.h, self.g, self.met = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.known = Numbers(MOST_WORDS)

    def fill(self, given: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the words in an order of its own, with their ids, flat with offsets."""
        easy = self.easy(given) if self.merges is not None and given else np.zeros(len(given), bool)
        order = np.concatenate([np.flatnonzero(easy), np.flatnonzero(~easy)])
        plain = [w for w, ok in zip(given, easy.tolist(), strict=True) if ok]
        whole = [w for w, ok in zip(given, easy.tolist(), strict=True) if not ok]
        ids, ends = np.zeros(0, np.int64), np.zeros(1, np.int64)
        if plain:
            data = np.frombuffer("\n".join(plain).lower().encode(), np.uint8)
            kind = KIND[data]
            word = np.flatnonzero(np.concatenate([[True], kind[:-1] == BLANK])) - np.arange(len(plain))
            first = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)])[kind != BLANK]
            data = data[kind != BLANK]
            pieces = np.append(np.flatnonzero(first), len(data))
            ids, ends = self.merges.apply(data, pieces)
            ends = ends[np.searchsorted(pieces, np.append(word, len(data)))]
        rest = [e.ids for e in self.library.encode_batch_fast(whole, add_special_tokens=False)]
        more = np.cumsum([len(x) for x in rest], dtype=np.int64) + ends[-1]
        ids = np.concatenate([ids, np.fromiter(chain.from_iterable(rest), np.int64)]).astype(np.int32)
        return order, ids, np.concatenate([ends, more])

    def easy(self, words: list[str]) -> np.ndarray:
        """Words of ASCII signs without apostrophes, digits, and letters up to U+017F, once lower-cased."""
        data = np.frombuffer("\n".join(words).lower().encode() + b"\n", np.uint8)
        ends = np.flatnonzero(data == 10)
        bad = (KIND[data] == OTHER).astype(np.int8)
        bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs among the letters
        begin = np.concatenate([[0], ends[:-1] + 1])
        size = ends - begin
        ok = (np.add.reduceat(bad, begin, dtype=np.int64) == 0) & (size > 0) & (size <= LONG)
        if any(s in "\n".join(words) for s in self.special):
            ok &= np.array([not any(s in w for s in self.special) for w in words])
        return ok

    def shrink(self) -> None:
        """Keep the words met most often."""
        least = max(2, int(np.partition(self.met, -MOST_WORDS // 2)[-MOST_WORDS // 2]) + 1)
        kept = np.flatnonzero(self.met >= least)
        self.tokens, self.offsets = gathered(self.tokens, self.offsets, kept)
        self.h, self.g, self.met = self.h[kept], self.g[kept], np.ones(len(kept), np.int64)
        self.known = Numbers(MOST_WORDS)
        self.known.put(self.h, self.g, np.arange(len(kept)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, with text offsets."""
        if len(self.h) > MOST_WORDS:
            self.shrink()
        w = words.words(pa.array(texts, pa.large_string()))
        h, g = w.hashes(0), w.hashes(1)
        code = self.known.get(h, g)
        missing = np.flatnonzero(code < 0)
        if len(missing):
            by = missing[np.lexsort((g[missing], h[missing]))]
            first = np.concatenate([[True], (h[by][1:] != h[by][:-1]) | (g[by][1:] != g[by][:-1])])
            new, raw = by[first], w.data.tobytes()
            found = [raw[a:b].decode() for a, b in zip(w.start[new].tolist(), w.end[new].tolist(), strict=True)]
            order, tokens, offsets = self.fill(found)
            number = np.empty(len(new), np.int64)
            number[order] = len(self.h) + np.arange(len(new))
            code[by] = number[np.cumsum(first) - 1]
            self.h, self.g = np.concatenate([self.h, h[new[order]]]), np.concatenate([self.g, g[new[order]]])
            self.offsets = np.concatenate([self.offsets, len(self.tokens) + offsets[1:]])
            self.tokens = np.concatenate([self.tokens, tokens])
            if len(self.h) > 2 * MOST_WORDS:  # more new words in one batch than the table is made for
                self.known = Numbers(len(self.h))
                self.known.put(self.h, self.g, np.arange(len(self.h)))
            else:
                self.known.put(h[new], g[new], number)
        met = np.bincount(code, minlength=len(self.h))
        met[: len(self.met)] += self.met
        self.met = met
        ids, ends = gathered(self.tokens, self.offsets, code)
        return ids, ends[w.row]


@lru_cache(maxsize=1)
def encoder(spec: str) -> WordIds:
    """One encoder for all tasks of a worker."""
    return WordIds(spec)


def id_type(spec: str) -> str:
    """Two bytes an id if the tokenizer's ids fit, else four."""
    file = json.loads(spec)
    return "<u2" if max([*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])]) < 65_536 else "<u4"
