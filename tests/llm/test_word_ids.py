"""Batch encoding of words against the library, word by word and text by text."""

import random

import public_tokenizers
import pytest

from tallyloom.llm import word_ids
from tallyloom.llm.bpe_automaton import read_spec

SPEC = read_spec(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", "don't", "we'LL", "x's'", "<|endoftext|>", "a<|startoftext|>b", "'S", "İx", "ſ", "ǅ", "K", "xÅY", "ẞs", "a×b", "÷", "Σς",
       "é", "x" * 70, "a\tb", "9a,,b12", "\x7f", "\x00", "aaaaaaa", "中文", "K̀", "!?!?", "été-Ÿ9"]


def want(e, text):
    return e.library.encode(text, add_special_tokens=False).ids


def test_words_get_the_librarys_ids():
    e = word_ids.WordIds(SPEC)
    assert e.merges is not None
    pick = random.Random(3)
    letters = "".join(map(chr, range(33, 0x180)))
    words = list(dict.fromkeys(ODD + ["".join(pick.choice(letters) for _ in range(pick.randint(1, 9))) for _ in range(8000)]
                               + ["".join(pick.choice("aabcdelnorst") for _ in range(pick.randint(1, 64))) for _ in range(3000)]))
    order, ids, ends = e.fill(words)
    assert sorted(order.tolist()) == list(range(len(words)))
    for k, w in enumerate(words[i] for i in order.tolist()):
        assert ids[ends[k] : ends[k + 1]].tolist() == want(e, w), w
    assert [len(x) for x in e.fill([])] == [0, 0, 1]


@pytest.mark.parametrize("most", [4, 400_000])
def test_texts_get_the_librarys_ids(monkeypatch, most):
    monkeypatch.setattr(word_ids, "MOST_WORDS", most)  # also when words are forgotten all the time
    e = word_ids.WordIds(SPEC)
    texts = ["", " ", "a b  a b c\nd", "the cat and the hat, the mat.", " ".join(ODD), "the end", "\n\n", "z " * 1000] * 3
    for at in range(0, len(texts), 2):
        ids, ends = e.encode(texts[at : at + 2])
        for k, text in enumerate(texts[at : at + 2]):
            assert ids[ends[k] : ends[k + 1]].tolist() == want(e, text)


def test_a_file_of_another_kind_goes_through_the_library():
    e = word_ids.WordIds(SPEC.replace('"Lowercase"', '"NFKC"'))
    assert e.merges is None
    ids, _ = e.encode(["Some Words, other words"])
    assert ids.tolist() == want(e, "Some Words, other words")


def test_numbers_of_words():
    import numpy as np

    h, g = (np.random.default_rng(k).integers(0, 40, 900, dtype=np.uint64) << np.uint64(58) for k in (1, 2))  # few hashes: long probes
    pairs = list(dict.fromkeys(zip(h.tolist(), g.tolist(), strict=True)))
    h, g = (np.array(x, np.uint64) for x in zip(*pairs, strict=True))
    table = word_ids.Numbers(len(h))
    table.put(h[:500], g[:500], np.arange(500))
    table.put(h[500:800], g[500:800], np.arange(500, len(h[:800])))
    assert table.get(h, g).tolist() == [k if k < 800 else -1 for k in range(len(h))]
