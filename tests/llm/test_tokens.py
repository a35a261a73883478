"""Token ids: the automaton against the library, and the coded files by round trip."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tallyloom.llm import bpe_automaton, plans, token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = ["", None, " ", "\n", "a<|endoftext|>b  \n\n x", "it's we'll  they've  x　y\x1cz\x85 q\xa0​", "aaa aaaaaa baaab ababababab " + "x" * 500,
        " lead", "tail ", "a  b", "a \n b c", "x <|endoftext|> y z", "a\0b c\0 d", "don't we'll \t q", "é é 中文 \U0001f600", "word " * 30_000,
        "<|startoftext|>hi", "ÀÉ ΑΣ ΣΑΣ ﬁ Å"]


def random_texts(n):
    pick = random.Random(n)
    letters = "abcdeABC 0129 .,!'\n\téü中文\U0001f600́ \x00\x1f=-_*#"
    wide = [chr(pick.choice([pick.randint(1, 0xD7FF), pick.randint(0xE000, 0x10FFFF), pick.randint(32, 127)])) for _ in range(4000)]
    return ["".join(pick.choice(letters) for _ in range(pick.randint(0, 200))) for _ in range(n)] + \
        ["".join(pick.choice(wide) for _ in range(40)) for _ in range(n // 4)]


def test_automaton_gives_the_librarys_ids():
    library = Tokenizer.from_file(BYTES)
    encoder = bpe_automaton.Encoder(bpe_automaton.compiled(bpe_automaton.read_spec(BYTES)))
    texts = [t or "" for t in HARD] + random_texts(800)
    ids, offsets = encoder.encode(texts)
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]


def test_automaton_refuses_what_merging_does_not_make():
    a = bpe_automaton.compiled(bpe_automaton.read_spec(BYTES))
    library = Tokenizer.from_file(BYTES)
    pick = random.Random(5)
    u, t = (np.array([pick.randrange(50_000) for _ in range(4000)]) for _ in range(2))
    got = a._arc(u, t)
    plain = bpe_automaton.arc_labels(bpe_automaton.read_spec(BYTES))
    checked = 0
    for x, y, ok in zip(u.tolist(), t.tolist(), got.tolist(), strict=True):
        text = (plain[x] + plain[y])
        if text.isalpha() and text.isascii():  # one word to the library
            checked += 1
            assert (library.encode(text.decode(), add_special_tokens=False).ids == [x, y]) == ok
    assert checked > 300


def test_encode_and_decode_tables(spark):
    library = Tokenizer.from_file(BYTES)
    docs = spark.createDataFrame([(i, t, [7], "x") for i, t in enumerate(HARD)] + [(None, "null key", None, None)],
                                 "doc_id long, text string, ids array<int>, decoded string")
    rows = bpe_automaton.decode(bpe_automaton.encode(docs, BYTES), BYTES).collect()
    assert len(rows) == len(HARD) + 1
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False) == (r.text or "")
    digest = {r.doc_id: r for r in bpe_automaton.digests(docs, BYTES).collect()}
    want = library.encode(HARD[4], add_special_tokens=False).ids
    assert digest[4].n_tokens == len(want) and digest[4].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert digest[4].decoded_sha256 == hashlib.sha256(HARD[4].encode()).hexdigest()
    assert bpe_automaton.digests(docs.limit(0), BYTES).count() == 0


@pytest.mark.parametrize("n", [1, 31, 33, 5000, 300_000, 600_001])
def test_pack_and_unpack(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_000).astype(np.uint32)
    tokens, counts = np.unique(ids, return_counts=True)
    table = token_files.Table(tokens.astype(np.int64), token_files.Table.scale(counts))
    data = token_files.pack([5, None], np.array([n - 1, 1]), ids, 7, table)
    first, keys, lengths, back = token_files.unpack(data, table)
    assert first == 7 and keys == [5, None] and lengths.tolist() == [n - 1, 1] and (back == ids).all()
    for at in (10, 60, len(data) - 3):
        damaged = bytearray(data)
        damaged[at] ^= 1
        with pytest.raises(ValueError):
            token_files.unpack(bytes(damaged), table)


def test_scale_adds_up_and_keeps_every_id():
    for counts in ([1], [1] * 1000, [10**12] + [1] * 49_000, list(range(1, 3000))):
        share = token_files.Table.scale(np.array(counts, np.int64))
        assert share.sum() == 1 << token_files.BITS and share.min() >= 1


def test_files_hold_the_librarys_ids_in_order(spark, monkeypatch):
    library = Tokenizer.from_file(WORDS)
    rows = [(i * 7 % 1000 - 50, t) for i, t in enumerate(HARD + random_texts(120))] + [(None, "null key"), (3, "same"), (3, "same")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, start long, id string").repartition(5)
    got = token_files.round_trip(docs, WORDS, 2).orderBy("start").collect()
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_files.round_trip(docs.limit(0), WORDS, 2).count() == 0


def test_queries(spark):
    library, words = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in plans.op10_bpe_automaton(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    at = 0
    for r in plans.op4_token_files(spark, "/root/testdata/sf0.001").orderBy("doc_id").collect():
        ids = words.encode(docs[r.doc_id], add_special_tokens=False).ids + [2]
        assert tuple(r)[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
