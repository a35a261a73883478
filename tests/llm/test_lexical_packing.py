"""Packing: each id once, no padding, neighbours by a plain BM25."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import lexical_packing as lp
from tallyloom.llm import plans

WORDS = public_tokenizers.path("word_bpe_49k.json")


def plain_scores(docs, query, idf, mean):
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(idf[t] * tf[t] * (lp.K1 + 1) / (tf[t] + lp.K1 * (1 - lp.B + lp.B * len(d) / mean)) for t in set(query) if t in tf))
    return out


def holds(pieces, ids_of, window):
    """Every id of every document in one piece, sequences gapless and not padded; key -> pieces."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["key"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    left = {k: sorted(v, key=len) for k, v in ids_of.items()}
    for key, found in by_doc.items():
        at = 0
        if len(left[key]) == 1:  # keys that repeat are only counted
            ids = left[key][0]
            for p in sorted(found, key=lambda p: p["start"]):
                want = zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
                assert (p["start"], p["ids_crc32"], p["doc_tokens"]) == (at, want, len(ids)) and p["length"] > 0
                at += p["length"]
            assert at == len(ids)
        assert sum(p["length"] for p in found) == sum(map(len, left[key]))
    assert by_doc.keys() == left.keys()
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window and at & (at - 1) == 0
    return by_sequence


def test_a_seed_gets_its_best_unused_neighbours():
    pick = random.Random(1)
    docs = [np.array([pick.randrange(1 + 40 * (k % 4), 60 + 40 * (k % 4)) for _ in range(pick.randint(5, 60))], np.uint16) for k in range(80)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    idf = np.zeros(400)
    for t, n in df.items():
        idf[t] = math.log1p((len(docs) - n + 0.5) / (n + 0.5))
    mean = float(np.mean([len(d) for d in docs]))
    shard = lp.Shard(docs, idf, mean)
    shard.unused[[3, 9]] = False
    for seed in (0, 5, 17):
        got = list(shard.near(docs[seed]))
        score = plain_scores([d.tolist() for d in docs], docs[seed].tolist(), idf, mean)
        assert sorted(got) == [k for k in range(80) if k not in (3, 9)]
        assert all(score[a] >= score[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))
    packer = lp.Packer(128)
    left = lp.pack_shard(packer, docs, [], idf, mean)
    first = [p for p in packer.out if p[3] == 0]
    score = plain_scores([d.tolist() for d in docs], docs[0].tolist(), idf, mean)
    taken = [p[0] for p in first[1:]]
    assert first[0][0] == 0 and min(score[t] for t in taken) >= max(score[k] for k in range(1, 80) if k not in taken) - 1e-9
    assert sum(n for _, _, n in left) < 128
    packer.finish(left)
    assert sum(p[2] for p in packer.out) == sum(map(len, docs))


def test_heaviest_terms():
    idf = np.array([0.0, 5.0, 3.0, 3.0])
    ids = [np.array(x, np.uint16) for x in ([0, 1, 2], [2, 3], [0], [])]
    assert lp.heaviest(ids, idf).tolist() == [2 << 32 | 3, 3 << 32 | 4, 1 << 32, 0]


@pytest.mark.parametrize("shard_tokens", [50, 4000, 1 << 20])
def test_odd_rows(spark, shard_tokens):
    library = Tokenizer.from_file(WORDS)
    pick = random.Random(7)
    rows = [(i, " ".join(pick.choice(["red", "green", "blue", "zebra", "qua", "x1"]) for _ in range(pick.randint(0, 90)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "long text " * 5000), (None, "no key"), (300, "twice"), (300, "twice"), (300, "other")]
    rows += [(400 + i, "copies of one text are cut by their keys") for i in range(60)]
    docs = spark.createDataFrame([(k, t, 1, "a", b"z", 5) for k, t in rows], "doc_id long, text string, n int, route string, ids binary, sequence_id int").repartition(3)
    got = [r.asDict() | {"key": r.doc_id} for r in lp.pack(docs, WORDS, 2, window=256, shard_tokens=shard_tokens).collect()]
    ids_of = defaultdict(list)
    for k, t in rows:
        ids_of[k].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    holds(got, ids_of, 256)
    assert lp.pack(docs.limit(0), WORDS, 2).count() == 0
    with pytest.raises(ValueError):
        lp.pack(docs, WORDS, 2, window=100)


def test_query(spark):
    where = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(WORDS)
    ids_of = {r.doc_id: [library.encode(r.text or "", add_special_tokens=False).ids + [2]]
              for r in spark.read.parquet(f"{where}/documents.parquet").collect()}
    got = [r.asDict() | {"key": r.doc_id} for r in plans.op12_lexical_packing(spark, where).collect()]
    whole = holds(got, ids_of, 4096)
    assert sum(sum(p["length"] for p in s) == 4096 for s in whole.values()) >= 0.2 * len(whole)
