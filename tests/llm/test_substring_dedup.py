import hashlib
import random

from tallyloom.llm import plans, substring_dedup
from .rules import without_repeats


def corpus(seed):
    """Passages shared at all offsets, repeats inside a text, copies, short and empty texts."""
    pick = random.Random(seed)
    w = [f"v{i}" for i in range(300)]
    passages = [[pick.choice(w) for _ in range(pick.randint(15, 45))] for _ in range(8)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(pick.randint(0, 5)):
            text += pick.choice(passages) if pick.random() < 0.4 else [pick.choice(w) for _ in range(pick.randint(1, 40))]
        rows.append((i * 2, pick.choice([" ", "\n", "  \t"]).join(text)))
    rows += [(1000 + i, rows[5][1]) for i in range(4)] + [(2000, None), (2001, ""), (2002, " \n "), (2003, "a " * 5000), (2004, "a " * 19)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, k long").repartition(4)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept, r.unchanged_sha256) for r in substring_dedup.remove_repeats(docs, 20).collect()}
    for key, (all_words, kept) in without_repeats(rows, 20).items():
        n, removed, text, sha = got[key]
        assert (n, removed) == (len(all_words), len(all_words) - len(kept))
        assert (text if removed else " ".join(kept)) == " ".join(kept)
        assert sha == hashlib.sha256(" ".join(all_words).encode()).hexdigest()


def test_null_keys_repeated_rows_and_no_rows(spark):
    text = " ".join(f"q{i}" for i in range(30))
    rows = [(None, text), (3, text), (3, text), (8, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(None, 30, 0), (3, 30, 0), (3, 30, 0), (8, 30, 30)], key=str)
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_query(spark):
    got = plans.op5_substring_dedup(spark, "/root/testdata/sf0.001").toPandas()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {k: (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
            for k, (w, kept) in without_repeats([tuple(d) for d in docs], 20).items()}
    assert {r[0]: r[1:] for r in got[["doc_id", "n_words", "n_removed", "kept_sha256"]].itertuples(index=False, name=None)} == want
