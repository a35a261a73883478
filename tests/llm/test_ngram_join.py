import random

import pytest

from tallyloom.llm import base, ngram_join
from .rules import components, shingles, words

SCHEMA = "doc_id long, text string, lang string, comp long, n long, rep string"


def corpus(seed, n=160):
    """Near copies at many distances, exact copies, a line that most share, short and empty texts."""
    pick = random.Random(seed)
    letters = [f"w{i}" for i in range(400)]
    rows, bases = [], [[pick.choice(letters) for _ in range(pick.randint(20, 120))] for _ in range(6)]
    for i in range(n):
        w = list(pick.choice(bases))
        for _ in range(pick.choice([0, 0, 1, 1, 2, 3, 6])):
            w[pick.randrange(len(w))] = pick.choice(letters)
        if pick.random() < 0.3:
            w = ["this", "line", "is", "in", "most", "Texts"] + [pick.choice(letters) for _ in range(20)]
        rows.append((i * 3 + 1, " ".join(w)))
    rows += [(1001, None), (1002, ""), (1003, " \t\n"), (1004, "one"), (1005, "ONE"), (1006, "a b"), (1007, "A  b"), (1008, "b a")]
    rows += [(2000 + i, "x y z " * 2000) for i in range(2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", -1, -2, "clash") for i, t in rows], SCHEMA)


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_components_equal_brute_force(spark, size, num, den):
    rows = corpus(size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           ngram_join.jaccard_components(frame(spark, rows).repartition(5), size, num, den).collect()}
    sets = {i: shingles(words(t, lower=True), size) for i, t in rows}
    want = components(sets, num, den)
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_null_keys_repeated_rows_and_no_rows(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "A B C D"), (9, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in
                  ngram_join.jaccard_components(frame(spark, rows), 3, 90, 100).collect()), key=str)
    assert got == sorted([(None, 2, None), (None, 2, None), (5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 0, 9)], key=str)
    empty = ngram_join.jaccard_components(frame(spark, []))
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.count() == 0


def test_every_similar_pair_shares_prefixes_and_a_part():
    """The filters themselves: no similar pair may fail one, under any order."""
    import numpy as np
    import pyarrow as pa

    rows = corpus(9, 120)
    flat, offsets = ngram_join.token_sets(pa.array([t for _, t in rows]), 3, True)
    sets = [set(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    often = np.unique(flat)[::7]
    cuts = [ngram_join.prefixes(flat, offsets, 90, 100, often, k) for k in range(3)]

    class Sent:
        value = often

    ids = pa.array(range(len(rows)))
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array([t for _, t in rows])], ["id", "label", "text"])
    parts = {}
    for out in ngram_join._parts(3, True, 90, 100, Sent)(iter([batch])):
        for r, token in zip(out.column("rep").to_pylist(), out.column("token").to_pylist(), strict=True):
            parts.setdefault(r, set()).add(token)
    checked = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                checked += 1
                assert parts[i] & parts[j]
                for values, cut in cuts:
                    assert set(values[cut[i] : cut[i + 1]].tolist()) & set(values[cut[j] : cut[j + 1]].tolist())
    assert checked > 50


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)] + [(200, 200 + k) for k in range(1, 40)]
    got = {r.id: r.comp for r in base.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100} | {200 + k: 200 for k in range(40)}


def near_group(n=240):
    """One group of near copies around the threshold: few of its pairs are similar enough."""
    pick = random.Random(3)
    base_words = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(n):
        w = list(base_words)
        for at in pick.sample(range(0, 150, 3), pick.randint(1, 7)):
            w[at] = f"own{i}x{at}" if pick.random() < 0.6 else f"part{pick.randrange(4)}x{at}"
        rows.append((i, " ".join(w)))
    return rows


def wanted(rows, size, num, den):
    sets = {i: shingles(words(t, lower=True), size) for i, t in rows}
    comps = components(sets, num, den)
    return {i: (len(sets[i]), comps[i]) for i in sets}


@pytest.mark.parametrize(("tile", "many"), [(16, 32_768), (8, 30)])
def test_tiles_and_finer_blocks_equal_brute_force(spark, monkeypatch, tile, many):
    for name, value in (("FEW", 2), ("TILE", tile), ("MANY", many)):
        monkeypatch.setattr(ngram_join, name, value, raising=False)
    rows = [*near_group(), *((i + 5000, t) for i, t in corpus(3, 60))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           ngram_join.jaccard_components(frame(spark, rows).repartition(5), 3, 90, 100).collect()}
    want = wanted(rows, 3, 90, 100)
    assert got == want and 3 < len({c for i, (_, c) in want.items() if i < 5000}) < 200


def test_pairs_of_a_group_of_near_copies_grow_with_its_members(spark, monkeypatch):
    """No table of pairs holds the square of the group."""
    rows, pairs, write = near_group(), [], base.written

    def watched(df):
        out = write(df)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(base, "written", watched)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows), 3, 90, 100).collect()}
    assert got == wanted(rows, 3, 90, 100)
    assert pairs and max(pairs) < 4 * len(rows) < len(rows) ** 2 // 8


def test_sketches_lose_no_similar_pair_and_forests_span():
    import numpy as np
    import pyarrow as pa

    flat, offsets = ngram_join.token_sets(pa.array([t for _, t in near_group()] + [None, "a"]), 3, True)
    sets = [set(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    n, x = np.diff(offsets), ngram_join.sketches(flat, offsets).view(np.uint64)
    label, side = np.arange(len(n)) // 2, np.arange(len(n)) % 2
    for sides in (None, side):
        i, j, apart = ngram_join.near_pairs(x, n, label, sides, 90, 100)
        found = set(zip(i.tolist(), j.tolist(), strict=True))
        for b, y in enumerate(sets):
            for a in range(b):
                if y and label[a] != label[b] and (sides is None or side[a] != side[b]) and 100 * len(sets[a] & y) >= 90 * len(sets[a] | y):
                    assert (a, b) in found
        assert (i < j).all() and (label[i] != label[j]).all() and (apart <= [len(sets[a] ^ sets[b]) for a, b in zip(i, j, strict=True)]).all()
        kept = ngram_join.forest(label, i, j, apart)
        comp = {v: v for v in label.tolist()}

        def root(v, comp=comp):
            while comp[v] != v:
                v = comp[v]
            return v

        for e in kept:
            u, v = root(label[i[e]]), root(label[j[e]])
            assert u != v  # no circle
            comp[u] = v
        assert all(root(label[a]) == root(label[b]) for a, b in found) and len(kept)


def long_texts(n=30):
    """Long documents of own words that share a passage with the next one, and a near copy of each third."""
    own = [[f"d{i}w{j}" for j in range(5000)] for i in range(n)]
    rows = []
    for i, w in enumerate(own):
        rows.append((i, " ".join([*own[i - 1][100:1200], *w])))
        if i % 3 == 0:
            rows.append((500 + i, " ".join([*own[i - 1][100:1200], *w[:4000], f"new{i}", *w[4000:]])))
    return rows


def test_long_sets_that_share_a_passage_are_told_apart_by_their_sketches(spark, monkeypatch):
    """No whole set is read, much less moved for each of its pairs, but those of near copies."""
    rows, whole, write = long_texts(), [], base.written

    def watched(df):
        out = write(df)
        if "tokens" in out.columns:
            whole.append(out.count())
        return out

    monkeypatch.setattr(base, "written", watched)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows)).collect()}
    assert got == {i: (len(shingles(words(t), 5)), i - 500 if i >= 500 else i) for i, t in rows}
    assert whole and max(whole) == 20


def test_sketches_of_several_lengths_lose_no_similar_pair():
    import numpy as np
    import pyarrow as pa

    pick = random.Random(5)
    sets = []
    for n in (1900, 2040, 2056, 2300, 4000, 4090, 4100, 4500, 9000):
        tokens = [pick.getrandbits(64) for _ in range(n)]
        for cut in (0, 0.03, 0.09, 0.3, 0.6):
            sets.append(np.unique(np.array(tokens[int(n * cut):] + [pick.getrandbits(64) for _ in range(int(n * cut / 20))], np.uint64)))
    flat, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    words_, cut = ngram_join.fitted_sketches(flat, offsets)
    x, width = ngram_join.padded(base.lists(words_, cut))
    n = np.diff(offsets)
    assert set(width.tolist()) == {32, 64, 128, 256} and (width * 64 >= n).all()
    pairs = {(a, b) for b, y in enumerate(sets) for a in range(b)
             if 100 * (s := len(np.intersect1d(sets[a], y))) >= 90 * (len(sets[a]) + len(y) - s)}
    assert any(width[a] != width[b] for a, b in pairs)
    i, j, apart = ngram_join.near_pairs(x, n, np.arange(len(n)), None, 90, 100, width)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    assert pairs <= found and len(found) < 2 * len(pairs)
    a, b = map(np.array, zip(*((a, b) for b in range(len(n)) for a in range(b)), strict=True))
    columns = pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b), pa.array(n[a]), pa.array(n[b]), *(base.lists(words_, cut).take(pa.array(k)) for k in (a, b))],
        ["a", "b", "na", "nb", "sa", "sb"])
    kept = {(r["a"], r["b"]) for out in ngram_join._near_enough(90, 100)(iter([columns])) for r in out.to_pylist()}
    assert pairs <= kept and len(kept) < 2 * len(pairs)


def test_keys_of_several_columns_and_blocks_with_the_same_members(spark):
    """A key that is no number is one between the steps only; the smallest key names the component."""
    from pyspark.sql import functions as F

    rows = [*near_group(120), *((i + 5000, t) for i, t in corpus(4, 60))]
    docs = frame(spark, rows).select(F.struct((-F.col("doc_id")).alias("x"), F.col("doc_id").cast("string").alias("y")).alias("doc_id"), "text")
    got = {tuple(r.doc_id): (r.n_shingles, tuple(r.component_id)) for r in ngram_join.jaccard_components(docs.repartition(5), 3, 90, 100).collect()}
    keyed = [((-i, str(i)), t) for i, t in rows]
    assert got == wanted(keyed, 3, 90, 100)
