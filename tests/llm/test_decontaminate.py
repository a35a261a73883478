import math
import random
import re

from tallyloom.llm import decontaminate

SF = "/root/testdata/sf0.001"


def plain_words(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).split()


def grams(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def corpus(seed):
    pick = random.Random(seed)
    common = [f"c{i}" for i in range(30)]
    rare = [f"r{i}" for i in range(3000)]

    def words(n):
        return [pick.choice(common) if pick.random() < 0.5 else pick.choice(rare) for _ in range(n)]

    items = []
    for i in range(60):
        w = words(pick.randint(14, 60) if i % 10 else pick.randint(100, 300))
        items.append((i, " ".join(w[: len(w) // 2]) + "? " + " ".join(w[len(w) // 2 :]) + "."))
    docs, truth = [], set()
    for d in range(150):
        w = words(pick.randint(0, 400))
        if d % 3 == 0:
            i = pick.randrange(60)
            at = pick.randint(0, len(w))
            w[at:at] = items[i][1].upper().split() if d % 2 else items[i][1].split()
            truth.add((d, i))
        docs.append((d, " ".join(w)))
    return items, docs, truth


def test_finds_all_leaks_and_nothing_else(spark):
    items, docs, truth = corpus(4)
    left = spark.createDataFrame([(d, t, "x", 1.0) for d, t in docs] + [(900, None, "x", 1.0), (901, "", "x", 1.0), (902, "c1 " * 20_000, "x", 1.0)],
                                 "doc_id long, text string, item string, bm25 double").repartition(3)
    right = spark.createDataFrame([*items, (100, None), (101, ""), (None, items[0][1]), (102, "...")], "item_id long, text string")
    got = decontaminate.find_leaks(left, right).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth and len(got) == len(truth)
    assert all(r.question_overlap >= 0.8 and r.answer_overlap >= 0.8 for r in got)
    clean = decontaminate.without_leaks(left, right)
    assert clean.columns == left.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in truth} | {900, 901, 902}


def test_questions_without_their_long_answers(spark):
    """A copied question of 8 or more shingles is a leak, however little of the item's score it has."""
    pick = random.Random(9)
    rare = [f"r{i}" for i in range(4000)]
    questions = [[pick.choice(rare) for _ in range(12 + i % 9)] for i in range(40)]
    items = [(i, " ".join(q) + "? " + " ".join(pick.choice(rare) for _ in range(40 + 10 * (i % 12))) + ".") for i, q in enumerate(questions)]
    docs = []
    for i, q in enumerate(questions):
        before, after = ([pick.choice(rare) for _ in range(pick.randint(0, 200))] for _ in range(2))
        docs.append((i, " ".join(before + q + after)))
        docs.append((100 + i, " ".join(before + q[: len(q) - (len(q) - 4) // 5] + after)))  # 4/5 of the shingles
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i) for i in range(40)} | {(100 + i, i) for i in range(40)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(left, right).collect()} == want
    assert decontaminate.without_leaks(left, right).count() == 0


def test_no_accepted_passage_scores_below_the_threshold():
    import numpy as np

    pick = random.Random(3)
    for _ in range(300):
        w = np.array([pick.randrange(30) for _ in range(pick.randint(12, 25))])
        weight = {t: pick.random() ** 4 * 10 for t in w.tolist()}
        own = grams([str(x) for x in w])
        kept = set(w.tolist())
        for t in sorted(kept, key=lambda t: -weight[t]):  # leave out the heaviest words that verification can spare
            there = kept - {t}
            if sum(all(int(x) in there for x in g) for g in own) >= 0.8 * len(own):
                kept = there
        assert sum(weight[t] for t in kept) >= decontaminate.least_score([w], weight) - 1e-9


def test_a_test_set_in_parts_gives_the_same(spark, monkeypatch):
    items, docs, truth = corpus(5)
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.find_leaks(left, right).collect()}
    monkeypatch.setattr(decontaminate, "PART_BYTES", 8_000)
    parts = {tuple(r) for r in decontaminate.find_leaks(left, right).collect()}
    assert {r[:2] for r in whole} == {r[:2] for r in parts} == truth


def test_retrieval_is_complete():
    """Every item at or above its threshold comes back with the score that plain scoring gives."""
    import numpy as np

    items, docs, _ = corpus(6)
    w = decontaminate.normal([t for _, t in items])
    h = w.hashes()
    frequency, owner = {}, w.owner()
    for t, _ in {*zip(h.view(np.int64).tolist(), owner.tolist(), strict=True)}:
        frequency[t] = frequency.get(t, 0) + 1
    texts = [t for _, t in docs]
    d = decontaminate.normal(texts)
    hd = d.hashes()
    for index in decontaminate.build(items, frequency, len(items), len(h) / len(items)):
        got = {(r, b, i): s for r, b, i, s in zip(*(x.tolist() for x in decontaminate.retrieve(index, d, hd)), strict=True)}
        want = {}
        for r in range(len(texts)):
            n = int(d.counts[r])
            for begin in range(0, max(1, n - index.length) if n else 0, index.length):
                passage = np.unique(hd[d.row[r] + begin : min(d.row[r] + begin + 2 * index.length, d.row[r + 1])])
                score = np.zeros(len(index.ids))
                for t in np.flatnonzero(np.isin(index.terms, passage)):
                    own = slice(index.row[t], index.row[t + 1])
                    score[index.item[own]] += index.weight[own]
                for i in np.flatnonzero(score >= index.least):
                    want[r, begin, int(i)] = score[i]
        assert set(got) == set(want)
        assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_question_and_answer():
    assert decontaminate.split_item("What is it? A dog.") == ("What is it?", "A dog.")
    assert decontaminate.split_item("One. Two three. Four five.") == ("One. Two three.", "Four five.")
    assert decontaminate.split_item("Only one sentence.") == ("Only one sentence.", "")
    assert decontaminate.split_item("Why?") == ("Why?", "")


def test_nothing_to_find(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(docs, none).count() == 0 and decontaminate.without_leaks(docs, none).count() == 1
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert decontaminate.find_leaks(docs.limit(0), items).count() == 0
    twice = spark.createDataFrame([(1, "x a b c d e f g h i j y"), (1, "x a b c d e f g h i j y"), (None, "a b c d e f g h i j")], "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in decontaminate.find_leaks(twice, items).collect()) == [-1, 1, 1]


def test_whole_tables_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect()}
    own = {r.item_id: grams(plain_words(r.text)) for r in items.collect()}
    want = set()
    for r in docs.collect():
        there = grams(plain_words(r.text))
        want |= {(r.doc_id, i) for i, g in own.items() if len(g & there) >= 0.8 * len(g)}
    assert got == want and len(want) > 20


def test_document_frequencies_over_many_batches(spark):
    """Items of one task that come in several Arrow batches are items of their own."""
    texts = [f"shared words here {c * 3} {c * 4}" for c in "abcdef"]
    items = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "item_id long, text string, row long").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        (index,) = next(iter(decontaminate.indexes(items))).value
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    h = {w: decontaminate.normal([w]).hashes()[0] for w in ("shared", "aaa")}
    weight = {w: index.top[list(index.terms).index(x)] for w, x in h.items()}
    length = decontaminate.K1 + 1  # every item has the mean length and every term once
    assert abs(weight["shared"] - math.log1p(0.5 / 6.5) * length / length) < 1e-9
    assert abs(weight["aaa"] - math.log1p(5.5 / 1.5)) < 1e-9


def test_keys_of_one_name_and_clashing_columns(spark):
    text = "what is the tallest of all the mountains that stand on the small round island? it is the old grey one"
    docs = spark.createDataFrame([("d", f"before {text} after", 1, 2.0)], "id string, text string, first_word int, bm25 double")
    items = spark.createDataFrame([("i", text, "p")], "id string, text string, part string")
    out = decontaminate.find_leaks(docs, items, key="id", item_key="id")
    assert out.columns[:2] == ["id", "item_id"] and [tuple(r)[:2] for r in out.collect()] == [("d", "i")]
    assert decontaminate.without_leaks(docs, items, item_key="id").count() == 0
